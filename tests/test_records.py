from __future__ import annotations

import csv
import io
import random

import pytest

from kuchikomi.sources import delimited, records

SCHEMA = "id string, text string, tail string"


def awkward_rows(rng, n):
    bits = ["a", '"', ",", "\n", "\r\n", " ", "\t", "数据", "", "x" * 30, '""', "\n\n", '",\n"', "é"]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 7))), rng.choice(["", "end", "\n", '"'])] for i in range(n)]


def written(rows, line_end, header=True):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=line_end, quoting=csv.QUOTE_ALL)
    writer.writerows(([["id", "text\nof", "tail"]] if header else []) + rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes, so borders fall inside quotes, between quotes and inside line ends."""

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield of
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("size,line_end", [(7, "\n"), (64, "\r\n"), (300, "\n"), (1 << 27, "\r\n")])
def test_every_split_size_gives_the_same_rows(spark, tmp_path, small_splits, size, line_end):
    rng, wanted = random.Random(size), []
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        rows = awkward_rows(rng, 40)
        wanted += rows
        (tmp_path / "in" / name).write_text(written(rows, line_end), encoding="utf8", newline="")
    small_splits(size)
    lines = records.file_lines(spark, str(tmp_path / "in"))
    if size < 1 << 20:
        assert lines.rdd.getNumPartitions() > 2 and lines.select("_file", "_block").distinct().count() > 2
    back = delimited.read_csv(spark, str(tmp_path / "in"), SCHEMA, multi_line=True).collect()
    assert sorted([r.id, r.text, r.tail] for r in back) == sorted(wanted)


def test_fields_are_those_of_the_built_in_reader(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('id,text,tail\n1,\\N,"\\N"\n"2","a ""b""\nc"," x"\n\n3,,\n4,"unclosed\n5,x,y', encoding="utf8")
    wanted = spark.read.options(quote='"', escape='"', multiLine=True, nullValue="\\N", emptyValue="", header=True).schema(SCHEMA).csv(str(path)).collect()
    small_splits(9)
    back = delimited.read_csv(spark, str(path), SCHEMA, multi_line=True)
    key = lambda r: r.id
    found, wanted = sorted(back.collect(), key=key), sorted(wanted, key=key)
    assert [tuple(r) for r in found[:3]] == [tuple(r) for r in wanted[:3]]
    assert len(found) == len(wanted) == 4 and found[3].id == wanted[3].id == "4"


def test_folder_columns_and_empty_files(spark, tmp_path, small_splits):
    for split, text in (("train", 'id,n\n"train\n1",5\n'), ("dev", 'id,n\n"dev\n1",6\n'), ("none", ""), ("head", "id,n\n")):
        (tmp_path / f"split={split}").mkdir()
        (tmp_path / f"split={split}" / "x.csv").write_text(text, encoding="utf8")
    small_splits(5)
    back = delimited.read_csv(spark, str(tmp_path), "id string, n int, split string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == [("dev\n1", 6, "dev"), ("train\n1", 5, "train")]
