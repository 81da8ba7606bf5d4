from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kuchikomi import session
from kuchikomi.domain import ASPECT_ROWS
from kuchikomi.operators import corpus
from kuchikomi.sources import assets, delimited, pages, review_lines, sinks

AWKWARD = ["  lead", "trail \t", "", None, "\nbreak\n", "部屋は「良い」、とても\n静か😀", 'she said "hi", then\tleft', "a,b", "x\\y", "'quoted'"]


@pytest.fixture
def raw_files(tmp_path):
    good = {
        "id": 12,
        "title": " 良い　宿 ",
        "comment": "とても\n良い",
        "overallScore": 4,
        "postDateTime": "2024-02-01T03:04:05+09:00",
        "provider": {"name": "海の宿"},
        "reservation": {"checkInDate": "2024-01-30"},
        "scores": [{"code": "ROOM", "score": 4}, {"code": "BATH", "score": 0.0}],
    }
    bare = {"id": "b", "provider": None, "scores": None}
    (tmp_path / "hotel_101_reviews.jsonl").write_text(
        json.dumps(good, ensure_ascii=False) + "\n\n   \n" + '{"id": "broken\n' + json.dumps(bare) + "\n", encoding="utf8"
    )
    (tmp_path / "hotel_abc-7_reviews.jsonl").write_text(json.dumps({"title": "no id"}) + "\n[1]\n", encoding="utf8")
    return str(tmp_path / "hotel_*_reviews.jsonl")


def test_review_lines_from_files(spark, raw_files):
    parsed = review_lines.parse_review_lines(review_lines.read_review_lines(spark, raw_files))
    audit = {r.hotel_id: tuple(r)[1:] for r in review_lines.ingest_audit(parsed).collect()}
    assert audit == {"101": (3, 2, 1), "abc-7": (2, 1, 1)}
    assert sorted(r.line for r in review_lines.rejected(parsed).collect()) == ["[1]", '{"id": "broken']
    records = {r.review_id: r for r in corpus.research_corpus(review_lines.accepted(parsed), "site").collect()}
    assert set(records) == {"12", "b", None}
    full = records["12"]
    assert (full.title, full.comment, full.hotel_name, full.check_in_date) == ("良い 宿", "とても 良い", "海の宿", "2024-01-30")
    assert full.scores == {"room": 4.0, "bath": 0.0} and full.source == "site" and full.overall_score == 4.0
    assert (records["b"].hotel_name, records["b"].comment, records["b"].scores) == (None, "", {})


def test_hotel_of_file(values):
    names = ["/x/hotel_108080_reviews.jsonl", "_108080_reviews.jsonl", "hotel__reviews.jsonl", None]
    assert values(review_lines.hotel_of_file(F.col("t")), names) == ["108080", None, None, None]


def test_research_json_round_trip(spark, raw_files, tmp_path):
    parsed = review_lines.parse_review_lines(review_lines.read_review_lines(spark, raw_files))
    records = corpus.research_corpus(review_lines.accepted(parsed), "site")
    path = str(tmp_path / "research")
    sinks.write_json(records, path)
    sinks.write_json(records, path)
    sinks.append_json(records, path)
    back = review_lines.read_research(spark, path)
    assert back.count() == 6
    assert {r.review_id for r in review_lines.collected_ids(back, "review_id").collect()} == {"12", "b"}
    assert back.where("review_id = '12'").first().scores == {"room": 4.0, "bath": 0.0}


def test_csv_keeps_awkward_texts(spark, tmp_path):
    rows = [("h", "宿", str(i), t, "2024-01-01", "room", 4.0, 2) for i, t in enumerate(AWKWARD)]
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame(rows, ASPECT_ROWS), path)
    back = delimited.read_csv(spark, path, multi_line=True).collect()
    assert [r.comment for r in sorted(back, key=lambda r: int(r.review_id))] == AWKWARD


def test_labelled_tsv(spark, tmp_path):
    path = tmp_path / "pn.tsv"
    path.write_text("a1\t1\t部屋が良い\tx\ttrain\na2\t-1.0\t狭い, 暗い\t\tdev\na3\tx\t\"二行\n目\"\t\tdev\n", encoding="utf8")
    back = delimited.read_labelled_tsv(spark, str(path), multi_line=True).orderBy("id").collect()
    assert [(r.id, r.label, r.text, r.split) for r in back] == [("a1", 1, "部屋が良い", "train"), ("a2", -1, "狭い, 暗い", "dev"), ("a3", None, "二行\n目", "dev")]


def test_text_sink(spark, tmp_path):
    path = str(tmp_path / "text")
    sinks.write_text(spark.createDataFrame([("一",), ("二",), (None,)], "t string"), "t", path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["", "一", "二"]


def _page(reviews, total="123", **missing):
    marker = missing.get("marker", '"reviewList":{"data":{')
    contents = missing.get("contents", '"contents":')
    return f'<html>"total":9,{marker}"x":[0],"total":{total},{contents}{json.dumps(reviews, ensure_ascii=False)},"more":["]"]}}}}</html>'


def test_pages(spark):
    reviews = [
        {"id": 1, "title": "a]b", "comment": 'quote " and ] bracket', "scores": [{"code": "ROOM", "score": 3}]},
        {"id": "2", "title": "最後", "postDateTime": "2024-01-01"},
    ]
    html = [
        _page(reviews),
        _page([], total="x1"),
        _page(reviews, marker='"reviews":{'),
        _page(reviews, contents='"content":'),
        "nothing",
    ]
    stored = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string")
    extracted = pages.extract_pages(stored)
    assert {r.page_id: r.reported_total for r in extracted.collect()} == {0: 123, 1: None, 2: None, 3: 123, 4: None}
    assert sorted(r.page_id for r in pages.unreadable_pages(extracted).collect()) == [2, 3, 4]
    rows = pages.page_reviews(extracted).orderBy("position").collect()
    assert [(r.page_id, r.position, r.id, r.title) for r in rows] == [(0, 0, "1", "a]b"), (0, 1, "2", "最後")]
    assert rows[0].comment == 'quote " and ] bracket' and rows[0].scores[0].score == 3.0
    ends = {r.page_id: r for r in pages.page_ends(extracted).collect()}
    assert (ends[0].n_reviews, ends[0].first_id, ends[0].last_id, ends[0].last_posted) == (2, "1", "2", "2024-01-01")
    assert (ends[1].n_reviews, ends[1].first_id, ends[4].n_reviews) == (0, None, 0)


def test_page_terms_and_urls(spark):
    urls = " ".join(f'"https://x.jp/list?page={i}"' for i in range(25))
    html = f"Page pagination OFFSET <a href='http://x.jp/REVIEW/1'> https://x.jp/other　https://x.jp/?offset=2 {urls} https://x.jp/review{'z' * 400}"
    stored = spark.createDataFrame([(1, html)], "page_id int, html string")
    counts = {r.term: r.occurrences for r in pages.term_counts(stored).collect()}
    assert (counts["page"], counts["pagination"], counts["offset"], counts["currentPage"]) == (26, 1, 2, 0)
    found = [r.url for r in pages.pagination_urls(stored).orderBy("position").collect()]
    assert len(found) == 20 and found[:3] == ["http://x.jp/REVIEW/1", "https://x.jp/?offset=2", "https://x.jp/list?page=0"]
    long = spark.createDataFrame([(1, "https://x.jp/review" + "z" * 400)], "page_id int, html string")
    assert len(pages.pagination_urls(long).first().url) == 300


def test_assets(spark, tmp_path):
    there = str(tmp_path / "there")
    spark.createDataFrame([("h", 1, "t" * 120), ("h", 1, "u"), ("h", None, "v")], "Hotel_Name string, label int, room_text string").write.parquet(there)
    known = {"there": there, "absent": str(tmp_path / "absent")}
    rows = {r.asset: r for r in assets.asset_overview(spark, known).collect()}
    assert (rows["there"].found, rows["there"].n_rows, rows["there"].n_columns) == (True, 3, 3)
    assert (rows["there"].aspect_columns, rows["there"].hotel_columns) == ("room_text", "Hotel_Name")
    assert (rows["absent"].found, rows["absent"].n_rows) == (False, 0)
    assert [tuple(r) for r in assets.asset_labels(spark, known).collect()] == [("there", "1", 2)]
    sample = {r.column_name: r.value for r in assets.sample_row(spark.read.parquet(there), "room_text").collect()}
    assert sample == {"Hotel_Name": "h", "label": "1", "room_text": "t" * 100 + "..."}
    shape = assets.overview(spark.read.parquet(there)).collect()
    assert [(r.n_rows, r.n_columns, r.column_name, r.data_type) for r in shape][1] == (3, 3, "label", "int")


def test_shared_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    first, second = session.fresh_path(spark, "x"), session.fresh_path(spark, "x")
    assert first.startswith(f"{folder}/x-") and first != second
