from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pyarrow as pa

from kuchikomi.llm import fill_in_middle
from tests.llm.cases import awkward, documents, empty, sentence

PLAN = fill_in_middle.Plan()


def plain_form(doc_id, text, plan=PLAN):
    """The definition, one text at a time."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plan.rate:
        return (doc_id, n, "plain", None, None, None, text)
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < plan.suffix_first:
        return (doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(4)
    values = ["\n".join(sentence(rng, rng.randint(0, 5)) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n", "\n\n"]) for _ in range(300)]
    odd = [None, "", "\n", "\n\n\n", "a", "a\r\nb c\x85d\n", "x<P>y\nz", "<M>", "<S\n>", "<\nP>\n<", "P>\nS>\nM>", "Ü😀\n数据\n", "line\n" * 60_000, "y" * 3_000_000]
    return values + odd


def test_equals_the_definition(spark):
    values = texts()
    for plan in (PLAN, fill_in_middle.Plan(rate=60, suffix_first=10, seed=3)):
        made = fill_in_middle.transformed(documents(spark, values).repartition(3), plan, ("doc_id", "n", "form", "prefix", "middle", "suffix", "output"))
        assert sorted(map(tuple, made.collect())) == [plain_form(i, t, plan) for i, t in enumerate(values)]


def test_all_forms_occur_and_are_taken_apart(spark):
    values = texts()
    made = fill_in_middle.restored(fill_in_middle.transformed(documents(spark, values), fill_in_middle.Plan(rate=80)), fill_in_middle.Plan(rate=80)).collect()
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert all(r.restored == (values[r.doc_id] or "") for r in made)


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "MOST_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "x" * 50, "", "12345", "678901", ""]})
    parts = [b.column("text").to_pylist() for b in fill_in_middle.text_slices(iter([batch, batch.slice(0, 0)]), "text")]
    assert parts == [["abc", None], ["x" * 50], ["", "12345"], ["678901", ""]]


def test_awkward_rows_and_sql(spark):
    rows = fill_in_middle.digests(awkward(spark))
    con = duckdb.connect()
    frame = awkward(spark).select("doc_id", "text").toArrow()
    con.register("documents", frame)
    cursor = con.execute(fill_in_middle.SQL)
    names = [d[0] for d in cursor.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows.select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)
    assert rows.count() == 12
    assert fill_in_middle.digests(empty(spark)).collect() == []
