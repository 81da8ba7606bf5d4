from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from cases import awkward

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from kuchikomi.llm import decontamination, jaccard_join, quality, queries, toxicity  # noqa: E402
from kuchikomi.llm.rows import stored, table  # noqa: E402
from tools.compare import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_stages_are_the_operators_decisions(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, FOLDER), "stage")
        assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.dtypes == docs.select(*kept.columns).dtypes
        wanted = {
            "toxicity": lambda: {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score < 0.5},
            "quality": lambda: {r.doc_id for r in quality.judged(docs, labels).collect() if r.accepted},
            "near copies": lambda: {r.doc_id for r in jaccard_join.jaccard_groups(docs).collect() if r.stays},
            "decontamination": lambda: {r.doc_id for r in decontamination.contamination(docs, table(spark, FOLDER, "benchmark")).collect() if not r.contaminated},
        }[name]()
        assert {r.doc_id for r in kept.collect()} == wanted
        docs = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == {r.doc_id for r in rows}


def test_awkward_input(spark):
    docs = awkward(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
    assert docs.count() >= 5
