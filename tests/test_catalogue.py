"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from tools.compare import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in contract.queries() if n in contract.oracle_sql()])
def test_query_matches_sql(spark, oracle, name):
    df = contract.queries()[name](spark, FOLDER)
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(contract.oracle_sql()[name])
    assert actual == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_aspect_corpus_is_in_reading_order(spark):
    df = contract.queries()["aspect_corpus"](spark, FOLDER)
    keys = [(r.hotel_id, r.post_datetime) for r in df.collect()]
    assert keys == sorted(keys)
