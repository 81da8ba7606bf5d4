"""The table of queries and the decorator that fills it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Run], Run]:
    """Register a function under its name; ``views`` are the table expressions ``sql`` builds on."""

    def register(run: Run) -> Run:
        text = sql
        if text is not None and views:
            text = "with " + ",\n".join(v.strip() for v in views) + "\n" + text.strip()
        QUERIES[run.__name__] = Query(run, text, covers)
        return run

    return register
