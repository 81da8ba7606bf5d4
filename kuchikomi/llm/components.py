"""Connected components by alternating stars, each round two aggregations and joins over the edges.

Edge cases: an edge from a node to itself and edges with a null end are no edges; repeated edges count once; no edges give
no rows; columns other than ``a`` and ``b`` are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import stored


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component; ``edges`` has the columns ``a, b``.

    No node's neighbours are ever gathered: a star is its minimum, joined back. A hot node is a skewed join key,
    which adaptive execution splits. Every round is stored, so nothing is computed twice or lost with an executor.
    """
    current = stored(_oriented(edges.select("a", "b")), "edges")
    mark = _mark(current)
    while True:
        current = stored(_small_star(_large_star(current)), "edges")
        before, mark = mark, _mark(current)
        if before == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))
