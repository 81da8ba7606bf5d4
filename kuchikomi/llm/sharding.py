"""Sharding: balanced label propagation over documents that share a text, with DataFrame operations only.

Documents start in shards dealt by a hash of their id. In each round every group of equal texts names the shard
that holds most of its members, and members elsewhere ask to move there. Requests are granted per ordered pair of
shards: as many as the opposite pair gives back (an exchange keeps both sizes), plus the target's free room. What
is decided per group and per pair is aggregated before it is shuffled, so a group holding a third of all rows is
a few counters; if it does not fit into one shard, it fills one and goes on to the next in the following round.
At last the law `rows` is made exact: each shard keeps as many documents as its share, linked ones first, and
the documents beyond move to the free slots of the others.

Edge cases: a null text counts as empty, has size 1 and is no link, nor is an empty text; rows that repeat an id are
documents of their own; texts of any length are measured whole; fewer rows than shards leave shards empty; an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.llm.rows import stored, texts

SHARDS = 8
ROUNDS = 6
#: Requests of a pair of shards are granted in slices of this many hash buckets by group and, within, by document.
GROUP_SLICES, ROW_SLICES = 128, 64
#: Ranks are counted per bucket and settled inside it; a bucket holds a 4,096th of a shard's documents.
RANK_BUCKETS = 4_096


def linked_rows(docs: DataFrame) -> DataFrame:
    """``row, doc_id, size, text_crc32, link``: ``link`` is the digest of the text, null for empty texts."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return whole.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length("text") + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))).alias("link"),
    )


def first_shard(shards: int):
    return F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def members(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``row, link, shard`` of rows that share a text; a group above half a quota is split into parts that fit."""
    limit = max(1, n // (2 * shards))
    sizes = rows.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / limit).cast("bigint"))
    return rows.join(sizes, "link").select(
        "row", F.when(F.col("n") > limit, F.concat_ws("/", "link", part.cast("string"))).otherwise(F.col("link")).alias("link"), first_shard(shards).alias("shard")
    )


def _granted(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Moves allowed per (from, to): what the opposite direction returns, plus a part of the target's room."""
    swaps = {(s, t): min(k, asked.get((t, s), 0)) for (s, t), k in asked.items()}
    beyond = [sum(k - swaps[s, t] for (s, t), k in asked.items() if t == to) for to in range(len(room))]
    return {(s, t): swaps[s, t] + min(k - swaps[s, t], room[t] * (k - swaps[s, t]) // max(beyond[t], 1)) for (s, t), k in asked.items()}


def propagate(state: DataFrame, quota: list[int]) -> DataFrame:
    """One round: ``state`` (row, link, shard) with the granted moves made."""
    shards = len(quota)
    held = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    lead = held.groupBy("link").agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("target"))
    asking = state.join(lead, "link").withColumn(
        "slice",
        (F.pmod(F.xxhash64("link"), F.lit(GROUP_SLICES)) * ROW_SLICES + F.pmod(F.xxhash64("row", "link"), F.lit(ROW_SLICES))).cast("int"),
    )
    # At most shards^2 * slices rows, whatever the input.
    slices = asking.groupBy("shard", "target", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = slices.withColumn("up_to", F.sum("n").over(Window.partitionBy("shard", "target").orderBy("slice"))).persist()
    totals = {(r.shard, r.target): r.n for r in slices.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
    load = [sum(n for (s, _), n in totals.items() if s == shard) for shard in range(shards)]
    asked = {pair: n for pair, n in totals.items() if pair[0] != pair[1]}
    allowed = _granted(asked, [max(0, q - k) for q, k in zip(quota, load)])
    limit = F.create_map(*[F.lit(x) for (s, t), k in allowed.items() for x in (s * shards + t, k)]) if allowed else None
    if limit is None:
        slices.unpersist()
        return state
    pair = F.col("shard") * shards + F.col("target")
    cuts = slices.where(F.col("up_to") <= limit[pair]).groupBy("shard", "target").agg(F.max("slice").alias("cut")).collect()
    slices.unpersist()
    if not cuts:
        return state
    cut = F.create_map(*[F.lit(x) for r in cuts for x in (r.shard * shards + r.target, r.cut)])
    moves = (F.col("shard") != F.col("target")) & (F.col("slice") <= F.coalesce(cut[pair], F.lit(-1)))
    return asking.select("row", "link", F.when(moves, F.col("target")).otherwise(F.col("shard")).alias("shard"))


def exact(rows: DataFrame, state: DataFrame, quota: list[int]) -> DataFrame:
    """``shard`` and gapless ``slot`` of every row: shards keep their quota, the rest fills the free slots."""
    shards = len(quota)
    placed = rows.join(state.select("row", F.col("link").alias("part"), F.col("shard").alias("near")), "row", "left").select(
        "row", "doc_id", "size", "text_crc32", "part", F.coalesce("near", first_shard(shards)).alias("near")
    )
    # Linked rows come first and by group, so the ones to leave are those without links.
    wide = RANK_BUCKETS // ROW_SLICES
    high = F.when(F.col("part").isNotNull(), F.pmod(F.xxhash64("part"), F.lit(wide))).otherwise(F.lit(wide) + F.pmod(F.xxhash64("row", "doc_id"), F.lit(wide)))
    placed = placed.withColumn("bucket", (high * ROW_SLICES + F.pmod(F.xxhash64("row"), F.lit(ROW_SLICES))).cast("int"))
    counts = placed.groupBy("near", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("near").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("near", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("near", "bucket").orderBy("part", "row")
    ranked = placed.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["near", "bucket"]).withColumn("place", F.col("offset") + F.col("place"))

    held = {r.near: r.n for r in counts.groupBy("near").agg(F.sum("n").alias("n")).collect()}
    held = [held.get(s, 0) for s in range(shards)]
    over = [max(0, k - q) for k, q in zip(held, quota)]
    free = [max(0, q - k) for k, q in zip(held, quota)]
    leaving = F.lit(0).cast("bigint")
    shard, slot = F.col("near"), F.col("place")
    for s in range(shards):
        leaving = F.when(F.col("near") == s, F.col("place") - quota[s] + sum(over[:s])).otherwise(leaving)
    beyond = F.lit(False)
    for s in range(shards):
        beyond = beyond | ((F.col("near") == s) & (F.col("place") >= quota[s]))
    ranked = ranked.withColumn("leaving", F.when(beyond, leaving))
    for t in range(shards):
        takes = (F.col("leaving") >= sum(free[:t])) & (F.col("leaving") < sum(free[: t + 1]))
        shard = F.when(takes, F.lit(t)).otherwise(shard)
        slot = F.when(takes, held[t] + F.col("leaving") - sum(free[:t])).otherwise(slot)
    return ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every document with its shard: counts at most one apart, documents with equal texts together where quotas allow."""
    rows = stored(linked_rows(docs), "shard-rows")
    n = rows.count()
    quota = quotas(n, shards)
    state = stored(members(rows, n, shards), "shard-state")
    for _ in range(rounds):
        moved = propagate(state, quota)
        if moved is state:
            break
        state = stored(moved, "shard-state")
    return exact(rows, state, quota).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
