"""N-gram Jaccard join: MinHash banding finds candidates, whole n-gram sets decide.

Documents with equal word sequences are one class, and classes are what is joined. Bands and rows follow from the
threshold and the wanted recall. A band hash leads every class to the smallest one beside it (never to all of them), and
the components of these leads hold every candidate pair. Members of a component meet in blocks of bounded size, every
two blocks in one task, where all their pairs are verified at once by counting shared n-grams. A task returns counts
and a spanning forest, not pairs, so a group of many near copies stays as many rows as it has members.

Rows are numbered and written down first, and texts meet what is known of them by that number, so ids may be null or
repeat as often as they like.

Words are lower-cased runs without ASCII punctuation. Edge cases: null texts count as empty; texts without words form
one class without links; fewer than ``size`` words are one n-gram; texts of any length are read whole, one at a time;
rows that repeat belong to one class; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other
columns can't clash; ``deduplicated`` hands all columns on. The work on links grows with the square of the *different*
texts in one group, as the links do.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.components import connected
from kuchikomi.llm.decontamination import FOLD
from kuchikomi.llm.rows import frames, groups, stored, texts

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK_ROWS = 512
BASE = np.uint64(0x9E3779B97F4A7C15)
MOST_WORDS = 200_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 150) -> tuple[int, int]:
    """Bands and rows: the most rows per band, hence fewest false candidates, that reach ``recall`` at the threshold."""
    for rows in range(16, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most_hashes or rows == 1:
            return bands, rows
    raise AssertionError


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def words(self, text: str) -> list[bytes]:
        return text.lower().encode("utf-8", "replace").translate(FOLD).split()

    def grams(self, words: list[bytes], size: int = SIZE) -> np.ndarray:
        """Distinct hashes of all runs of ``size`` words."""
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - size + 1, 1)
        run = np.zeros(n, dtype=np.uint64)
        for i in range(min(size, len(h))):
            run = run * BASE + h[i : i + n]
        return np.unique(mixed(run))


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band over the minima of ``rows`` hash functions."""
    rng = np.random.RandomState(7)
    factors = rng.randint(1, 1 << 62, size=(bands * rows, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint64)
    for i in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[None, i : i + 4096] * factors) >> np.uint64(32)).min(axis=1))
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(bands, rows).T:
        out = mixed(out * BASE + column)
    return out


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a number for every row, ``row``, which is fixed by being written down."""
    return stored(texts(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")


def signatures(numbered_rows: DataFrame, size: int, threshold: float, recall: float) -> DataFrame:
    """``row, doc_id, digest, bands`` of every numbered row. Texts without words have no bands."""
    bands, rows = banding(threshold, recall)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            digests, signed = [], []
            for text in batch.text:  # one text's words at a time
                words = shingler.words(text)
                grams = shingler.grams(words, size)
                digests.append(digest(words))
                signed.append(signature(grams, bands, rows).astype(np.int64) if len(grams) else None)
            yield pd.DataFrame({"row": batch.row, "doc_id": batch.doc_id, "digest": digests, "bands": signed})

    return frames(numbered_rows, run, "row long, doc_id long, digest binary, bands array<long>")


def candidate_components(classes: DataFrame, signed: DataFrame) -> DataFrame:
    """``key, component`` of every class that shares a band with another."""
    bands = signed.join(classes.select(F.col("key").alias("row")), "row").select(F.col("row").alias("key"), F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    leads = bands.join(heads, "band").where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    inside = connected(leads)
    roots = inside.select(F.col("root").alias("key")).distinct().withColumn("component", F.col("key"))
    return inside.select(F.col("node").alias("key"), F.col("root").alias("component")).union(roots)


def verified(rows: DataFrame, classes: DataFrame, components: DataFrame, size: int, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, class_links, doc_links, root`` for each class and block with links; ``root`` spans what a block connects."""
    blocks = components.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    wanted = components.join(blocks, "component").join(classes.select("key", "copies"), "key")
    found = rows.select(F.col("row").alias("key"), "text").join(wanted, "key").select("key", "component", "blocks", "copies", "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.grams(shingler.words(text), size).tobytes() for text in batch.text]
            yield batch[["key", "component", "blocks", "copies"]].assign(grams=sets)

    cut = frames(found, grams, "key long, component long, blocks int, copies long, grams binary")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    met = cut.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "key", "copies", "grams")
    dealt = met.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(batches, ["component", "a", "b"]):
            out = _links(group.drop_duplicates("key"), threshold)
            if len(out):
                yield out

    return frames(dealt, verify, "key long, class_links long, doc_links long, root long")


def _links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All pairs of one block, or between two blocks, by the number of n-grams they share."""
    n = len(group)
    if n < 2:
        return group.iloc[:0]
    sets = [np.frombuffer(g, np.uint64) for g in group.grams]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    use = often[column]
    row, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), dtype=np.float32)
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        present = np.zeros((n, min(4096, int(often.sum()) - start)), dtype=np.float32)
        present[row[a:b], column[a:b] - start] = 1
        shared += present @ present.T
    shared = shared.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared + 1e-9 >= threshold * union
    np.fill_diagonal(linked, False)
    block = group.block.to_numpy(dtype=np.int64)
    if group.a.iloc[0] != group.b.iloc[0]:
        linked &= block[:, None] != block[None, :]
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    keys, copies = group.key.to_numpy(dtype=np.int64), group.copies.to_numpy(dtype=np.int64)
    out = pd.DataFrame({"key": keys, "class_links": linked.sum(axis=1), "doc_links": linked @ copies, "root": keys[root]})
    return out[out.class_links > 0]


def jaccard_groups(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Every row with its class, links and group.

    ``row, doc_id, digest, class_id`` (smallest id with the same words), ``copies`` (rows of the class), ``class_links``
    (other classes at the threshold or above), ``n_links`` (other rows, copies included), ``group_id`` (smallest id
    reachable over links) and ``stays`` (true for one row of each group, the first by id).
    """
    return _grouped(numbered(docs), size, threshold, recall)


def _grouped(rows: DataFrame, size: int, threshold: float, recall: float) -> DataFrame:
    signed = stored(signatures(rows, size, threshold, recall), "signatures")
    first = F.struct("doc_id", "row")
    classes = stored(signed.groupBy("digest").agg(F.min("row").alias("key"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    components = candidate_components(classes, signed)
    links = stored(verified(rows, classes, components, size, threshold), "links")
    totals = links.groupBy("key").agg(F.sum("class_links").alias("class_links"), F.sum("doc_links").alias("doc_links"))
    spanned = connected(links.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    grouped = classes.join(totals, "key", "left").join(spanned, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("group"))
    known = grouped.join(firsts, "root").select("digest", "first", "copies", "class_links", "doc_links", "group")
    zero = F.lit(0).cast("bigint")
    return signed.select("row", "doc_id", "digest").join(known, "digest").select(
        "row",
        "doc_id",
        "digest",
        F.col("first.doc_id").alias("class_id"),
        "copies",
        F.coalesce("class_links", zero).alias("class_links"),
        (F.coalesce("doc_links", zero) + F.col("copies") - 1).alias("n_links"),
        F.col("group.doc_id").alias("group_id"),
        (F.col("group.row") == F.col("row")).alias("stays"),
    )


def deduplicated(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group."""
    number = "row"
    while number in docs.columns:
        number += "_"
    keyed = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = texts(keyed, F.col(number).alias("row"))
    staying = _grouped(rows, size, threshold, recall).where("stays").select(F.col("row").alias(number))
    return keyed.join(staying, number, "left_semi").select(*docs.columns)
