"""Subword vocabulary built from a corpus, and greedy longest-match encoding with it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.domain import SPECIAL_PIECES, SUBWORD_VOCABULARY, UNKNOWN_ID
from kuchikomi.functions.tokens import SOON_SEGMENT, char_tokens
from kuchikomi.session import bounded_batches

MAX_PIECE_CHARS = 6
CHARS_AT_ONCE, MOST_CELLS = 1 << 19, 1 << 22


def segments(texts: DataFrame, column: str) -> DataFrame:
    """Distinct script runs and single other characters with their occurrences."""
    found = texts.select(F.explode(F.regexp_extract_all(column, F.lit(SOON_SEGMENT), F.lit(0))).alias("segment"))
    return found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def _grams(text: Column, chars: int) -> Column:
    """All overlapping pieces of ``chars`` characters, in one linear scan of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{chars}}}))."), F.lit(1))


def train_vocabulary(
    texts: DataFrame, column: str, size: int = SUBWORD_VOCABULARY, max_chars: int = MAX_PIECE_CHARS
) -> DataFrame:
    """``(id, piece, n)``: the special pieces, every character of the corpus, then the best longer pieces.

    Pieces never cross a script run. Longer pieces are ranked by the characters they cover, count times
    length, ties by piece. Every character is kept, so the table exceeds ``size`` if the corpus has more
    characters than that. N-grams are taken from distinct segments weighted by their count, not from every
    text. Characters and n-grams read the segments unfiltered, so that one shuffle of them serves both.
    Pieces have at most ``max_chars`` characters. The final numbering runs in one task over the characters
    and at most ``size`` pieces, which is bounded by the script and the parameter, not by the corpus.
    """
    counted = segments(texts, column)
    chars = (
        counted.select(F.explode(char_tokens(F.col("segment"))).alias("piece"), "n")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )
    # One length at a time: a long segment is never expanded to the n-grams of all lengths in one row.
    by_length = [counted.select(F.explode(_grams(F.col("segment"), k)).alias("piece"), "n") for k in range(2, max_chars + 1)]
    longer = (
        reduce(DataFrame.union, by_length)
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc(F.col("n") * F.length("piece")), "piece")
        .limit(size - len(SPECIAL_PIECES))
    )
    order = Window.orderBy(F.desc("is_char"), F.desc(F.col("n") * F.length("piece")), "piece")
    numbered = (
        chars.withColumn("is_char", F.lit(True))
        .unionByName(longer.withColumn("is_char", F.lit(False)))
        .withColumn("id", F.row_number().over(order) + (len(SPECIAL_PIECES) - 1))
        .where(F.col("is_char") | (F.col("id") < size))
        .select("id", "piece", "n")
    )
    special = texts.sparkSession.createDataFrame(
        [(i, p, 0) for i, p in enumerate(SPECIAL_PIECES)], "id int, piece string, n bigint"
    )
    return special.unionByName(numbered)


def _pieces(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where(F.col("id") >= len(SPECIAL_PIECES))


class Cutter:
    """Greedy longest match over many texts at once: the longest known piece at each place, else one character.

    The longest match is looked up at every place, a character deeper at a time. Which places are starts of pieces is then
    followed from all heads together: a text's first character, one that is in no longer piece, and what comes behind it.
    """

    def __init__(self, ids: dict[str, int]):
        chars = sorted(set("".join(ids)))
        number = {c: i for i, c in enumerate(chars, 1)}
        self.kinds = np.zeros(0x110000, dtype=np.int32)
        self.kinds[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_id = np.array([UNKNOWN_ID, *(ids.get(c, UNKNOWN_ID) for c in chars)], dtype=np.int32)
        longer = sorted(p for p in ids if len(p) > 1)
        self.joins = np.zeros(len(chars) + 1, dtype=bool)
        self.joins[[number[c] for c in set("".join(longer))]] = True
        # Nodes by prefix; 0 is none. A node's id is -1 unless it is a piece of two characters or more.
        nodes = {p: i for i, p in enumerate(sorted({p[:k] for p in longer for k in range(1, len(p) + 1)}), 1)}
        self.id_at = np.full(len(nodes) + 1, -1, dtype=np.int32)
        self.id_at[[nodes[p] for p in longer]] = [ids[p] for p in longer]
        self.first = np.zeros(len(chars) + 1, dtype=np.int32)
        self.inner, self.width, keys = np.zeros(len(nodes) + 1, dtype=bool), len(chars) + 1, {}
        for prefix, node in nodes.items():
            if len(prefix) == 1:
                self.first[number[prefix]] = node
            else:
                self.inner[nodes[prefix[:-1]]] = True
                keys[nodes[prefix[:-1]] * self.width + number[prefix[-1]]] = node
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.nodes = np.array([keys[k] for k in self.keys.tolist()], dtype=np.int32)
        self.table = None
        if (len(nodes) + 1) * self.width <= MOST_CELLS:
            self.table = np.zeros((len(nodes) + 1) * self.width, dtype=np.int32)
            self.table[self.keys] = self.nodes

    def _next(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * self.width + kind
        if self.table is not None:
            return self.table[key]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.nodes[place], 0)

    def _matches(self, kinds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and id of the longest match at each place; no match reaches beyond its text's end."""
        sizes, ids = np.ones(len(kinds), dtype=np.int32), self.char_id[kinds]
        node = self.first[kinds]
        at = np.flatnonzero(node)
        node, depth = node[at], 1
        while len(at):
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
            node = self._next(node, kinds[at + depth])
            at, node, depth = at[node > 0], node[node > 0], depth + 1
            known = self.id_at[node] >= 0
            sizes[at[known]], ids[at[known]] = depth, self.id_at[node[known]]
            at, node = at[self.inner[node]], node[self.inner[node]]
        return sizes, ids

    def _part(self, texts: list[str], length: int | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Numbers of pieces of each text, all pieces, all ids."""
        whole, many = "".join(texts), np.array([len(t) for t in texts], dtype=np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds, last = self.kinds[chars], np.cumsum(many)
        sizes, ids = self._matches(kinds, np.repeat(last, many))
        alone = ~self.joins[kinds]
        starts = alone.copy()
        starts[1:] |= alone[:-1]
        starts[(last - many)[many > 0]] = True
        at = np.flatnonzero(starts)
        while len(at):
            at = at + sizes[at]
            at = at[at < len(chars)]
            at = at[~starts[at]]
            starts[at] = True
        at = np.flatnonzero(starts)
        data = whole.encode("utf-8")
        if len(data) > len(whole):
            wide = np.cumsum(1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000))
            places = np.where(at > 0, wide[at - 1], 0)
        else:
            places = at
        offsets = np.append(places, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        bounds = np.searchsorted(at, np.append(0, last))
        counts, ids = np.diff(bounds), ids[at]
        if length is not None:
            kept = np.arange(len(at)) - np.repeat(bounds[:-1], counts) < length
            counts, pieces, ids = np.minimum(counts, length), pieces.filter(pa.array(kept)), ids[kept]
        return counts, pieces, ids

    def cut(self, texts: list[bytes | None], length: int | None) -> pa.StructArray:
        """Pieces and ids of every text, of the first ``length`` pieces if that is given."""
        read = [(t or b"").decode("utf-8", "replace") for t in texts]
        parts, first, held = [], 0, 0
        for i, text in enumerate(read):
            held += len(text)
            if held >= CHARS_AT_ONCE or i == len(read) - 1:
                parts.append(self._part(read[first : i + 1], length))
                first, held = i + 1, 0
        counts = np.concatenate([np.zeros(1, np.int64), *(p[0] for p in parts)])
        offsets, absent = pa.array(np.cumsum(counts), pa.int32()), pa.array([t is None for t in texts], pa.bool_())
        pieces = pa.concat_arrays([pa.array([], pa.string()), *(p[1] for p in parts)])
        ids = pa.array(np.concatenate([np.zeros(0, np.int32), *(p[2] for p in parts)]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, v, mask=absent) for v in (pieces, ids)], ["pieces", "ids"])


def encode(
    df: DataFrame, column: str, vocabulary: DataFrame, prefix: str = "subword", length: int | None = None
) -> DataFrame:
    """Add ``<prefix>_pieces`` and ``<prefix>_ids``: greedy longest match, unknown characters get the unknown id.

    The pieces of a text joined together are the text; a null text has none. With ``length``, the text is read and cut up
    to that many pieces only. The vocabulary is bounded by construction and is broadcast to the tasks.
    """
    bounded_batches(df.sparkSession)
    known = {r.piece: r.id for r in _pieces(vocabulary).where("length(piece) > 0").collect()}  # bounded by the size
    shared = df.sparkSession.sparkContext.broadcast(known)
    text = F.col(column)
    if length is not None:  # one piece more, because the last one is found by looking as far ahead as the longest reaches
        text = F.substring(text, 1, (length + 1) * max(map(len, known), default=1))

    @F.arrow_udf("pieces array<string>, ids array<int>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = Cutter(shared.value)
        for batch in batches:
            yield cutter.cut(batch.cast(pa.binary()).to_pylist(), length)

    both = f"_{prefix}_cut"
    found = df.withColumn(both, cut(text))
    return found.withColumn(f"{prefix}_pieces", F.col(both)["pieces"]).withColumn(f"{prefix}_ids", F.col(both)["ids"]).drop(both)


def pieces_by_id(vocabulary: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    """The vocabulary entries with the given ids; ids beyond the vocabulary have none."""
    return vocabulary.where(F.col("id").isin(*ids)).select("id", "piece")


def vocabulary_head(vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """The first entries by id."""
    return vocabulary.orderBy("id").limit(n).select("id", "piece")
