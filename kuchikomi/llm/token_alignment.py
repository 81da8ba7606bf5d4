"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, by galloping intersection.

A text is encoded by two vocabularies, and each token's end is a byte offset. Both end lists ascend; the shorter of a
document's two drives a galloping search (steps 1, 2, 4, ... from a hint, then a binary search in the last step) into
the longer, for all tokens of many documents at once in numpy. Common ends cut the tokens into groups, by slices; differences
of ranks tell which tokens of the other side a token overlaps. The last tokens of a group are linked.

How often a pair of ids is linked is counted over the whole corpus: pairs are pre-aggregated a document, then a task, then
in Spark. Documents get the counts back in two ways that together are exact: pairs with more than one in
``HOT`` of all links (so at most ``HOT`` of them, a proven bound) by broadcast, all others by a shuffle join on the pair, in
which no key can be hot.

Edge cases: null and empty texts, and texts one vocabulary doesn't spell out again exactly (those holding U+2581), have no
tokens: zeros and an empty group string. Texts of any length are encoded whole; what is remembered are pieces between
blanks, short ones only. Rows that repeat an id, null ids and equal texts count and are returned each on its own. Only
``doc_id`` and ``text`` are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.llm.rows import frames, stored, texts
from kuchikomi.llm.vocabulary import LONGEST_KEPT, MOST_KEPT, byte_names, default_path

#: Links more frequent than one in so many travel by broadcast, so that many at most.
HOT = 1 << 17
#: Pairs of ids a task holds before it hands its counts on.
MOST_PAIRS = 1 << 21
MOST_CHARS, MOST_TEXTS = 1 << 21, 1_000
#: A cut no token of either vocabulary spans: before a single blank between two characters that aren't white space.
CUT = re.compile(r"(?<=\S)(?= \S)")


# -- the intersection


def gallop(driver: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """For each element of ``driver`` the first place in ``longer[low:high]`` not below it; every search starts at its hint."""
    at = np.clip(hint, low, high)
    # Whether the answer lies to the right: the element at the hint is below the wanted one.
    right = at < high
    right[right] = longer[at[right]] < driver[right]
    lo, hi = np.where(right, at + 1, low), np.where(right, high, at)  # the answer is in [lo, hi]
    open_, step = np.arange(len(driver)), 1
    while len(open_):
        r = right[open_]
        probe = np.where(r, np.minimum(at[open_] + step, hi[open_]), np.maximum(at[open_] - step, lo[open_]))
        inside = np.where(r, probe < hi[open_], probe >= low[open_]) & (probe < high[open_])
        below = np.zeros(len(open_), dtype=bool)
        below[inside] = longer[probe[inside]] < driver[open_[inside]]
        up, down = inside & below, inside & ~below
        lo[open_[up]] = np.maximum(lo[open_[up]], probe[up] + 1)
        hi[open_[down]] = np.minimum(hi[open_[down]], probe[down])
        # A step to the right ends where it is no longer below, one to the left where it is.
        open_ = open_[inside & (r == below) & (lo[open_] < hi[open_])]
        step *= 2
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) // 2
        below = longer[middle] < driver[open_]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def common_ends(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (ends of all documents, one after the other, ascending throughout) of equal ends.

    In every document the shorter list drives the search into the longer.
    """
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    of_a, of_b = (np.repeat(np.arange(len(s)), s) for s in (sizes_a, sizes_b))
    found = []
    for driver, of, own, longer, sizes, first, swap in (
        (a, of_a, first_a, b, sizes_b, first_b, False),
        (b, of_b, first_b, a, sizes_a, first_a, True),
    ):
        drives = (sizes_b < sizes_a) if swap else (sizes_a <= sizes_b)
        place = np.flatnonzero(drives[of])
        doc = of[place]
        low, high = first[doc], first[doc] + sizes[doc]
        own_sizes = np.maximum((sizes_a if not swap else sizes_b)[doc], 1)
        hint = low + (place - own[doc]) * sizes[doc] // own_sizes
        at = gallop(driver[place], longer, low, high, hint)
        hit = at < high
        hit[hit] = longer[at[hit]] == driver[place[hit]]
        found.append((at[hit], place[hit]) if swap else (place[hit], at[hit]))
    ia, ib = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(ia, kind="stable")
    return ia[order], ib[order]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of ``a`` the first and last token of ``b`` that share a byte with it; both lists end together."""
    hint = np.arange(len(a)) * len(b) // max(len(a), 1)
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(b))
    # The first end of b at or above an end of a belongs to the last token that overlaps it; one above its start to the first.
    last = gallop(a, b, low, high, hint)
    first = np.concatenate([[0], gallop(a[:-1] + 1, b, low[:-1], high[:-1], hint[:-1])]) if len(a) else low
    return first, last


# -- the two vocabularies


class Speller:
    """Ids of both vocabularies for the pieces of texts, and the number of bytes each id stands for."""

    def __init__(self, byte_file: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        value = {shown: byte for byte, shown in byte_names().items()}
        data = json.loads(byte_file)
        names = {i: t for t, i in data["model"]["vocab"].items()}
        self.bytes_a = [bytes(map(value.__getitem__, names[i])) if i in names else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece spans a blank, so texts can't be cut before blanks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        self.known: list[dict[str, tuple[bytes, bytes] | None]] = [{}, {}]
        # For the group strings: an id before a comma, and before what ends its side of a group.
        self.shown = pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(max(len(self.bytes_a), len(self.bytes_b)))], pa.large_string())

    def learn(self, chunks: list[str]) -> None:
        """Ids of chunks, encoded many in a row: between a chunk that ends in no blank and the next is a cut like those in texts.

        If an end of a chunk isn't one of a token on both sides, or a byte differs, every chunk is encoded by itself.
        """
        ends_blank = [c[-1].isspace() for c in chunks]
        row = [c for c, blank in zip(chunks, ends_blank) if not blank]
        self.learn_each([c for c, blank in zip(chunks, ends_blank) if blank])
        text = "".join(row)
        if not row:
            return
        raw = text.encode("utf-8", "replace")
        ends = np.cumsum([len(c) if c.isascii() else len(c.encode("utf-8", "replace")) for c in row])
        sides = []
        for ids, names, lengths in (
            (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a, self.length_a),
            (self.b.encode(text[1:], num_threads=1), self.bytes_b, self.length_b),
        ):
            ids_ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ids_ends, ends)
            if b"".join(map(names.__getitem__, ids)) != raw or (ids_ends[at] != ends).any():
                return self.learn_each(row)
            data, cuts = array("H", ids).tobytes(), [0, *(2 * at + 2).tolist()]
            sides.append([data[i:j] for i, j in zip(cuts, cuts[1:])])
        self.known[0].update(zip(row, zip(*sides)))

    def learn_each(self, chunks: list[str]) -> None:
        """Ids of chunks, each of which starts with a blank; none if one vocabulary spells a chunk differently."""
        new = self.known[0]
        sides_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        sides_b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, a, b in zip(chunks, sides_a, sides_b):
            raw = chunk.encode("utf-8", "replace")
            fine = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            new[chunk] = (array("H", a).tobytes(), array("H", b).tobytes()) if fine else None

    def spell(self, values: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of every text by both vocabularies, as 16-bit integers; none where they can't be aligned."""
        split = [CUT.split(" " + v) if v and "▁" not in v else [] for v in values]
        if len(self.known[0]) > MOST_KEPT:
            self.known = [{}, self.known[0]]
        new, old = self.known
        wanted = {c for chunks in split for c in chunks if c not in new}
        new.update({c: old[c] for c in wanted if c in old})
        fresh = [c for c in wanted if c not in new]
        for i in range(0, len(fresh), 4096):
            self.learn(fresh[i : i + 4096])
        sides: tuple[list[bytes], list[bytes]] = ([], [])
        for chunks in split:
            ids = list(map(new.__getitem__, chunks))
            for side, parts in zip(sides, zip(*ids) if ids and None not in ids else ((), ())):
                side.append(b"".join(parts))
        for c in fresh:
            if len(c) > LONGEST_KEPT:
                del new[c]
        return sides  # in the machine's byte order, as numpy reads them


def shared_files(spark: SparkSession, byte_path: str | None = None, piece_path: str | None = None):
    """Both vocabulary files, of fixed size, as a broadcast that also keeps what a worker builds from them."""
    with open(byte_path or default_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        byte_file = file.read()
    with open(piece_path or default_path("piece_bpe_32k.model"), "rb") as file:
        return spark.sparkContext.broadcast({"byte": byte_file, "piece": file.read()})


def speller(shared) -> Speller:
    if "speller" not in shared.value:
        shared.value["speller"] = Speller(shared.value["byte"], shared.value["piece"])
    return shared.value["speller"]


# -- documents


class Aligned:
    """Both sides of several texts and their groups, as flat arrays with one size a text."""

    def __init__(self, spelt: Speller, values: list[str]):
        self.spelt = spelt
        sides = spelt.spell(values)
        self.a, self.b = (np.frombuffer(b"".join(s), np.uint16).astype(np.int64) for s in sides)
        self.n_a, self.n_b = (np.array([len(i) // 2 for i in s], dtype=np.int64) for s in sides)
        # Offsets run on through all texts, so that ends ascend throughout.
        self.cut_a, self.cut_b = common_ends(np.cumsum(spelt.length_a[self.a]), np.cumsum(spelt.length_b[self.b]), self.n_a, self.n_b)
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.cut_a, side="right")
        self.n_groups = np.bincount(self.doc, minlength=len(values))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, linked ids and occurrences of every distinct link of a text."""
        key, n = np.unique(self.doc << 32 | self.a[self.cut_a] << 16 | self.b[self.cut_b], return_counts=True)
        return key >> 32, key >> 16 & 0xFFFF, key & 0xFFFF, n

    def strings(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        width = len(self.spelt.shown) // 4
        last_a, last_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        last_a[self.cut_a] = 1
        last_b[self.cut_b] = 1
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups before a token's own
        edges_a, edges_b = np.concatenate([[0], self.cut_a + 1]), np.concatenate([[0], self.cut_b + 1])
        shown = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        shown[np.arange(len(self.a)) + edges_b[before_a]] = self.a + width * last_a
        end = last_b * 2
        end[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        shown[np.arange(len(self.b)) + edges_a[before_b + 1]] = self.b + width * end
        offsets = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), self.spelt.shown.take(pa.array(shown)))
        return pc.binary_join(lists, pa.scalar("", pa.large_string())).to_pylist()

    def sliced(self, flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of at most ``MOST_TEXTS`` texts and ``MOST_CHARS`` characters, or of one text."""
    ends, first = np.cumsum(batch.text.str.len().to_numpy(dtype=np.int64)), 0
    while first < len(batch):
        before = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, before + MOST_CHARS, side="right")), first + 1), first + MOST_TEXTS)
        yield batch.iloc[first:last]
        first = last


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, a_ids array<int>, b_ids array<int>, a_cuts array<int>, "
    "b_cuts array<int>, first_b array<int>, last_b array<int>, link_a array<int>, link_b array<int>, link_n array<int>"
)


def _columns(part: pd.DataFrame, found: Aligned, columns: tuple[str, ...]) -> pd.DataFrame:
    @functools.cache
    def links():
        doc, *values = found.pairs()
        return [found.sliced(v, np.bincount(doc, minlength=len(part))) for v in values]

    @functools.cache
    def strings():
        return found.strings()

    @functools.cache
    def ranges():
        sides = zip(found.sliced(found.a, found.n_a), found.sliced(found.b, found.n_b))
        return list(zip(*(overlaps(np.cumsum(found.spelt.length_a[a]), np.cumsum(found.spelt.length_b[b])) for a, b in sides)))

    def cuts(places: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        return found.sliced(places - (np.cumsum(sizes) - sizes)[found.doc], found.n_groups)

    whole = {
        "n_a": lambda: found.n_a,
        "n_b": lambda: found.n_b,
        "n_groups": lambda: found.n_groups,
        "groups": strings,
        "groups_sha256": lambda: [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings()],
        "a_ids": lambda: found.sliced(found.a, found.n_a),
        "b_ids": lambda: found.sliced(found.b, found.n_b),
        "a_cuts": lambda: cuts(found.cut_a, found.n_a),
        "b_cuts": lambda: cuts(found.cut_b, found.n_b),
        "first_b": lambda: ranges()[0],
        "last_b": lambda: ranges()[1],
        "link_a": lambda: links()[0],
        "link_b": lambda: links()[1],
        "link_n": lambda: links()[2],
    }
    return pd.DataFrame({c: (lambda v: pd.Series(list(v), index=part.index))(whole[c]()) if c in whole else part[c] for c in columns})


def aligned(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "groups"), byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The chosen columns of ``RESULT`` for every whole text, and any further columns named that ``docs`` has as integers.

    ``a_cuts`` and ``b_cuts`` are the places of a group's last tokens; ``first_b`` and ``last_b`` bound, for each token of the
    first vocabulary, the tokens of the second it overlaps; ``link_a``, ``link_b`` and ``link_n`` are a text's distinct links.
    """
    shared = shared_files(docs.sparkSession, byte_path, piece_path)
    kinds = dict(c.split() for c in RESULT.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts(batch):
                yield _columns(part, Aligned(speller(shared), part.text.tolist()), columns)

    return frames(docs, run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns))


# -- counts of links


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and occurrences of all links of a batch."""
    sizes = batch.link_n.map(len).to_numpy(dtype=np.int64)
    a, b, n = (np.concatenate([np.zeros(0, np.int64), *batch[c]]).astype(np.int64) for c in ("link_a", "link_b", "link_n"))
    return np.repeat(batch.row.to_numpy(dtype=np.int64), sizes), a << 16 | b, n


def link_counts(links: DataFrame) -> DataFrame:
    """``pair, link_a, link_b, count, best`` of every linked pair of ids in the corpus.

    ``best`` says that no other id is linked more often with ``link_b``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged(pairs, counts, waiting):
            pairs, place = np.unique(np.concatenate([pairs, *(p for p, _ in waiting)]), return_inverse=True)
            return pairs, np.bincount(place, np.concatenate([counts, *(n for _, n in waiting)]), len(pairs)).astype(np.int64)

        for batch in batches:
            _, found, n = _flat(batch)
            waiting.append((found, n))
            size += len(found)
            if size >= MOST_PAIRS:
                (pairs, counts), waiting, size = merged(pairs, counts, waiting), [], 0
                if len(pairs) >= MOST_PAIRS:
                    yield pd.DataFrame({"pair": pairs, "count": counts})
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged(pairs, counts, waiting)
        yield pd.DataFrame({"pair": pairs, "count": counts})

    counted = frames(links.select("row", "link_a", "link_b", "link_n"), run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    pairs = stored(counted.select("pair", F.shiftright("pair", 16).cast("int").alias("link_a"), F.col("pair").bitwiseAND(65535).cast("int").alias("link_b"), "count"), "link-counts")
    # One row for each id of the second vocabulary: bounded by its size, a few hundred kilobytes.
    highest = F.broadcast(pairs.groupBy("link_b").agg(F.max("count").alias("highest")))
    return pairs.join(highest, "link_b").select("pair", "link_a", "link_b", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_sums(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` over all links of every row that has links."""
    counts = stored(counts, "link-best")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * HOT > F.lit(total)
    hot = counts.where(often).orderBy("pair").select("pair", "count", "best").toPandas()
    shared = links.sparkSession.sparkContext.broadcast([hot[c].to_numpy() for c in hot])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's sums over hot pairs (no pair, n 0), and one row for every other of its pairs."""
        pairs, often_n, best = shared.value
        for batch in batches:
            row, pair, n = _flat(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
            rows, place = np.unique(row[known], return_inverse=True)
            sums = np.zeros(len(rows), dtype=np.int64)
            bests = np.zeros(len(rows), dtype=np.int64)
            np.add.at(sums, place, n[known] * often_n[at[known]])
            np.add.at(bests, place, n[known] * best[at[known]].astype(np.int64))
            yield pd.DataFrame({"row": rows, "pair": pd.Series([None] * len(rows), dtype="Int64"), "n": 0, "n_best": bests, "count_sum": sums})
            yield pd.DataFrame({"row": row[~known], "pair": pd.Series(pair[~known], dtype="Int64"), "n": n[~known], "n_best": 0, "count_sum": 0})

    asked = stored(frames(links.select("row", "link_a", "link_b", "link_n"), run, "row long, pair long, n long, n_best long, count_sum long"), "link-rows")
    rare = asked.where("pair IS NOT NULL").select("row", "pair", "n").join(counts.where(~often).select("pair", "count", "best"), "pair")
    sums = rare.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    return sums.unionByName(asked.where("pair IS NULL").select("row", "n_best", "count_sum")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def scored(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Every document's groups and links, and how usual its links are in the whole corpus."""
    kept = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "link_a", "link_b", "link_n")
    # The row number is fixed by writing it down; ids may repeat or be null.
    found = stored(aligned(texts(docs).withColumn("row", F.monotonically_increasing_id()), kept, byte_path, piece_path), "alignments")
    sums = link_sums(found, link_counts(found))
    total = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return found.drop("link_a", "link_b", "link_n").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *total, "groups_sha256")
