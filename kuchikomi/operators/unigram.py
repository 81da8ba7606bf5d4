"""Subword vocabulary by likelihood, and the best segmentation of texts with it.

A unigram model gives every piece a probability; a script run is as likely as all its segmentations together. Training is
expectation-maximisation over distinct runs, each weighted by its occurrences: a pass over the runs sums, for every piece,
the expected number of its uses (forward and backward sums over the run's lattice), and the sums are the next
probabilities. Between rounds the pieces whose loss costs the least likelihood are dropped until the size is reached.
The pieces, bounded by the size of the seed, travel to the tasks; runs stay where they are.

Segmentation takes, for each run, the most likely path through the lattice. Characters the vocabulary doesn't have are kept
as pieces of their own with the unknown id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kuchikomi.domain import SPECIAL_PIECES, SUBWORD_VOCABULARY, UNKNOWN_ID
from kuchikomi.functions.tokens import SEGMENT
from kuchikomi.operators.vocabulary import MAX_PIECE_CHARS, segments, train_vocabulary

SEED_TIMES, ROUNDS, KEPT_SHARE = 4, 2, 0.75
UNKNOWN_COST = 10.0
RUNS_KEPT = 100_000
#: Characters that are laid out in arrays together, at least ``FEW`` texts of them.
CELLS, FEW = 1 << 17, 8


class Lattice:
    """All ways to cut a text into pieces; ``scores`` are logarithms of probabilities."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_COST

    def ending(self, text: str, end: int) -> list[tuple[int, float]]:
        """Start and score of the pieces that end at ``end``; a character of no piece is one by itself."""
        scores = self.scores
        found = [(i, s) for i in range(max(0, end - self.longest), end) if (s := scores.get(text[i:end])) is not None]
        if text[end - 1] not in scores:
            found.append((end - 1, self.unknown))
        return found

    def uses(self, text: str) -> tuple[float, dict[str, float]]:
        """The logarithm of the text's probability, and how often each piece is used on average over its segmentations."""
        n = len(text)
        edges = [self.ending(text, j) for j in range(1, n + 1)]
        before, after = [0.0] * (n + 1), [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            before[j] = _log_sum([before[i] + s for i, s in edges[j - 1]])
        for j in range(n, 0, -1):
            for i, s in edges[j - 1]:
                after[i] = _log_sum([after[i], s + after[j]])
        out: dict[str, float] = {}
        for j in range(1, n + 1):
            for i, s in edges[j - 1]:
                out[text[i:j]] = out.get(text[i:j], 0.0) + math.exp(before[i] + s + after[j] - before[n])
        return before[n], out

    def best(self, text: str, without: str | None = None) -> tuple[float, list[str]]:
        """The most likely segmentation; of equally likely ones that of the longest last piece."""
        score, start = [0.0], [0]
        for j in range(1, len(text) + 1):
            options = [(score[i] + s, i) for i, s in self.ending(text, j) if text[i:j] != without]
            top = max(options, key=lambda o: (o[0], -o[1]), default=(-math.inf, j - 1))
            score.append(top[0])
            start.append(top[1])
        pieces, j = [], len(text)
        while j:
            pieces.append(text[start[j] : j])
            j = start[j]
        return score[-1], pieces[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum([math.exp(v - top) for v in values]))


def _log_sums(values: list[np.ndarray]) -> np.ndarray:
    """``_log_sum`` of every column; a single character is always an edge, so no column is all minus infinity."""
    top = np.maximum.reduce(values)
    return top + np.log(sum(np.exp(v - top) for v in values))


class Trie:
    """The same lattice for many texts at once: texts of one length are columns of arrays, and a piece is a path of characters."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.unknown, self.longest = lattice, lattice.unknown, lattice.longest
        self.pieces = list(lattice.scores)
        self.number = {piece: number for number, piece in enumerate(self.pieces)}
        children: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for char in map(ord, piece):
                if (node, char) not in children:
                    children[node, char] = len(self.piece)
                    self.piece.append(-1)
                node = children[node, char]
            self.piece[node] = number
        keys = np.array([node << 21 | char for node, char in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)  # a last key that no character makes
        self.child = np.append(np.fromiter(children.values(), np.int64, len(children))[order], 0)
        self.piece = np.array(self.piece, dtype=np.int64)
        self.score = np.array([*lattice.scores.values(), self.unknown])

    def edges(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1, the flat places where pieces of that length start, and their numbers; a single unknown
        character has the number after the last piece."""
        (n, rows), flat, out = chars.shape, chars.ravel(), []
        at, node = np.arange(n * rows), np.zeros(n * rows, dtype=np.int64)
        for size in range(1, min(self.longest, n) + 1):
            inside = np.searchsorted(at, (n - size + 1) * rows)
            at, key = at[:inside], node[:inside] << 21 | flat[at[:inside] + (size - 1) * rows]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            node = self.child[place]
            piece = np.where(found, self.piece[node], -1)
            if size == 1:
                out.append((at, np.where(piece < 0, len(self.pieces), piece)))
            else:
                out.append((at[piece >= 0], piece[piece >= 0]))
            at, node = at[found], node[found]
        return out

    def sums(self, texts: list[str], weights: list[float]) -> tuple[float, dict[str, float]]:
        """The weighted sum of the texts' log likelihoods, and of the expected uses of every known piece."""
        total, uses = 0.0, np.zeros(len(self.pieces) + 1)
        by_length: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            by_length.setdefault(len(text), []).append(i)
        by_length.pop(0, None)
        for n, places in by_length.items():
            if len(places) < FEW:  # arrays of so few columns take longer than one text after the other
                for i in places:
                    likelihood, found = self.lattice.uses(texts[i])
                    total += weights[i] * likelihood
                    for piece, share in found.items():
                        uses[self.number.get(piece, -1)] += weights[i] * share
                continue
            step = max(CELLS // n, FEW)
            for a in range(0, len(places), step):
                part = places[a : a + step]
                chars = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, n).T.copy()
                weight = np.array([weights[i] for i in part], dtype=np.float64)
                total += self._add(chars, weight, uses)
        return total, dict(zip(self.pieces, uses.tolist()))

    def _add(self, chars: np.ndarray, weight: np.ndarray, uses: np.ndarray) -> float:
        n, rows = chars.shape
        edges = self.edges(chars)
        scores = []
        for size, (at, piece) in enumerate(edges, 1):
            score = np.full((n - size + 1) * rows, -np.inf)
            score[at] = self.score[piece]
            scores.append(score.reshape(-1, rows))
        before, after = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
        for j in range(1, n + 1):
            before[j] = _log_sums([before[j - k] + scores[k - 1][j - k] for k in range(1, min(j, len(edges)) + 1)])
        for i in range(n - 1, -1, -1):
            after[i] = _log_sums([after[i + k] + scores[k - 1][i] for k in range(1, min(n - i, len(edges)) + 1)])
        start, rest, whole = before.ravel(), after.ravel(), before[n]
        for size, (at, piece) in enumerate(edges, 1):
            row = at % rows
            share = np.exp(start[at] + self.score[piece] + rest[at + size * rows] - whole[row]) * weight[row]
            uses += np.bincount(piece, share, len(uses))
        return float(before[n] @ weight)


def expected_uses(runs: DataFrame, scores: dict[str, float]) -> tuple[float, dict[str, float]]:
    """One pass over ``(segment, n)``: the corpus' log likelihood and the expected uses of every known piece."""
    shared = runs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total, sums = Trie(Lattice(shared.value)), 0.0, {}
        for batch in batches:
            known = [(text, n) for text, n in zip(batch.column("segment").to_pylist(), batch.column("n").to_pylist()) if text]
            likelihood, uses = trie.sums([text for text, _ in known], [n for _, n in known])
            total += likelihood
            for piece, n in uses.items():
                if n:
                    sums[piece] = sums.get(piece, 0.0) + n
        yield pa.RecordBatch.from_pydict({"piece": pa.array([None, *sums], pa.string()), "uses": pa.array([total, *sums.values()], pa.float64())})

    summed = runs.select("segment", "n").mapInArrow(run, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    found = {r.piece: r.uses for r in summed.collect()}  # one row for each piece
    return found.pop(None, 0.0), found


def _scored(uses: dict[str, float], kept: set[str]) -> dict[str, float]:
    """The probabilities under which the uses are most likely; a character is never given up."""
    least = 1e-6
    counted = {p: max(uses.get(p, 0.0), least) for p in kept if len(p) == 1 or uses.get(p, 0.0) > least}
    total = math.log(sum(counted.values())) if counted else 0.0
    return {p: math.log(n) - total for p, n in counted.items()}


def pruned(scores: dict[str, float], uses: dict[str, float], size: int) -> set[str]:
    """All characters and the longer pieces, up to ``size`` together, whose uses would cost most if they were cut up."""
    lattice = Lattice(scores)
    chars = {p for p in scores if len(p) == 1}
    loss = {p: uses.get(p, 0.0) * (scores[p] - lattice.best(p, without=p)[0]) for p in scores.keys() - chars}
    ranked = sorted(loss, key=lambda p: (-loss[p], p))
    return chars | set(ranked[: max(size - len(chars), 0)])


def train_unigram(
    texts: DataFrame, column: str, size: int = SUBWORD_VOCABULARY, max_chars: int = MAX_PIECE_CHARS, rounds: int = ROUNDS
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """``(id, piece, score)`` with the special pieces first, and for each round the number of pieces and the log likelihood.

    The seed is the counted vocabulary of ``SEED_TIMES`` the size. Every character of the corpus is kept, so the table
    exceeds ``size`` if there are more of them. Within one number of pieces the likelihood never falls.
    """
    spark, room = texts.sparkSession, size - len(SPECIAL_PIECES)
    runs = segments(texts, column).persist()
    seed = train_vocabulary(texts, column, SEED_TIMES * size, max_chars).where("n > 0").collect()  # bounded by the parameter
    total = sum(r.n for r in seed) or 1
    scores = {r.piece: math.log(r.n / total) for r in seed}
    history = []
    try:
        while True:
            last = len(scores) <= max(room, sum(len(p) == 1 for p in scores))
            for _ in range(rounds):
                likelihood, uses = expected_uses(runs, scores)
                history.append((len(scores), likelihood))
                scores = _scored(uses, set(scores))
            if last:
                break
            scores = _scored(uses, pruned(scores, uses, max(room, int(KEPT_SHARE * len(scores)))))
    finally:
        runs.unpersist()
    ordered = sorted(scores, key=lambda p: (-scores[p], p))
    rows = [(i, p, 0.0) for i, p in enumerate(SPECIAL_PIECES)] + [(i, p, scores[p]) for i, p in enumerate(ordered, len(SPECIAL_PIECES))]
    return spark.createDataFrame(rows, "id int, piece string, score double"), history


def segmented(df: DataFrame, column: str, vocabulary: DataFrame, prefix: str = "subword") -> DataFrame:
    """Add ``<prefix>_pieces`` and ``<prefix>_ids``: the most likely segmentation of each script run of the text.

    The pieces of a text joined together are the text; a null text has none. A task cuts each distinct run once, as long
    as it remembers it.
    """
    known = {r.piece: (r.id, r.score) for r in vocabulary.where(F.col("id") >= len(SPECIAL_PIECES)).collect()}  # bounded by the size
    shared = df.sparkSession.sparkContext.broadcast(known)
    runs, pieces, ids = f"_{prefix}_runs", f"{prefix}_pieces", f"{prefix}_ids"
    cut = df.withColumn(runs, F.regexp_extract_all(column, F.lit(SEGMENT), F.lit(0)))
    schema = T.StructType([*df.schema.fields, T.StructField(pieces, T.ArrayType(T.StringType())), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow, columns = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        lattice, seen = Lattice({p: s for p, (_, s) in table.items()}), {}

        def best(text: str) -> list[str]:
            if text not in seen:
                if len(seen) >= RUNS_KEPT:
                    seen.clear()
                seen[text] = lattice.best(text)[1]
            return seen[text]

        for batch in batches:
            found = [None if r is None else [p for text in r for p in best(text)] for r in batch.column(runs).to_pylist()]
            numbers = [None if f is None else [table[p][0] if p in table else UNKNOWN_ID for p in f] for f in found]
            made = [pa.array(found, arrow.field(pieces).type), pa.array(numbers, arrow.field(ids).type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], schema=arrow)

    return cut.mapInArrow(run, schema)
