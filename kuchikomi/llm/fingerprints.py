"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of every ``window`` consecutive hashes the smallest is selected,
the rightmost of equal ones, and its position is kept. Two texts that share any ``k + window - 1`` code points in a
row share a selected hash, and no shared run shorter than ``k`` is ever seen.

Edge cases: null texts count as empty and have an empty fingerprint; a text shorter than ``k`` is one run, a text with
fewer runs than a window is one window; two empty fingerprints are alike (1), an empty and another are not (0). The
next document follows by ascending id (null ids first, equal ids by text), and the first one follows the last. Texts of
any length are hashed whole; rows that repeat an id are documents of their own; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import dealt_by, frames, per_row, texts
from kuchikomi.session import shuffle_partitions

K = 8
WINDOW = 16
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class Winnower:
    def __init__(self, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse, np.uint64)]), dtype=np.uint64)

    def hashes(self, points: np.ndarray) -> np.ndarray:
        """32-bit hashes of all runs of k code points: differences of one running sum, scaled back to a common power."""
        n = len(points)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        k = min(self.k, n)
        self._powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        rolled = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        return rolled >> np.uint64(32)

    def select(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the selected runs."""
        hashes = self.hashes(points)
        n = len(hashes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        last = np.uint64(0xFFFFFFFF)
        # Smallest hash first; of equal hashes the larger position is the smaller key.
        keys = hashes << np.uint64(32) | (last - np.arange(n, dtype=np.uint64))
        width, span = min(self.window, n), 1
        least = keys
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return (last - (chosen & last)).astype(np.int64), (chosen >> np.uint64(32)).astype(np.uint32)


def written(positions: np.ndarray, hashes: np.ndarray) -> str:
    """The fingerprint as text: every selected position and hash, in order.

    A digit tells the bytes of a gap between positions; base64 of all gaps, then of all 32-bit hashes, follows.
    """
    if not len(positions):
        return ""
    gaps = np.diff(positions, prepend=0)
    width = 1 if gaps.max() < 256 else 4
    return str(width) + base64.b64encode(gaps.astype(f"<u{width}").tobytes() + hashes.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a written fingerprint."""
    if not fingerprint:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    width, data = int(fingerprint[0]), base64.b64decode(fingerprint[1:])
    cut = len(data) // (width + 4) * width
    return np.cumsum(np.frombuffer(data[:cut], f"<u{width}").astype(np.int64)), np.frombuffer(data[cut:], "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, positions, hashes`` of every whole text."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        winnower = Winnower(k, window)
        made = [winnower.select(code_points(t)) for t in batch.text]
        return pd.DataFrame({"doc_id": batch.doc_id, "positions": [m[0] for m in made], "hashes": [m[1].astype(np.int64) for m in made]})

    return per_row(texts(docs), run, "doc_id long, positions array<long>, hashes array<long>")


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """All rows in one shuffle, each bucket holding a range of ids in order, closed by the next bucket's first row.

    ``bucket, extra, doc_id, text``; the row marked ``extra`` only serves as successor. Ranges come from a sample
    of the ids; each bucket's least id, one row per bucket, tells which rows are needed in two buckets.
    """
    whole = texts(docs)
    n = shuffle_partitions(docs.sparkSession)
    cuts = sorted(set(whole.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) or []))
    bucket = F.size(F.filter(F.lit([int(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    nulls = F.col("doc_id").isNull()
    least = {r.bucket: (r.low, r.nulls) for r in whole.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("low"), F.count_if(nulls).alias("nulls")).collect()}
    order = sorted(least)
    before = dict(zip(order, [order[-1], *order[:-1]])) if order else {}
    firsts = {low: before[b] for b, (low, with_nulls) in least.items() if not with_nulls}
    extra = F.try_element_at(F.map_from_arrays(F.lit(list(firsts)), F.lit(list(firsts.values()))), F.col("doc_id")) if firsts else F.lit(None).cast("int")
    if order and least[order[0]][1]:
        extra = F.when(nulls, F.lit(before[order[0]])).otherwise(extra)
    copies = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("extra")), F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(True).alias("extra")))))
    spread = whole.select(F.explode(copies).alias("place"), "doc_id", "text").select("place.*", "doc_id", "text")
    return dealt_by(spread, "bucket", n).sortWithinPartitions("bucket", "extra", "doc_id", "text")


def compared(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint beside its edited text's, with their likeness and that to the next document's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        winnower = Winnower(k, window)
        held = None  # the row that waits for its successor
        bucket, closed = None, False
        out: list[tuple] = []
        for batch in batches:
            for b, extra, doc_id, text in zip(batch.bucket, batch.extra, batch.doc_id, batch.text):
                if b != bucket:
                    bucket, closed, held = b, False, None
                if closed:
                    continue  # rows that share the least id are sent along; the first of them is the successor
                points = code_points(text)
                own = winnower.select(points)
                if held is not None:
                    out.append(_row(winnower, *held, text, own))
                held, closed = (doc_id, text, own), bool(extra)
                if len(out) >= 256:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    return frames(in_order(docs), run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))


def _row(winnower: Winnower, doc_id, text: str, own: tuple, following: str, following_own: tuple) -> tuple:
    changed = edited(text, following)
    other = winnower.select(code_points(changed))
    return (
        None if doc_id is pd.NA else doc_id,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        written(*own),
        written(*other),
        likeness(own[1], other[1]),
        likeness(own[1], following_own[1]),
    )
