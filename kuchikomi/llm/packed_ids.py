"""Token ids as files of patched frame-of-reference blocks.

A file's rows are segments, each a run of whole documents in ascending id order: their ids and lengths, the position
of the first token within the part, and one blob. A blob holds blocks of 128 values. A block stores its minimum; the
differences are packed at the bit width that nine in ten of them need, and what is wider goes to an exception list
as (place, high bits). An index of block starts gives access to any block without reading the others. Spark's
Parquet writer carries the segments, so files appear whole or not at all, wherever the shared folder lies.

Edge cases: null and empty texts are one end token; equal ids are ordered by text; null ids come first; an empty
table writes no segment and reads back as no rows; a text of any length is one run of blocks; rows that repeat an id are
documents of their own. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kuchikomi.llm.rows import frames, stored, texts
from kuchikomi.llm.vocabulary import Memory, Vocabulary, kept, shared_file
from kuchikomi.session import shuffle_partitions

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
HEAD = "<4sQII"
MAGIC = b"PFR1"
END_ID = 1
BYTES_AT_ONCE = 1 << 22
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))


def pack(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A blob: head, index (start in 64-bit words, minimum, width, exceptions of each block), payload, exceptions."""
    values = np.asarray(values, dtype=np.uint32)
    n = len(values)
    blocks = -(-n // BLOCK)
    rows = np.concatenate([values, np.repeat(values[-1:], blocks * BLOCK - n)]).reshape(blocks, BLOCK).astype(np.uint64)
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint64)
    rows = rows - least[:, None]
    bits = np.frexp(rows.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    outlier_row, outlier_at = np.nonzero(bits > width[:, None])
    high = (rows[outlier_row, outlier_at] >> width[outlier_row].astype(np.uint64)).astype(np.uint32)
    sizes = 2 * width.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for w in np.unique(width):
        if w == 0:
            continue
        chosen = np.nonzero(width == w)[0]
        lanes = (rows[chosen] & np.uint64((1 << int(w)) - 1)).T.copy()
        words = np.zeros((2 * int(w), len(chosen)), dtype=np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * int(w), 64)
            words[word] |= lanes[j] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
        payload[starts[chosen][:, None] + np.arange(2 * int(w))] = words.T
    patches = np.bincount(outlier_row, minlength=blocks).astype(np.uint8)
    index = starts.astype("<u4").tobytes() + least.astype("<u4").tobytes() + width.tobytes() + patches.tobytes()
    return struct.pack(HEAD, MAGIC, n, blocks, len(high)) + index + payload.astype("<u8").tobytes() + outlier_at.astype(np.uint8).tobytes() + high.astype("<u4").tobytes()


def unpack(blob: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of blocks ``first_block`` to ``last_block`` (exclusive; default: all), found by the index."""
    magic, n, blocks, patched = struct.unpack_from(HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a block file")
    at = struct.calcsize(HEAD)
    starts = np.frombuffer(blob, "<u4", blocks, at).astype(np.int64)
    least = np.frombuffer(blob, "<u4", blocks, at + 4 * blocks)
    width = np.frombuffer(blob, np.uint8, blocks, at + 8 * blocks)
    patches = np.frombuffer(blob, np.uint8, blocks, at + 9 * blocks).astype(np.int64)
    at += 10 * blocks
    words_total = int((2 * width.astype(np.int64)).sum())
    payload = np.frombuffer(blob, "<u8", words_total, at)
    places = np.frombuffer(blob, np.uint8, patched, at + 8 * words_total)
    high = np.frombuffer(blob, "<u4", patched, at + 8 * words_total + patched).astype(np.uint64)
    stop = blocks if last_block is None else min(last_block, blocks)
    wanted = np.arange(min(first_block, stop), stop)
    out = np.zeros((len(wanted), BLOCK), dtype=np.uint64)
    for w in np.unique(width[wanted]):
        if w == 0:
            continue
        chosen = np.nonzero(width[wanted] == w)[0]
        words = payload[starts[wanted[chosen]][:, None] + np.arange(2 * int(w))].T.copy()
        mask = np.uint64((1 << int(w)) - 1)
        lanes = np.empty((BLOCK, len(chosen)), dtype=np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * int(w), 64)
            lane = words[word] >> np.uint64(shift)
            if shift + w > 64:
                lane = lane | (words[word + 1] << np.uint64(64 - shift))
            lanes[j] = lane & mask
        out[chosen] = lanes.T
    before = np.cumsum(patches) - patches
    if len(wanted):
        a, b = int(before[wanted[0]]), int(before[wanted[-1]] + patches[wanted[-1]])
        row = np.repeat(np.arange(len(wanted)), patches[wanted])
        out[row, places[a:b]] |= high[a:b] << width[wanted][row].astype(np.uint64)
    values = (out + least[wanted][:, None]).astype(np.uint32).reshape(-1)
    return values[: max(0, min(n - int(wanted[0]) * BLOCK, len(values)))] if len(wanted) else values


class LibraryEncoder:
    """The tokenizers library, asked once for each word that keeps coming back."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.words = Memory(self._word, 300_000)
        self.chunks = Memory(self._chunk, 300_000)

    def _word(self, word: str) -> bytes:
        tokens = self.vocabulary.library.model.tokenize(word)
        return array("I", [t.id for t in tokens]).tobytes() if len(tokens) != 1 else tokens[0].id.to_bytes(4, sys.byteorder)

    def _chunk(self, chunk: bytes) -> bytes:
        if self.vocabulary.plain:  # ASCII letters, also before one mark, need no pattern
            if chunk.isalpha():
                return self.words[chunk.lower().decode()]
            if chunk[-1:] in MARKS and chunk[:-1].isalpha():
                return self.words[chunk[:-1].lower().decode()] + self.words[chunk[-1:].decode()]
        return b"".join([array("I", [p]).tobytes() if isinstance(p, int) else self.words[p] for p in self.vocabulary.pieces(chunk)])

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids in the machine's own order, 32 bits each; texts are taken together up to ``BYTES_AT_ONCE``, the longest alone."""
        raw, out = [v.encode("utf-8", "replace") for v in values], []
        for a, b in _parts([len(r) for r in raw]):
            out.extend(self._encode(raw[a:b]))
        return out

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        """Each distinct chunk of all texts is looked up once; the ids are gathered by its number."""
        split = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).view(pa.large_string()))
        ends = np.asarray(split.offsets, dtype=np.int64)
        coded = split.values.dictionary_encode()
        found = list(map(self.chunks.__getitem__, coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        chunk = coded.indices.to_numpy()
        n = sizes[chunk]
        stops = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[chunk] - (stops - n), n)
        data = flat[place + np.arange(len(place))].tobytes()
        bounds = (4 * np.concatenate([[0], stops])[ends]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``BYTES_AT_ONCE`` together, one at least in each."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held + size > BYTES_AT_ONCE and i > first:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all texts' ids, each document's closed by ``end_id``; returns the files as read back.

    One shuffle by ranges of the id puts documents in order; parts follow the ranges.
    """
    shared = shared_file(docs.sparkSession, path)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept(shared, "library", LibraryEncoder)
        part, segment, first, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        held: list[bytes] = []

        def flush() -> pd.DataFrame:
            lengths = np.array([len(h) // 4 for h in held], dtype=np.uint32)
            blob = pack(np.frombuffer(b"".join(held), np.uint32))
            return pd.DataFrame({"part": [part], "segment": [segment], "first": [first], "n_ids": [size], "doc_ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "unnamed": [[k for k, i in enumerate(ids) if i is None]], "lengths": [lengths.tobytes()], "blocks": [blob]})

        for batch in batches:
            for doc_id, made in zip(batch.doc_id, encoder.encode(batch.text.tolist())):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                held.append(made + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield flush()
                    segment, first, size, ids, held = segment + 1, first + size, 0, [], []
        if held:
            yield flush()

    ordered = texts(docs).repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    segments = frames(ordered, run, "part int, segment int, first long, n_ids long, doc_ids binary, unnamed array<int>, lengths binary, blocks binary")
    return stored(segments, "token-ids")


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``ids`` are little-endian unsigned 32-bit integers."""
    return _documents(files, "ids binary", lambda ids: ids)


def _documents(files: DataFrame, column: str, shown) -> DataFrame:
    # One row per part, of which there are as many as shuffle partitions.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    placed = files.join(F.broadcast(offsets), "part").withColumn("first", F.col("offset") + F.col("first"))
    name = column.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                data = unpack(row.blocks).astype("<u4").tobytes()
                values = [shown(data[4 * a : 4 * (a + n)]) for a, n in zip(starts, lengths)]
                doc_ids = pd.array(np.frombuffer(row.doc_ids, "<i8").copy(), dtype="Int64")
                doc_ids[np.asarray(row.unnamed, dtype=np.int64)] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": starts + int(row.first), "n_tokens": lengths, name: values})

    return frames(placed.select("first", "doc_ids", "unnamed", "lengths", "blocks"), run, f"doc_id long, start long, n_tokens long, {column}")


def file_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files and read them back as place, length and checksum of each document's ids."""
    return _documents(write(docs, path), "ids_crc32 long", zlib.crc32)
