"""BPE encoding and decoding: speculate with greedy longest match, verify every adjacent pair, merge only what fails.

The new words of a batch get a proposal from the trie. A sequence of tokens is the vocabulary's own encoding exactly
if every adjacent pair is compatible, so all pairs of all proposals are checked together, column by column; words
with a failing pair are merged exactly. Decoding joins the tokens' names with blanks, as a file without a decoder asks.

Edge cases: null and empty texts have no ids and decode to an empty text; rows that repeat an id are encoded
each on its own; texts of any length are encoded whole; an empty table gives an empty result; ids unknown to the vocabulary
are an error when decoding. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kuchikomi.llm.rows import per_row, texts
from kuchikomi.llm.vocabulary import LONGEST_KEPT, Vocabulary, kept, shared_file

#: A generation of words, and one of pieces: half of what other memories hold, for each worker holds four.
MOST_KEPT = 100_000


class Encoder:
    def __init__(self, text: str, most_kept: int = MOST_KEPT):
        self.most_kept = most_kept
        self.vocabulary = v = Vocabulary(text)
        self.left = np.array([p[0] if p else -1 for p in v.parts], dtype=np.int64)
        self.right = np.array([p[1] if p else -1 for p in v.parts], dtype=np.int64)
        width = len(v.names)
        keys = np.array([a * width + b for a, b in v.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.pair, self.product = keys[order], np.fromiter(v.merged.values(), np.int64, len(keys))[order]
        names = {i: t for t, i in json.loads(text)["model"]["vocab"].items()} | {i: t for t, i in v.special.items()}
        self.names: list[str | None] = [names.get(i) for i in range(max(names) + 1)]
        # Ids of words and of blank-free pieces, each in two generations.
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.ids: list[dict[bytes, bytes]] = [{}, {}]
        self.token_id = v.token_id.astype("<u4")
        self.merged_words = 0

    def propose(self, symbols: list[int]) -> list[int]:
        """Greedy longest match."""
        child, token, _ = self.vocabulary.trie
        out, i, n = [], 0, len(symbols)
        while i < n:
            node, found, end, j = 0, -1, i, i
            while j < n and (node := child.get(node << 16 | symbols[j])) is not None:
                j += 1
                if token[node] >= 0:
                    found, end = token[node], j
            out.append(found)
            i = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.compatible`` for all pairs at once."""
        width, singles = len(self.vocabulary.names), self.vocabulary.singles
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), width), np.full(len(a), width)
        fine = np.ones(len(a), dtype=bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y, ux, uy = a[open_], b[open_], until_a[open_], until_b[open_]
            key = x * width + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            m = np.where(self.pair[at] == key, self.product[at], width)
            fails = (m < ux) & (m <= uy)
            fine[open_[fails]] = False
            back_a = (x > y) & (x >= singles) & ~fails
            back_b = ~back_a & (y >= singles) & ~fails
            until_a[open_[back_a]], a[open_[back_a]] = x[back_a], self.right[x[back_a]]
            until_b[open_[back_b]], b[open_[back_b]] = y[back_b], self.left[y[back_b]]
            open_ = open_[back_a | back_b]
        return fine

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word's encoding."""
        spelled = [self.vocabulary.symbols(w) for w in words]
        proposals = [self.propose(s) for s in spelled]
        sizes = np.array([len(p) for p in proposals], dtype=np.int64)
        flat = np.array([t for p in proposals for t in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[:-1] == owner[1:]
        fine = self.compatible(flat[:-1][inside], flat[1:][inside])
        for w in np.unique(owner[:-1][inside][~fine]):
            proposals[w] = self.vocabulary.merge(spelled[w])
            self.merged_words += 1
        return proposals

    def learn_words(self, words: set[str]) -> None:
        new, old = self.words
        new.update({w: old[w] for w in words if w in old})
        fresh = [w for w in words if w not in new]
        for word, symbols in zip(fresh, self.encode_words(fresh) if fresh else ()):
            new[word] = self.token_id[symbols].tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        """Remember blank-free pieces; their words are proposed, verified and merged together."""
        new, old = self.ids
        new.update({c: old[c] for c in chunks if c in old})
        pieces = {c: self.vocabulary.pieces(c) for c in chunks if c not in new}
        known = self.words[0]
        self.learn_words({p for ps in pieces.values() for p in ps if isinstance(p, str) and p not in known})
        for chunk, ps in pieces.items():
            new[chunk] = b"".join([known[p] if isinstance(p, str) else np.array(p, "<u4").tobytes() for p in ps])

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids of every value; new pieces are learnt many texts at a time, so checks run on many pairs."""
        out = []
        for i in range(0, len(values), 64):
            split = [v.encode("utf-8", "replace").split() for v in values[i : i + 64]]
            for memory in (self.words, self.ids):
                if len(memory[0]) > self.most_kept:
                    memory[:] = [{}, memory[0]]
            ids = self.ids[0]
            missing = {c for chunks in split for c in chunks if c not in ids}
            self.learn(missing)
            out.extend(b"".join(map(ids.__getitem__, chunks)) for chunks in split)
            for c in missing:
                if len(c) > LONGEST_KEPT:
                    del ids[c]
        return out


RESULT = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id", "ids", "decoded"), most_kept: int = MOST_KEPT) -> DataFrame:
    """The chosen columns of ``RESULT`` for every whole text; ``ids`` are little-endian unsigned 32-bit integers.

    Only what is chosen leaves the task, so digests can be had without moving ids or decoded texts. ``most_kept`` bounds what
    a worker remembers, never what is encoded.
    """
    shared = shared_file(docs.sparkSession, path)
    kinds = dict(c.split() for c in RESULT.split(", "))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        encoder = kept(shared, "encoder", lambda text: Encoder(text, most_kept))
        ids = encoder.encode(batch.text.tolist())
        whole = {
            "doc_id": lambda: batch.doc_id,
            "n_tokens": lambda: [len(i) // 4 for i in ids],
            "ids": lambda: ids,
            "ids_sha256": lambda: [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded": lambda: [encoder.decode(i) for i in ids],
            "decoded_sha256": lambda: [hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids],
        }
        return pd.DataFrame({c: whole[c]() for c in columns})

    return per_row(texts(docs), run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``."""
    shared = shared_file(encodings.sparkSession, path)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        encoder = kept(shared, "encoder", Encoder)
        return pd.DataFrame({"doc_id": batch.doc_id, "decoded": [encoder.decode(i or b"") for i in batch.ids]})

    return per_row(encodings.select("doc_id", "ids"), run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the decoded text."""
    return encoded(docs, path, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
