"""A byte-level BPE vocabulary file as tables: merges in order, splits, and the texts' pieces that merge alone.

The file's own normalizer and pre-tokenizer (run by the tokenizers library on single pieces) cut words; what happens
inside a word is up to the operators built on these tables.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import SparkSession

#: Pieces longer than this are not remembered, and a generation of a memory holds this many.
LONGEST_KEPT, MOST_KEPT = 64, 200_000
#: Words of letters, single numbers, other runs: the file's pattern, for lower-case texts below U+0250 without controls.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
CONTROLS = re.compile(r"[\x00-\x1f\x7f-\x84\x86-\x9f\xad]")


def byte_names() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """What was made of short keys: two generations, so what keeps coming back outlives what came once."""

    def __init__(self, make: Callable, most: int = MOST_KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_file(spark: SparkSession, path: str | None = None):
    """The vocabulary file, of fixed size, as a broadcast; its dict also keeps what a worker has built from it."""
    with open(path or default_path(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"json": file.read()})


def kept(shared, name: str, build):
    """``build(json)`` once per worker process, however many tasks it runs."""
    if name not in shared.value:
        shared.value[name] = build(shared.value["json"])
    return shared.value[name]


def _library(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


class Vocabulary:
    """Symbols are numbered by birth: single ones first, then every merge's product in order of priority."""

    def __init__(self, text: str):
        self.text = text
        data = json.loads(text)
        model = data["model"]
        if model["type"] != "BPE" or data.get("decoder") is not None or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain BPE files without a decoder are supported")
        # Normalizer and pre-tokenizer alone, for the library's own tables are several times as large as those made here.
        bare = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
        self.cutter = _library(json.dumps(data | bare))
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        products = {a + b for a, b in merges}
        if len(products) != len(merges):
            raise ValueError("two merges make the same token")
        singles = sorted((t for t in model["vocab"] if t not in products), key=model["vocab"].get)
        self.names = singles + [a + b for a, b in merges]
        self.singles = len(singles)
        self.number = {t: i for i, t in enumerate(self.names)}
        self.token_id = np.array([model["vocab"][t] for t in self.names], dtype=np.uint32)
        self.parts = [None] * self.singles + [(self.number[a], self.number[b]) for a, b in merges]
        self.merged = {p: i for i, p in enumerate(self.parts) if p is not None}
        self.bytes = byte_names()
        # The short way holds for files that lower-case, compose and cut like this one; others are cut by the library.
        cuts = [c.get("pattern", {}).get("Regex") for c in (data.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])]
        self.plain = cuts[:1] == [PATTERN] and kinds == ["NFC", "Replace", "Lowercase"] and all(t.startswith("<|") for t in (a["content"] for a in data["added_tokens"]))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # -- words

    def pieces(self, chunk: bytes) -> list[str | int]:
        """The words of a text without ASCII blanks, as the file cuts them; a special token is given as its id."""
        text = chunk.decode("utf-8", "replace")
        if self.plain and text.isascii() and "<|" not in text and text.isprintable():
            return [text.lower()] if text.isalpha() else PLAIN.findall(text.lower())
        if self.plain and "<|" not in text and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if max(low) < "\u0250" and not CONTROLS.search(low):
                return [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in PLAIN.findall(low)]
        out: list[str | int] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(word for word, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(part)))
        return out

    @cached_property
    def library(self):
        """The whole file as the library reads it, for those that encode with it."""
        library = _library(self.text)
        library.no_truncation()
        library.no_padding()
        return library

    def symbols(self, word: str) -> list[int]:
        number = self.number
        return [number[c] for c in word[:-1]] + [number[word[-1] + self.suffix]]

    # -- merging

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the earliest merge, leftmost first."""
        n = len(symbols)
        if n <= 64:
            return self._merge_short(list(symbols))
        symbols, following, previous = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        merged = self.merged
        queue = [(m, i) for i in range(n - 1) if (m := merged.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            m, i = heapq.heappop(queue)
            j = following[i]
            if symbols[i] < 0 or j >= n or merged.get((symbols[i], symbols[j])) != m:
                continue
            symbols[i], symbols[j] = m, -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (right := merged.get((m, symbols[k]))) is not None:
                    heapq.heappush(queue, (right, i))
            if (h := previous[i]) >= 0 and (left := merged.get((symbols[h], m))) is not None:
                heapq.heappush(queue, (left, h))
        return [s for s in symbols if s >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """The same by scanning all pairs, which is faster for a word than a queue."""
        get, never = self.merged.get, len(self.names)
        due = [get(pair, never) for pair in zip(symbols, symbols[1:])]
        while due and (m := min(due)) < never:
            i = due.index(m)
            symbols[i : i + 2] = [m]
            del due[i]
            if i < len(due):
                due[i] = get((m, symbols[i + 1]), never)
            if i:
                due[i - 1] = get((symbols[i - 1], m), never)
        return symbols

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether merging the symbols of both tokens together leaves the border between them in place.

        Goes back in time: the piece born last on either side of the border is taken apart again, and at each
        moment the two pieces that touch must not merge before either is swallowed by its own token. Of equal
        births the left one was first.
        """
        until_a = until_b = len(self.names) if limit is None else limit
        merged, parts, singles = self.merged, self.parts, self.singles
        while True:
            m = merged.get((a, b))
            if m is not None and m < until_a and m <= until_b:
                return False
            if a > b and a >= singles:
                until_a, a = a, parts[a][1]
            elif b >= singles:
                until_b, b = b, parts[b][0]
            else:
                return True

    @cached_property
    def trie(self) -> tuple[dict[int, int], list[int], list[bool]]:
        """Paths of all tokens that their own symbols merge into: child by ``node << 16 | symbol``, token, has children."""
        spelled: list[tuple[int, ...]] = []
        sound: list[bool] = []
        child: dict[int, int] = {}
        token, inner = [-1], [True]
        for i, parts in enumerate(self.parts):
            spelled.append((i,) if parts is None else spelled[parts[0]] + spelled[parts[1]])
            sound.append(parts is None or sound[parts[0]] and sound[parts[1]] and self.compatible(*parts, limit=i))
            if not sound[i]:
                continue
            node = 0
            for s in spelled[i]:
                key = node << 16 | s
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                    inner.append(False)
                    inner[node] = True
                node = child[key]
            token[node] = i
        return child, token, inner
