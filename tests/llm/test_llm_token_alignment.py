from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kuchikomi.llm import token_alignment
from kuchikomi.llm.vocabulary import byte_names
from tests.llm.cases import awkward, documents, empty, sentence


class Libraries:
    """Both libraries on whole texts, and plain loops."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        value = {c: b for b, c in byte_names().items()}
        self.spell_a = lambda i: bytes(value[c] for c in self.a.id_to_token(i))

    def spell_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def sides(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        return (a, b) if b"".join(map(self.spell_a, a)) == raw == b"".join(map(self.spell_b, b)) else ([], [])

    def groups(self, text):
        a, b = self.sides(text)
        ends_a, ends_b = (np.cumsum([len(s(i)) for i in v]).tolist() if v else [] for v, s in ((a, self.spell_a), (b, self.spell_b)))
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


ODD = [
    None, "", " ", "  ", "\n", " \n a", "a  b   c    d ", "\ta\tb", "a b  c", "<|endoftext|> and <s>x</s> <unk>", "▁x", "a▁ b", "don't we'll I'M", "x\x1cy \x1c z",
    "数据 数据清洗", "😀 👩‍👩‍👧 é é", "　x  y", "1234567 89,000.5", "a\x00b", "ſtraße İ", "http://x.y/z?q=1&r=2", "a" * 700, " " * 300, "ab " * 400, "\r\n\r\nx", "end ", "ஹ் x", "a ́b",
]


def corpus():
    rng = random.Random(8)
    return ODD + [sentence(rng, rng.randint(0, 60)) + rng.choice(["", ".", "\n", " !?", " Été"]) for _ in range(120)]


def test_gallop_finds_what_binary_search_finds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        longer = np.unique(rng.integers(0, 400, rng.integers(0, 120)))
        driver = np.unique(rng.integers(-5, 410, rng.integers(0, 60)))
        low, high = np.zeros(len(driver), np.int64), np.full(len(driver), len(longer))
        for hint in (low, high, rng.integers(-3, 130, len(driver))):
            assert token_alignment.gallop(driver, longer, low, high, hint).tolist() == np.searchsorted(longer, driver).tolist()


def test_common_ends_and_overlaps_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(60):
        docs = []
        for _ in range(int(rng.integers(0, 6))):
            n = int(rng.integers(0, 50))
            sides = [np.unique(np.append(rng.integers(1, n, int(rng.integers(0, n))), n)) if n > 1 else np.arange(n) + 1 for _ in "ab"]
            docs.append(sides)
        start, a, b, want = 0, [], [], []
        for x, y in docs:
            want += [(len(a) + i, len(b) + y.tolist().index(e)) for i, e in enumerate(x.tolist()) if e in y]
            a, b = a + (x + start).tolist(), b + (y + start).tolist()
            start += int(x[-1]) if len(x) else 0
            if len(x):
                first, last = token_alignment.overlaps(x, y)
                begin_x, begin_y = np.append(0, x[:-1]), np.append(0, y[:-1])
                for i in range(len(x)):
                    own = [j for j in range(len(y)) if begin_y[j] < x[i] and y[j] > begin_x[i]]
                    assert (first[i], last[i]) == (own[0], own[-1])
        sizes = [np.array([len(d[k]) for d in docs], dtype=np.int64) for k in (0, 1)]
        ia, ib = token_alignment.common_ends(np.array(a, np.int64), np.array(b, np.int64), *sizes)
        assert list(zip(ia.tolist(), ib.tolist())) == want


def test_groups_are_those_of_the_libraries(spark, libraries):
    values = corpus()
    rows = token_alignment.aligned(documents(spark, values), ("doc_id", "groups", "a_ids", "b_ids", "a_cuts", "b_cuts", "first_b", "last_b")).collect()
    for r in rows:
        groups = libraries.groups(values[r.doc_id])
        assert r.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups), repr(values[r.doc_id])
        assert (r.a_ids, r.b_ids) == libraries.sides(values[r.doc_id])
        assert [r.a_ids[i] for i in r.a_cuts] == [a[-1] for a, _ in groups]
        assert len(r.first_b) == len(r.last_b) == len(r.a_ids)


@pytest.mark.parametrize("hot", [1, 40, 1 << 17])
def test_counts_are_those_of_plain_loops(spark, libraries, monkeypatch, hot):
    """The same figures whether many pairs, some or none travel by broadcast."""
    monkeypatch.setattr(token_alignment, "HOT", hot)
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 500)
    values = corpus() + ["the same text", "the same text"]
    docs = documents(spark, values)
    docs = docs.unionByName(docs.limit(0)).unionByName(documents(spark, ["the same text", "again"], first=7)).repartition(5)
    texts = [(i, t) for i, t in enumerate(values)] + [(7, "the same text"), (8, "again")]
    groups = [(i, libraries.groups(t)) for i, t in texts]
    counts = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for i, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        string = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append(
            (
                i,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                len(links),
                sum(counts[p] == highest[p[1]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(string.encode()).hexdigest() if g else "",
            )
        )
    rows = token_alignment.scored(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_long_text_and_awkward_rows(spark, libraries):
    long = "\n".join(["thing of reeaha ti onionic" * 3 + " été 数据"] * 12_000)
    row = token_alignment.scored(documents(spark, [long, "z" * 200_000])).orderBy("doc_id").collect()[0]
    a, b = libraries.sides(long)
    assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_links == row.n_groups > 10_000
    rows = token_alignment.scored(awkward(spark)).collect()
    assert len(rows) == 12
    assert [tuple(r)[1:] for r in rows if r.doc_id in (3, 4, 10)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (7, 8)}) == 1
    assert token_alignment.scored(empty(spark)).collect() == []
