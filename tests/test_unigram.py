from __future__ import annotations

import math
import random

import pytest

from kuchikomi.operators import unigram, vocabulary


def cuts(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in cuts(text[i:]):
            yield [text[:i], *rest]


def scored(rng, letters="abc"):
    pieces = {c: rng.random() for c in letters} | {"".join(rng.choice(letters) for _ in range(rng.randint(2, 4))): rng.random() for _ in range(8)}
    total = sum(pieces.values())
    return {p: math.log(v / total) for p, v in pieces.items()}


def chance(lattice, cut):
    return sum(lattice.scores[p] if p in lattice.scores else lattice.unknown if len(p) == 1 else -math.inf for p in cut)


def test_sums_and_best_path_are_those_of_all_segmentations():
    rng = random.Random(1)
    for _ in range(80):
        lattice, text = unigram.Lattice(scored(rng)), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        chances = {tuple(c): math.exp(chance(lattice, c)) for c in cuts(text)}
        total = sum(chances.values())
        uses = {}
        for cut, p in chances.items():
            for piece in cut:
                uses[piece] = uses.get(piece, 0) + p / total
        likelihood, found = lattice.uses(text)
        assert likelihood == pytest.approx(math.log(total))
        assert found == pytest.approx({p: u for p, u in uses.items() if u > 0})
        score, best = lattice.best(text)
        assert "".join(best) == text and math.exp(score) == pytest.approx(max(chances.values()))


def test_long_texts_do_not_underflow():
    lattice = unigram.Lattice(scored(random.Random(2)))
    likelihood, uses = lattice.uses("abc" * 3000)
    assert -1e6 < likelihood < -1000 and all(0 < u for u in uses.values())


def test_rounds_are_those_of_plain_loops(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = spark.createDataFrame([(" ".join(rng.choices(words, k=5)),) for _ in range(40)] + [(None,), ("",)], "t string").repartition(3)
    found, history = unigram.train_unigram(texts, "t", size=30, rounds=2)
    runs = {r.segment: r.n for r in vocabulary.segments(texts, "t").collect()}
    seed = {r.piece: r.n for r in vocabulary.train_vocabulary(texts, "t", 120).where("n > 0").collect()}
    scores, wanted = {p: math.log(n / sum(seed.values())) for p, n in seed.items()}, []
    while True:
        last = len(scores) <= 26
        for _ in range(2):
            uses, likelihood = {}, 0.0
            for run, n in runs.items():
                lattice = unigram.Lattice(scores)
                chances = [(c, math.exp(chance(lattice, c))) for c in cuts(run)]
                total = sum(p for _, p in chances)
                likelihood += n * math.log(total)
                for cut, p in chances:
                    for piece in cut:
                        if piece in scores:
                            uses[piece] = uses.get(piece, 0.0) + n * p / total
            wanted.append((len(scores), likelihood))
            scores = unigram._scored(uses, set(scores))
        if last:
            break
        scores = unigram._scored(uses, unigram.pruned(scores, uses, max(26, int(0.75 * len(scores)))))
    assert [n for n, _ in history] == [n for n, _ in wanted]
    assert [v for _, v in history] == pytest.approx([v for _, v in wanted])
    assert {r.piece: r.score for r in found.where("id > 3").collect()} == pytest.approx(scores)
    assert all(b[1] >= a[1] - 1e-9 for a, b in zip(history, history[1:]) if a[0] == b[0])


def test_segmentation_keeps_unknown_characters_and_nulls(spark):
    known = spark.createDataFrame([(0, "<pad>", 0.0), (4, "ab", -1.0), (5, "a", -2.0), (6, "b", -2.5), (7, "aba", -2.2)], "id int, piece string, score double")
    rows = spark.createDataFrame([(1, "abab xa"), (2, None), (3, ""), (4, "abaab")], "n int, t string")
    out = {r.n: (r.subword_pieces, r.subword_ids) for r in unigram.segmented(rows, "t", known).collect()}
    assert out == {1: (["ab", "ab", " ", "x", "a"], [4, 4, 1, 1, 5]), 2: (None, None), 3: ([], []), 4: (["aba", "ab"], [7, 4])}


def test_pruning_keeps_characters_and_costly_pieces():
    scores = {"a": -3.0, "b": -3.0, "ab": -1.0, "ba": -5.9, "aab": -6.0}
    assert unigram.pruned(scores, {"ab": 10.0, "ba": 1.0, "aab": 0.0}, 3) == {"a", "b", "ab"}
    assert unigram.pruned(scores, {}, 1) == {"a", "b"}


def test_sums_of_many_texts_are_those_of_each():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd字😀é") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["ab" * 300, "", "z"]
    weights = [rng.randint(1, 5) for _ in words]
    lattice = unigram.Lattice({p: math.log(w / 40) for w, p in enumerate(["a", "b", "c", "字", "ab", "bc", "abc", "b字", "😀é", "cd", "dab"], 1)})
    total, uses = unigram.Trie(lattice).sums(words, weights)
    expected, each = 0.0, dict.fromkeys(lattice.scores, 0.0)
    for word, weight in zip(words, weights):
        likelihood, found = lattice.uses(word) if word else (0.0, {})
        expected += weight * likelihood
        for piece, share in found.items():
            if piece in each:
                each[piece] += weight * share
    assert total == pytest.approx(expected, rel=1e-12)
    assert uses == pytest.approx(each, rel=1e-9)
    assert unigram.Trie(unigram.Lattice({})).sums(["ab"] * 9, [1] * 9) == (pytest.approx(-180.0), {})
