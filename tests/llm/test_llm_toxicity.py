from __future__ import annotations

import random

import numpy as np
import pandas as pd
from cases import awkward, documents, empty, labels, sentence

from kuchikomi.llm import toxicity


def corpus(spark, n=400):
    """Abuse is toxic; one group's name stands beside abuse far more often than beside neutral text."""
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = sentence(rng, 30).split()
        if toxic:
            words.insert(rng.randrange(30), rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(30), "muslim")
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    return documents(spark, texts), labels(spark, marks)


def test_held_out_accuracy(spark):
    docs, marks = corpus(spark)
    rows = {r.doc_id: r for r in toxicity.toxic_scores(docs, marks).collect()}
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert 40 < len(held) < 120
    assert sum(rows[i].predicted == truth[i] for i in held) >= 0.95 * len(held)


def test_swapped_terms_carry_no_weight(spark):
    docs, marks = corpus(spark)
    neutral = ["the muslim of the thing and the station", "the christian of the thing and the station"]
    free = toxicity.fit(docs, marks, penalty=0.0).logits(neutral)
    bound = toxicity.fit(docs, marks, penalty=30.0).logits(neutral)
    assert free[0] - free[1] > 1
    assert abs(bound[0] - bound[1]) < 0.1 * (free[0] - free[1])


def test_neutral_mentions_are_not_called_toxic(spark):
    """Held-out neutral sentences with the group's name: fewer false positives, and abuse is still found."""
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(400):
        words = sentence(rng, 8).split()
        toxic = i % 2 == 0
        if toxic and rng.random() < 0.6:
            words.append(rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(0, "musulmans")
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    docs, marks = documents(spark, texts), labels(spark, marks)
    neutral = ["musulmans " + sentence(rng, 8) for _ in range(200)]
    abuse = [sentence(rng, 8) + " scum" for _ in range(200)]
    free, bound = (toxicity.fit(docs, marks, penalty=p) for p in (0.0, 30.0))
    assert (free.scores(neutral) >= 0.5).mean() > 0.5 > 0.2 > (bound.scores(neutral) >= 0.5).mean()
    assert (bound.scores(abuse) >= 0.5).mean() > 0.9


def test_weights_are_those_of_a_plain_descent():
    """The accelerated fit ends where small plain steps on the same loss end."""
    rng = random.Random(2)
    rows = [(rng.random() < 0.4, sorted(rng.sample(range(6), 3)), sorted(rng.sample(range(6), 3)) if rng.random() < 0.5 else None) for _ in range(60)]
    sample = pd.DataFrame({"toxic": [r[0] for r in rows], "own": [r[1] for r in rows], "copies": [[r[2]] if r[2] is not None else [] for r in rows]})
    own, other = np.zeros((60, 6)), np.zeros((60, 6))
    for i, (_, a, b) in enumerate(rows):
        own[i, a] = 1
        other[i, b if b is not None else a] = 1
    y, w = sample.toxic.to_numpy(float), np.zeros(7)
    for _ in range(60_000):
        r = (1 / (1 + np.exp(-(own @ w[:-1] + w[-1]))) - y) / 60
        g = np.append(own.T @ r + 2 * 3.0 / 60 * (own - other).T @ ((own - other) @ w[:-1]), r.sum())
        g[:-1] += 1e-2 * w[:-1]
        w -= 0.05 * g
    assert np.allclose(toxicity._minimise(sample, 6, 3.0, 1e-2, 5000), w, atol=5e-3)


def test_openings_stand_for_unseen_forms():
    model = toxicity.ToxicityModel({"vequ*": 9.0}, -4.0)
    assert model.scores(["la vequtier de", "la vequer"]).min() > 0.9 > 0.1 > model.scores(["la veau"])[0]


def test_awkward_rows(spark):
    docs, marks = corpus(spark)
    model = toxicity.fit(docs, marks)
    rows = toxicity.score(awkward(spark), model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows} == {2**60 + 1, None, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5, 10)}) == 1


def test_without_labels_or_rows(spark):
    none = labels(spark, [])
    assert {r.score < 0.01 for r in toxicity.toxic_scores(awkward(spark), none).collect()} == {True}
    one_class = labels(spark, [(9, 1, 0), (9, None, None), (None, 1, 1)])
    assert {r.predicted for r in toxicity.toxic_scores(awkward(spark), one_class).collect()} == {0}
    assert toxicity.toxic_scores(empty(spark), none).collect() == []


def test_filter_keeps_rows_whole(spark):
    model = toxicity.ToxicityModel({"thing": 9.0}, -4.0)
    kept = toxicity.filtered(awkward(spark), model)
    assert kept.columns == awkward(spark).columns
    # The long text of 7 and 8 holds the word, too.
    assert "thing" in toxicity.distinct_words(awkward(spark).where("doc_id = 7").first().text)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "3", "4", "5", "6", "10", "11"])
