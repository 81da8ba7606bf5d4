"""The longest match over many texts at once."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kuchikomi.operators import vocabulary

LETTERS = "ab c\n部屋☃😀é"


@pytest.mark.parametrize("cells, chars", [(0, 3), (1 << 22, 1 << 19), (1 << 22, 5)])
def test_longest_match_at_every_place(monkeypatch, cells, chars):
    monkeypatch.setattr(vocabulary, "MOST_CELLS", cells)
    monkeypatch.setattr(vocabulary, "CHARS_AT_ONCE", chars)
    rng = random.Random(chars)
    word = lambda letters, least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    for _ in range(150):
        ids = {p: i for i, p in enumerate({word(LETTERS, 1, 4) for _ in range(rng.randint(0, 14))}, 4)}
        texts = [None if rng.random() < 0.1 else word(LETTERS + "z", 0, 12) for _ in range(rng.randint(0, 6))]
        length = rng.choice([None, 2, 64])
        either = re.compile("|".join([*map(re.escape, sorted(ids, key=len, reverse=True)), "(?s:.)"]))
        wanted = [None if t is None else either.findall(t)[:length] for t in texts]
        found = vocabulary.Cutter(ids).cut([None if t is None else t.encode() for t in texts], length).to_pylist()
        assert [f["pieces"] for f in found] == wanted
        assert [f["ids"] for f in found] == [None if w is None else [ids.get(p, 1) for p in w] for w in wanted]


def test_texts_are_not_cut_by_a_pattern_of_all_pieces(spark):
    table = spark.createDataFrame([(4, "a", 1), (5, "ab", 1), (6, "b c", 1)], "id int, piece string, n bigint")
    texts = spark.createDataFrame([("abb cab", "x"), ("", "y"), (None, "z"), ("a" * 5000, "w")], "t string, k string")
    cut = vocabulary.encode(texts, "t", table)
    assert cut.columns == ["t", "k", "subword_pieces", "subword_ids"]
    assert "regexp" not in cut._jdf.queryExecution().optimizedPlan().toString()
    found = {r.k: r for r in cut.collect()}
    assert found["x"].subword_pieces == ["ab", "b c", "ab"] and found["x"].subword_ids == [5, 6, 5]
    assert found["y"].subword_pieces == [] and found["z"].subword_pieces is None and found["w"].subword_ids == [4] * 5000
    ahead = vocabulary.encode(texts, "t", table, length=2).where("k = 'x'").select(F.to_json("subword_pieces")).first()[0]
    assert ahead == '["ab","b c"]'
