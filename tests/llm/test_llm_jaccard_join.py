from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from cases import awkward, documents, empty, sentence

from pyspark.sql import functions as F

from kuchikomi.llm import jaccard_join as jj
from kuchikomi.llm.components import connected
from kuchikomi.llm.rows import groups


def near_copies(rng: random.Random, text: str, n: int) -> list[str]:
    out = []
    for _ in range(n):
        words = text.split()
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
        out.append(" ".join(words))
    return out


def brute(texts: list[str | None], threshold: float):
    shingler = jj.Shingler()
    words = [tuple(shingler.words(t or "")) for t in texts]
    sets = [{w[i : i + 5] for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    n = len(texts)
    links, root = Counter(), list(range(n))
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            equal = words[i] == words[j]
            if equal or both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


@pytest.mark.parametrize("block_rows", [512, 7])
def test_against_all_pairs(spark, block_rows, monkeypatch):
    rng = random.Random(6)
    texts: list = [sentence(rng, rng.randint(1, 90)) for _ in range(60)]
    for base in texts[:4]:
        texts += near_copies(rng, base + " " + sentence(rng, 60), 12)
    texts += texts[:5] + [texts[7].upper() + "!!", None, "", "one two", "one two"]
    monkeypatch.setattr(jj.verified, "__defaults__", (block_rows,))
    rows = {r.doc_id: r for r in jj.jaccard_groups(documents(spark, texts).repartition(3)).collect()}
    links, root = brute(texts, jj.THRESHOLD)
    assert {i: r.n_links for i, r in rows.items()} == {i: links[i] for i in rows}
    assert {i: r.group_id for i, r in rows.items()} == dict(enumerate(root))
    assert sorted(i for i, r in rows.items() if r.stays) == sorted(set(root))


def test_banding_reaches_recall():
    for threshold in (0.5, 0.8, 0.9, 1.0):
        bands, rows = jj.banding(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= jj.RECALL - 1e-12
    assert jj.banding() == (23, 6)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        common, own = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        a, b = (jj.signature(jj.mixed(np.concatenate([common, part])), 23, 6) for part in (own[:10], own[10:]))
        hits += int((a == b).sum())
    assert abs(hits / 300 - 23 * 0.8**6) < 0.6


def test_awkward_rows(spark):
    rows = jj.jaccard_groups(awkward(spark)).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].class_id for i in (3, 4, 5, 10)} == {3} and by_id[4].n_links == 3 and by_id[4].class_links == 0
    assert by_id[8].class_id == 7 and by_id[9].copies == 3  # case, punctuation and blanks aside, id 2**60 + 1 says the same
    assert jj.jaccard_groups(empty(spark)).collect() == []


def test_deduplicated_rows_are_whole(spark):
    docs = awkward(spark)
    kept = jj.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "3", "6", "7", "9", "11"])
    assert next(r for r in kept.collect() if r.doc_id == 7).text == next(r for r in docs.collect() if r.doc_id == 7).text


def test_many_texts_under_one_id(spark):
    """Rows without ids or with the same one are told apart, and no text is joined to another row's."""
    rng = random.Random(9)
    base = [sentence(rng, 40) for _ in range(300)]
    texts = base + base[:100] + near_copies(rng, base[0] + " " + sentence(rng, 40), 5)
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(7)).cast("long"))
    rows = jj.jaccard_groups(docs).collect()
    links, root = brute(texts, jj.THRESHOLD)
    assert sorted(r.n_links for r in rows) == sorted(links[i] for i in range(len(texts)))
    assert sum(r.stays for r in rows) == len(set(root)) == jj.deduplicated(docs).count()


def test_no_join_multiplies_rows(spark):
    """10,000 rows under one id: the join that fetches texts gives one row a class."""
    docs = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "concat('a b c d e f g h i j k l m ', id % 5000) as text")
    rows = jj.numbered(docs)
    classes = rows.groupBy("text").agg(F.min("row").alias("key"), F.count(F.lit(1)).alias("copies"))
    components = classes.select("key", (F.col("key") % 50).alias("component"))
    found = jj.verified(rows, classes, components, 5, 1.1)
    assert found.collect() == []
    joined = rows.select(F.col("row").alias("key"), "text").join(components, "key")
    assert joined.count() == 5000


@pytest.mark.parametrize("low", [0.8, 0.9])
def test_recall_against_all_pairs(spark, low):
    """Planted pairs from the threshold up: at least 0.9 of those that brute force finds, here all of them."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        words = sentence(rng, 100).split()
        texts.append(" ".join(words))
        for _ in range(2):
            copy = words[:]
            for _ in range(rng.randint(1, 3 if low == 0.8 else 1)):
                copy[rng.randrange(len(copy))] = "other" + str(rng.random())[2:8]
            texts.append(" ".join(copy))
    rows = {r.doc_id: r.n_links for r in jj.jaccard_groups(documents(spark, texts)).collect()}
    links, _ = brute(texts, jj.THRESHOLD)
    assert sum(rows.values()) >= 0.9 * sum(links.values()) > 100 and all(rows[i] <= links[i] for i in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 140), (140, 120), (7, 7), (120, 101)]
    rows = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in (101, 120, 140)}


def test_groups_cross_batches():
    rows = [(k, v) for k in range(6) for v in range(k)]
    frame = pd.DataFrame(rows, columns=["k", "v"])
    for size in (1, 2, 4, 100):
        batches = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
        assert [(g.k.iloc[0], g.v.tolist()) for g in groups(iter(batches), ["k"])] == [(k, list(range(k))) for k in range(1, 6)]
