from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from cases import awkward, documents, empty, labels, sentence

from pyspark.sql import functions as F

from kuchikomi.llm import quality as q


def corpus(spark, n=160):
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(n):
        text = sentence(rng, 60)
        bad = i % 8 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 16 else "oneded " * 40
        texts.append(text)
        marks.append((i, int(not bad), 0))
    return documents(spark, texts), labels(spark, marks)


def test_junk_is_rejected_and_clean_text_stays(spark):
    docs, marks = corpus(spark)
    rows = {r.doc_id: r for r in q.judged(docs, marks).collect()}
    good = {r.doc_id: r.quality for r in marks.collect()}
    assert sum(rows[i].accepted for i in rows if good[i]) >= 0.95 * sum(good.values())
    assert not any(rows[i].accepted for i in rows if not good[i])


def plain_model(texts):
    """The model by definition, from dictionaries over all trusted texts; gives a probability and an n-gram's logarithm."""
    count: dict[int, Counter] = {q.ORDER: Counter()}
    for t in texts:
        s = q.symbols(t).tolist()
        count[q.ORDER].update(tuple(s[i : i + q.ORDER]) for i in range(len(s) - q.ORDER + 1))
    for order in range(q.ORDER - 1, 0, -1):
        count[order] = Counter(g[1:] for g in count[order + 1])

    def discounts(order):
        n = Counter(min(c, 5) for c in count[order].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5]
        d.append(2 - 3 * y * n[3] / n[2] if n[2] else d[0])
        d.append(3 - 4 * y * n[4] / n[3] if n[3] else d[1])
        return [min(max(x, 0.05), 0.95 * k) for x, k in zip(d, (1, 2, 3))]

    off = {order: discounts(order) for order in count}
    after = {order: {} for order in count}
    for order, grams in count.items():
        for g, c in grams.items():
            after[order].setdefault(g[:-1], {})[g] = c

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / (len(count[1]) + 1)
        seen = after[order].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        total = sum(seen.values())
        left = sum(off[order][min(c, 3) - 1] for c in seen.values()) / total
        c = seen.get(gram, 0)
        return (max(c - off[order][min(c, 3) - 1], 0) / total if c else 0) + left * p(gram[1:])

    def log10(text):
        s = q.symbols(text).tolist()
        return sum(math.log10(p(tuple(s[i : i + q.ORDER]))) for i in range(len(s) - q.ORDER + 1)), max(len(s) - q.ORDER + 1, 0)

    return p, log10


def trusted_texts(docs, marks, training=True):
    half = q.for_training() if training else ~q.for_training()
    chosen = {r.doc_id for r in q.trusted_ids(marks).where(half).collect()}
    return [r.text for r in docs.collect() if r.doc_id in chosen]


ODD = [None, "", " ", "a", "the andthing on Hand 7", "так говорит наука", "数据 数据 数据\n清洗", "😀 zq\x00 x\x01y", "of the thing " * 400, "\ud800x".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]


@pytest.mark.parametrize("hot,most", [(1 << 20, 1 << 21), (40, 300), (1, 1)])
def test_against_plain_kneser_ney(spark, monkeypatch, hot, most):
    """The same figures whether all n-grams, some or none travel by broadcast, and however often a task hands on counts."""
    monkeypatch.setattr(q, "HOT", hot)
    monkeypatch.setattr(q, "MOST_GRAMS", most)
    docs, marks = corpus(spark)
    _, log10 = plain_model(trusted_texts(docs, marks))
    mixed = documents(spark, ODD + [r.text for r in docs.limit(20).collect()]).repartition(3)
    rows = q.perplexities(mixed, q.fit(docs, marks)).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        expected, n = log10(texts[r.doc_id] or "")
        assert r.n_symbols == n and abs(r.log10_p - expected) < 1e-6 * max(n, 1)


def test_probabilities_sum_to_one(spark):
    docs, marks = corpus(spark)
    model = q.fit(docs, marks)
    texts = trusted_texts(docs, marks)
    seen = sorted({s for t in texts for s in q.symbols(t).tolist()} - {q.EDGE}) + [q.EDGE]
    rows = []
    for context in [(0, 0, 0), tuple(q.symbols(texts[0]).tolist()[9:12]), (seen[3], 5, 6), (99_999, 99_998, 99_997)]:
        rows += [(context[0] << 21 | context[1], context[2] << 21 | s, str(context)) for s in [*seen, 77_777]]
    found = q.log_probabilities(spark.createDataFrame(rows, "high long, low long, context string"), model)
    sums = {r.context: r.s for r in found.groupBy("context").agg(F.sum(F.pow(F.lit(10.0), "log10")).alias("s")).collect()}
    assert len(sums) == 4 and all(abs(s - 1) < 1e-9 for s in sums.values())


def test_thresholds_and_verdicts_by_hand(spark):
    docs, marks = corpus(spark, 400)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 50 == 1, "rare").otherwise("en"))
    rows = q.judged(docs, marks, quantile=0.9, least=20).collect()
    held = {r.doc_id for r in q.trusted_ids(marks).where(~q.for_training()).collect()}
    by_lang = {}
    for r in rows:
        if r.doc_id in held and r.n_symbols:
            for lang in (r.lang, None):
                by_lang.setdefault(lang, []).append(r)
    usual = {k: sum(r.log10_p for r in v) / sum(r.n_symbols for r in v) for k, v in by_lang.items() if k is None or len(v) >= 20}
    assert set(usual) == {None, "en", "de"}
    steady = lambda r: 10 ** (-(r.log10_p + 100 * usual.get(r.lang, usual[None])) / (r.n_symbols + 100))
    limit = {k: sorted(map(steady, by_lang[k]))[math.ceil(0.9 * len(by_lang[k])) - 1] for k in usual}
    for r in rows:
        assert abs(r.steady / steady(r) - 1) < 1e-9 and abs(r.threshold / limit.get(r.lang, limit[None]) - 1) < 1e-9
        assert r.accepted == (r.steady <= r.threshold)


def test_junk_in_other_scripts_is_rejected(spark):
    """Letters the trusted text doesn't have aren't taken for its own, however word-like they look."""
    docs, marks = corpus(spark)
    rng = random.Random(4)
    latin = str.maketrans("aeionrstuhgf", "аеионрстухгф")
    junk = documents(spark, [sentence(rng, 40).translate(latin) for _ in range(10)] + ["语料 清洗 " * 30, "λόγος και άλλα " * 9], first=5000)
    rows = {r.doc_id: r.accepted for r in q.judged(docs.unionByName(junk), marks).collect()}
    assert not any(rows[i] for i in range(5000, 5012))


def test_repetition_is_one_symbol():
    assert q.flattened("der der der Haus\n\nder") == f"der{q.AGAIN}{q.AGAIN} Haus der"
    assert q.flattened("  ") == ""


def test_awkward_rows(spark):
    docs, marks = corpus(spark)
    model = q.fit(docs, marks)
    rows = q.perplexities(awkward(spark), model).collect()
    assert len(rows) == 12 and {r.perplexity for r in rows if r.doc_id in (3, 4, 5, 10)} == {1.0}
    none = labels(spark, [(1, None, 0)])
    assert all(r.accepted for r in q.judged(awkward(spark), none).collect())
    assert q.judged(empty(spark), none).collect() == []
    kept = q.filtered(awkward(spark), none)
    assert kept.columns == awkward(spark).columns and kept.count() == 12


def test_filter_agrees_with_verdicts(spark):
    docs, marks = corpus(spark)
    accepted = {r.doc_id for r in q.judged(docs, marks).collect() if r.accepted}
    assert {r.doc_id for r in q.filtered(docs, marks).collect()} == accepted


def test_every_trusted_document_teaches(spark):
    """More of them than a fixed number that once was the most; every label is 1, so half of all ids teach."""
    docs = spark.range(42_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    marks = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    taught = docs.where(q.for_training()).count()
    assert taught > 20_000
    assert q.trusted_rows(docs, marks).count() == taught
    # Each text has one n-gram that begins with three edges.
    counts = q.gram_counts(q.trusted_rows(docs, marks))
    assert counts.where("high = 0").agg(F.max("n")).first()[0] == taught
