"""Toxicity: a logistic classifier whose score must not change when identity terms are swapped.

A training row with identity terms has two counterfactual copies: in one every term gives way to the next term of its
group, in the other all terms are left out. The loss adds the squared change of the logit from the row to each copy, so a
term that merely occurs beside abuse cannot carry weight of its own, nor can all terms of its group together.

Edge cases: a null text counts as empty and gets the score of a text without features; texts of any length are scored
whole; labels that are null are left out, contradicting labels of one document count as toxic; without both classes
among the training rows every score is the share of toxic rows (0 without any row); rows that repeat are scored each on
its own. Only ``doc_id`` and ``text`` are read, so other columns can't clash; ``filtered`` hands all columns on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import id_remainder, keep, per_row, texts

#: Terms that are swapped within their group, in English, French, German and Spanish; a parameter of ``fit``.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "citizen"),
    ("immigrants", "citizens"),
    ("old", "young"),
    ("disabled", "healthy"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("immigrés", "citoyens"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslim", "christ", "jude", "hindu", "buddhist"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("ausländer", "bürger"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmán", "cristiano", "judío", "hindú", "budista"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("inmigrantes", "ciudadanos"),
)
WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature; at most as many as ``max_features`` of the fit, hence small enough to ship to every task."""

    weights: dict[str, float]
    bias: float

    def logits(self, values: list[str]) -> np.ndarray:
        return np.array([self.bias + sum(map(self.weights.__getitem__, self.present(v))) for v in values], dtype=float)

    def scores(self, values: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(values), -40, 40)))

    def present(self, text: str) -> set[str]:
        return {f for word in distinct_words(text) for f in features(word) if f in self.weights}


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word itself and its openings, which stand for inflected forms never seen in training."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def swaps(identity_groups=IDENTITY_GROUPS) -> dict[str, str]:
    """The next term of a term's group; a term of several groups stays in the first of them."""
    out: dict[str, str] = {}
    for group in identity_groups:
        for i, term in enumerate(group):
            out.setdefault(term, group[(i + 1) % len(group)])
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Text and label of at most ``max_labelled`` labelled documents, chosen by a hash of the id.

    The chosen ids are bounded by the parameter, so they are broadcast and no text is shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    max_features: int = 2_000,
    min_chi2: float = 15.0,
    penalty: float = 10.0,
    l2: float = 2e-4,
    identity_groups=IDENTITY_GROUPS,
) -> ToxicityModel:
    """Learn from ``labels.toxic``. ``max_labelled`` bounds the sample, ``max_features`` the model.

    Words and openings are counted by class in Spark; the ones most associated with the label (chi-squared at
    least ``min_chi2``) and all identity terms become features. Only their positions in the sample reach the driver.
    """
    rows = training_rows(docs, labels, max_labelled).persist()
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, positive = sum(totals.values()), sum(v for k, v in totals.items() if k)
    if not 0 < positive < n:
        rows.unpersist()
        share = (positive + 0.5) / (n + 1) if n else 0.5
        return ToxicityModel({}, float(np.log(share / (1 - share))) if n else -40.0)

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.text, batch.toxic):
            seen[int(bool(toxic))].update({f for w in distinct_words(text) for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        return pd.DataFrame({"feature": names, "neutral": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]})

    a, b = F.col("toxic").cast("double"), F.col("neutral").cast("double")
    both = a + b
    gap = a * (n - positive) - b * positive
    chi2 = n * gap * gap / (positive * (n - positive) * both * F.greatest(n - both, F.lit(1.0)))
    counted = per_row(rows, count, "feature string, neutral long, toxic long").groupBy("feature").agg(F.sum("neutral").alias("neutral"), F.sum("toxic").alias("toxic"))
    picked = counted.withColumn("chi2", chi2).where((F.col("chi2") >= min_chi2) & (both >= 3)).orderBy(F.desc("chi2"), "feature").limit(max_features)
    swap = swaps(identity_groups)
    chosen = sorted({r.feature for r in picked.collect()} | {f for term in swap for f in features(term)})
    index = {f: i for i, f in enumerate(chosen)}

    def positions(words: set[str]) -> list[int]:
        return sorted({index[f] for w in words for f in features(w) if f in index})

    def encode(batch: pd.DataFrame) -> pd.DataFrame:
        words = [distinct_words(t) for t in batch.text]
        copies = [[positions({swap.get(w, w) for w in ws}), positions(ws - swap.keys())] if ws & swap.keys() else [] for ws in words]
        return pd.DataFrame({"toxic": batch.toxic.astype(bool), "own": [positions(w) for w in words], "copies": copies})

    sample = per_row(rows, encode, "toxic boolean, own array<int>, copies array<array<int>>").toPandas()
    rows.unpersist()
    weights = _minimise(sample, len(chosen), penalty, l2)
    return ToxicityModel({f: float(weights[i]) for f, i in index.items()}, float(weights[-1]))


def _minimise(sample: pd.DataFrame, width: int, penalty: float, l2: float, rounds: int = 1000) -> np.ndarray:
    """Mean over rows of log loss + penalty * squared logit change, + l2, by accelerated gradient steps; the last entry is the bias.

    Columns are scaled by their frequency, so rare and frequent features settle alike; the step comes from a
    power iteration on a bound of the curvature.
    """
    y = sample.toxic.to_numpy(float)
    n = len(y)
    own, own_back = _product(sample.own, width)
    pairs = [({*a}, {*b}) for a, copies in zip(sample.own, sample.copies) for b in copies]
    here, here_back = _product(pd.Series([sorted(a - b) for a, b in pairs], dtype=object), width)
    there, there_back = _product(pd.Series([sorted(b - a) for a, b in pairs], dtype=object), width)
    scale = 1 / np.sqrt((own_back(np.ones(n)) + here_back(np.ones(len(pairs))) + there_back(np.ones(len(pairs))) + 1) / n)
    scale = np.append(scale, 1.0)

    def slope(v: np.ndarray, residual) -> np.ndarray:
        w = v * scale
        r = residual(w[-1] + own(w[:-1])) / n
        change = 2 * penalty / n * (here(w[:-1]) - there(w[:-1]))
        g = l2 * w
        g[:-1] += own_back(r) + here_back(change) - there_back(change)
        g[-1] = r.sum()
        return g * scale

    probe = np.ones(width + 1)
    for _ in range(30):
        probe = slope(probe / np.linalg.norm(probe), lambda z: z / 4)
    step = 1 / (1.05 * np.linalg.norm(probe) + 1e-9)
    v, at, k = np.zeros(width + 1), np.zeros(width + 1), 0
    for _ in range(rounds):
        g = slope(at, lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = at - step * g
        k = 0 if g @ (new - v) > 0 else k + 1
        at, v = new + k / (k + 3) * (new - v), new
    return v * scale


def _product(lists: pd.Series, width: int):
    """The 0/1 matrix of the positions, as multiplication from either side."""
    rows, at = _flat(lists)
    n = len(lists)
    return lambda w: np.bincount(rows, w[at], n), lambda r: np.bincount(at, r[rows], width)


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(v) for v in lists]
    at = np.concatenate([np.asarray(v, dtype=np.int64) for v in lists]) if sum(sizes) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), at


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for every row, over whole texts; the model is bounded and travels with the task."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch.doc_id, "score": ToxicityModel(*shared.value).scores(batch.text.tolist())})

    return per_row(texts(docs), run, "doc_id long, score double")


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, learnt from the labelled documents whose id is not held out."""
    model = fit(docs, labels.where(id_remainder(5) != 0))
    return score(docs, model).select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def filtered(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    return keep(docs, lambda values: ToxicityModel(*shared.value).scores(values) < threshold)
