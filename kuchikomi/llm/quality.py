"""Quality: an interpolated modified Kneser-Ney model over characters, trained on trusted text.

Texts are sequences of their own characters, whatever the script, with a mark of its own for a word that repeats the one
before. N-grams of trusted text are counted in each task, summed across the cluster, and joined order by order with the
statistics of their contexts into tables of discounted probabilities, which stay in Spark. The n-grams of all documents
are counted, too, and joined with those tables, each distinct one once. Documents get the results in two ways that together
are exact: n-grams that make up one in ``HOT`` of all or more, at most ``HOT`` of them, by broadcast; every other n-gram of a
document, pre-aggregated, by a shuffle join in which no key can be hot. A document is accepted if its perplexity is at most a
high quantile of trusted texts in its language.

Edge cases: null texts count as empty and have perplexity 1; texts of any length are scored whole; languages without
enough trusted text (and null ones) use the quantile over all languages; without any trusted text every document is
accepted; characters never seen in trusted text share the probability of one; rows that repeat are scored each on its own.
Only ``doc_id``, ``lang`` and ``text`` are read, so other columns can't clash; ``filtered`` hands all columns on.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import frames, stored

ORDER = 4
#: A character is its code point plus one, and an edge of a text is 0.
EDGE, SYMBOL_BITS = 0, 21
SYMBOL = (1 << SYMBOL_BITS) - 1
AGAIN = "\x01"
HOT = 1 << 20
#: Distinct n-grams a task holds before it hands its counts on.
MOST_GRAMS = 1 << 19
CHARS_AT_ONCE = 1 << 19
QUANTILE = 0.999
LEAST_TRUSTED = 30
PRIOR_SYMBOLS = 100


def flattened(text: str) -> str:
    """Words with single blanks between; a repetition of the word before, blank included, is one mark."""
    words = text.split()
    if any(map(operator.eq, words, words[1:])):
        words = words[:1] + [AGAIN if w == p else w for p, w in zip(words, words[1:])]
    return " ".join(words).replace(" " + AGAIN, AGAIN)


def symbols(text: str) -> np.ndarray:
    """The text's symbols between edges: one edge per missing context at the start and one at the end."""
    inner = np.frombuffer(flattened(text).encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    return np.concatenate([np.full(ORDER - 1, EDGE), inner, [EDGE]]) if len(inner) else np.zeros(0, np.int64)


def ranked(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them; all are below ``limit``."""
    if limit > 1 << SYMBOL_BITS:
        found = np.unique(values)
        return found, np.searchsorted(found, values)
    seen = np.zeros(limit, dtype=bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32)[values] - 1).astype(np.int64)


class Grams:
    """The n-grams of some texts: distinct ones as two numbers (two symbols each), and for each occurrence its text and number."""

    def __init__(self, values: list[str]):
        sequences = [symbols(v) for v in values]
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        s, owner = np.concatenate([np.zeros(0, np.int64), *sequences]), np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(owner[: len(owner) - ORDER + 1] == owner[ORDER - 1 :]) if len(s) >= ORDER else np.zeros(0, np.int64)
        self.text, self.n_symbols = owner[starts], np.maximum(sizes - ORDER + 1, 0)
        # Symbols and then pairs by their number in order, so that two pairs fit into one integer.
        single, at = ranked(s, 1 << SYMBOL_BITS)
        pair, place = ranked(at[:-1] * len(single) + at[1:], len(single) ** 2)
        code, self.number = np.unique(place[starts] * len(pair) + place[starts + 2], return_inverse=True)
        of_two = (single[pair // max(len(single), 1)] << SYMBOL_BITS | single[pair % max(len(single), 1)]) if len(pair) else pair
        self.high, self.low = of_two[code // max(len(pair), 1)], of_two[code % max(len(pair), 1)]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.high, self.low, np.bincount(self.number, minlength=len(self.high))


def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of at most ``CHARS_AT_ONCE`` characters, or of one text."""
    ends, first = np.cumsum(batch.text.str.len().to_numpy(dtype=np.int64)), 0
    while first < len(batch):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + CHARS_AT_ONCE, side="right")), first + 1)
        yield batch.iloc[first:last]
        first = last


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    high, low, n = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in range(3))
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    return high[first], low[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(rows: DataFrame) -> DataFrame:
    """``high, low, n`` of every distinct n-gram of the full order in ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("high", "low", "n"), held[0])))

        for batch in batches:
            for part in parts(batch):
                held.append(Grams(part.text.tolist()).counted())
                size += len(held[-1][0])
                if size >= MOST_GRAMS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size >= MOST_GRAMS // 2:
                        yield out()
                        held, size = [], 0
        if held:
            held = [_summed(held)]
            yield out()

    return frames(rows.select("text"), run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def last_symbols(order: int) -> tuple[Column, Column]:
    """The n-gram of the last symbols, as such a pair of numbers."""
    high, low = F.col("high"), F.col("low")
    high = high if order == 4 else high.bitwiseAND(F.lit(SYMBOL).cast("bigint")) if order == 3 else F.lit(0).cast("bigint")
    return high, low if order > 1 else low.bitwiseAND(F.lit(SYMBOL).cast("bigint"))


def without_last(high: Column, low: Column) -> tuple[Column, Column]:
    """The context of an n-gram."""
    carried = F.shiftleft(high.bitwiseAND(F.lit(SYMBOL).cast("bigint")), SYMBOL_BITS)
    return F.shiftright(high, SYMBOL_BITS), carried.bitwiseOR(F.shiftright(low, SYMBOL_BITS))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all trusted documents that teach.

    However many there are, ids meet texts in a shuffle, so none is ever whole anywhere; texts of the other half stay where they lie.
    """
    chosen = trusted_ids(labels).where(for_training()).hint("shuffle_hash")
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.where(for_training()).join(chosen, "doc_id")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label calls good."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """For every order a table of probabilities and one of context weights, and the number of different symbols."""
    counts = stored(gram_counts(trusted_rows(docs, labels)), "kn-counts")
    model: dict = {}
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            # Below the full order an n-gram counts once for each symbol that was seen before it.
            high, low = last_symbols(order)
            counts = stored(counts.groupBy(high.alias("high"), low.alias("low")).agg(F.count(F.lit(1)).alias("n")), "kn-counts")
        model[order] = _smoothed(counts)
    model["symbols"] = counts.count()
    return model


def discounts(table: DataFrame) -> list[float]:
    """What is taken from counts of one, two and more, by the numbers of n-grams with counts of one to four."""
    size = {r.k: r.n for r in table.groupBy(F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (size.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return [min(max(d, 0.05), 0.95 * k) for d, k in ((d1, 1), (d2, 2), (d3, 3))]


def _smoothed(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N-grams with discounted probabilities, contexts with the weight left for the lower order."""
    d1, d2, d3 = discounts(table)
    off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    high, low = without_last(F.col("high"), F.col("low"))
    grouped = table.select("high", "low", "n", high.alias("c_high"), low.alias("c_low"), off.alias("off"))
    contexts = grouped.groupBy("c_high", "c_low").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
    p = grouped.join(contexts, ["c_high", "c_low"]).select("high", "low", ((F.col("n") - F.col("off")) / F.col("total")).alias("p"))
    return stored(p, "kn-probabilities"), stored(contexts.select("c_high", "c_low", (F.col("left") / F.col("total")).alias("w")), "kn-weights")


def log_probabilities(grams: DataFrame, model: dict) -> DataFrame:
    """``grams`` (``high, low`` among its columns) with ``log10``, the probability of its last symbol after the others."""
    out, p = grams, F.lit(1.0 / (model["symbols"] + 1))
    for order in range(1, ORDER + 1):
        known, left = model[order]
        high, low = last_symbols(order)
        before_high, before_low = without_last(high, low)
        keyed = out.withColumns({"_high": high, "_low": low, "_c_high": before_high, "_c_low": before_low})
        keyed = keyed.join(known.withColumnsRenamed({"high": "_high", "low": "_low", "p": "_p"}), ["_high", "_low"], "left")
        keyed = keyed.join(left.withColumnsRenamed({"c_high": "_c_high", "c_low": "_c_low", "w": "_w"}), ["_c_high", "_c_low"], "left")
        out = keyed.withColumn("_below", F.coalesce("_p", F.lit(0.0)) + F.coalesce("_w", F.lit(1.0)) * p).drop("_high", "_low", "_c_high", "_c_low", "_p", "_w")
        if order < ORDER:
            out = out.withColumnRenamed("_below", f"_p{order}")
            p = F.col(f"_p{order}")
    return out.withColumn("log10", F.log10("_below")).select(*grams.columns, "log10")


def _hash(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class Known:
    """Logarithms of the frequent n-grams, found by a hash and confirmed by the n-gram itself."""

    def __init__(self, high: np.ndarray, low: np.ndarray, log10: np.ndarray):
        hashes = _hash(high, low)
        order = np.argsort(hashes)
        self.hashes, self.high, self.low, self.log10 = hashes[order], high[order], low[order], log10[order]

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram whether it is here, and its logarithm or 0."""
        if not len(self.hashes):
            return np.zeros(len(high), dtype=bool), np.zeros(len(high))
        at = np.minimum(np.searchsorted(self.hashes, _hash(high, low)), len(self.hashes) - 1)
        here = (self.high[at] == high) & (self.low[at] == low)
        return here, np.where(here, self.log10[at], 0.0)


def _whole(docs: DataFrame, *kept: str) -> DataFrame:
    return docs.select(
        *kept, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def scored_rows(rows: DataFrame, model: dict) -> DataFrame:
    """``row, doc_id, lang, n_symbols, log10_p, perplexity`` of rows ``row, doc_id, lang, text``; ``row`` tells them apart."""
    logs = stored(log_probabilities(gram_counts(rows), model), "kn-grams")
    total = logs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT >= F.lit(total)
    hot = logs.where(often).select("high", "low", "log10").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast({"hot": [hot.column(c).to_numpy() for c in ("high", "low", "log10")]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "known" not in shared.value:
            shared.value["known"] = Known(*shared.value["hot"])
        known = shared.value["known"]
        for batch in batches:
            for part in parts(batch):
                grams = Grams(part.text.tolist())
                here, log10 = known.find(grams.high, grams.low)
                sums = np.bincount(grams.text, log10[grams.number], len(part))
                rare = ~here[grams.number]
                key, n = np.unique(grams.text[rare] * max(len(here), 1) + grams.number[rare], return_counts=True)
                text, number = key // max(len(here), 1), key % max(len(here), 1)
                cuts = np.cumsum(np.bincount(text, minlength=len(part)))[:-1]
                lists = {f"rare_{k}": np.split(v, cuts) for k, v in (("high", grams.high[number]), ("low", grams.low[number]), ("n", n))}
                out = {k: pd.Series(v, index=part.index, dtype=object) for k, v in lists.items()}
                yield part[["row", "doc_id", "lang"]].assign(n_symbols=grams.n_symbols, log10_hot=sums, **out)

    schema = "row long, doc_id long, lang string, n_symbols long, log10_hot double, rare_high array<long>, rare_low array<long>, rare_n array<long>"
    asked = stored(frames(rows, run, schema), "kn-documents")
    one = F.explode(F.arrays_zip("rare_high", "rare_low", "rare_n")).alias("g")
    each = asked.select("row", one).select("row", F.col("g.rare_high").alias("high"), F.col("g.rare_low").alias("low"), F.col("g.rare_n").alias("times"))
    rest = each.join(logs.where(~often).select("high", "low", "log10"), ["high", "low"]).groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("rest"))
    log10_p = F.col("log10_hot") + F.coalesce("rest", F.lit(0.0))
    perplexity = F.pow(F.lit(10.0), -F.col("log10_p") / F.greatest("n_symbols", F.lit(1)))
    found = asked.drop("rare_high", "rare_low", "rare_n").join(rest, "row", "left").select("row", "doc_id", "lang", "n_symbols", log10_p.alias("log10_p"))
    return found.withColumn("perplexity", perplexity)


def perplexities(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang, n_symbols, log10_p, perplexity`` of every whole text."""
    return scored_rows(_whole(docs).withColumn("row", F.monotonically_increasing_id()), model).drop("row")


def calibrated(docs: DataFrame, labels: DataFrame, scored: DataFrame, quantile: float, least: int) -> tuple[dict, dict]:
    """Average log10 probability of a symbol, and the steady perplexity accepted, both by language (None: all languages)."""
    trusted = scored.join(trusted_ids(labels).where(~for_training()), "doc_id").where("n_symbols > 0")
    usual = _by_language(trusted.withColumn("value", F.col("log10_p")), F.sum("value") / F.sum("n_symbols"), least)
    limits = _by_language(trusted.withColumn("value", steady(usual)), F.percentile_approx("value", quantile, 10_000), least)
    return usual, limits


def for_training() -> Column:
    """Half of the trusted documents teach the model, the other half says how it fares on texts it has not seen."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def _by_language(rows: DataFrame, value: Column, least: int) -> dict:
    found = rows.rollup("lang").agg(value.alias("value"), F.count(F.lit(1)).alias("n"), F.grouping("lang").alias("whole")).collect()
    return {None if r.whole else r.lang: float(r.value) for r in found if r.n and (r.whole or r.lang is not None and r.n >= least)}


def of_language(values: dict, otherwise: float) -> Column:
    out = F.lit(values.get(None, otherwise))
    for lang, value in values.items():
        if lang is not None:
            out = F.when(F.col("lang") == lang, F.lit(value)).otherwise(out)
    return out


def steady(usual: dict, prior: int = PRIOR_SYMBOLS) -> Column:
    """The perplexity as if ``prior`` symbols of the language's average trusted text came first: few symbols say little."""
    return F.pow(F.lit(10.0), -(F.col("log10_p") + prior * of_language(usual, 0.0)) / (F.col("n_symbols") + prior))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> DataFrame:
    """Every document's perplexity, its language's threshold (over all trusted documents not trained on) and the verdict."""
    return _verdicts(stored(perplexities(docs, fit(docs, labels)), "perplexities"), docs, labels, quantile, least)


def _verdicts(scored: DataFrame, docs: DataFrame, labels: DataFrame, quantile: float, least: int) -> DataFrame:
    usual, limits = calibrated(docs, labels, scored, quantile, least)
    return (
        scored.withColumn("steady", steady(usual))
        .withColumn("threshold", of_language(limits, float("inf")))
        .withColumn("accepted", F.col("steady") <= F.col("threshold"))
    )


def filtered(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> DataFrame:
    """The accepted rows of ``docs``, all columns. Rows are numbered and written down, and meet their verdict by number."""
    number = "row"
    while number in docs.columns:
        number += "_"
    keyed = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = _whole(keyed, F.col(number).alias("row"))
    scored = stored(scored_rows(rows, fit(keyed, labels)), "perplexities")
    rejected = _verdicts(scored, keyed, labels, quantile, least).where(~F.col("accepted"))
    return keyed.join(rejected.select(F.col("row").alias(number)), number, "left_anti").select(*docs.columns)
