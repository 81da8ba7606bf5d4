"""A classifier trained in passes, each starting where the one before ended, with the best state of the run kept.

Every pass deals the training rows to the tasks; each task goes through its rows once by stochastic gradient steps from the
weights all tasks were given, and the new weights are the tasks' averaged by their rows (iterative parameter mixing). After
each pass the state is stored and judged by macro-F1 on the validation rows, and the best one is what the run returns.
Weights are a table of ``slots`` rows and a few classes, so what is averaged, stored and shipped is bounded by the parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import LABELS
from kuchikomi.operators.evaluation import macro_f1, with_predictions
from kuchikomi.session import bounded_batches, shuffle_partitions

SLOTS, PASSES, STEP = 1 << 14, 5, 0.5
STATE = "slot int, " + ", ".join(f"w{k} double" for k in LABELS)


def _hashes(kind: str, tokens: pa.Array) -> np.ndarray:
    """A hash of every token; each distinct one is hashed once."""
    coded = tokens.dictionary_encode(null_encoding="encode")
    made = np.array([xxhash.xxh64_intdigest(f"{kind} {t}") for t in coded.dictionary.to_pylist()], dtype=np.uint64)
    return made[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else made


def slots_of(examples: DataFrame, slots: int = SLOTS) -> Column:
    """The slots of an example's character pairs, subwords and words, each kind hashed by itself, and of its aspect.

    The last character is paired with nothing. Without characters, subwords or words at all there are no slots.
    """

    @F.arrow_udf("array<int>")
    def found(chars: pa.Array, subwords: pa.Array, words: pa.Array, aspect: pa.Array) -> pa.Array:
        absent = np.zeros(len(chars), dtype=bool)
        for column in (chars, subwords, words, aspect):
            absent |= column.is_null().to_numpy(zero_copy_only=False)
        kinds = []
        for kind, lists in (("pair", chars), ("subword", subwords), ("word", words)):
            many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _hashes(kind, lists.flatten())
            if kind == "pair" and len(hashes):
                after = np.append(hashes[1:], np.uint64(0))
                after[(np.cumsum(many) - 1)[many > 0]] = 0
                hashes = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (after * np.uint64(0xC2B2AE3D27D4EB4F))
                hashes ^= hashes >> np.uint64(32)
            kinds.append((many, hashes))
        kinds.append((np.ones(len(chars), dtype=np.int64), _hashes("aspect", aspect.cast(pa.string()))))
        total = np.sum([many for many, _ in kinds], axis=0)
        made, place = np.empty(int(total.sum()), dtype=np.int32), np.cumsum(total) - total
        for many, hashes in kinds:
            made[np.repeat(place - (np.cumsum(many) - many), many) + np.arange(len(hashes))] = hashes % np.uint64(slots)
            place = place + many
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)), pa.int32()), pa.array(made), mask=pa.array(absent))

    return found("chars", "subwords", "words", "aspect_category")


def prepared(examples: DataFrame, slots: int = SLOTS) -> DataFrame:
    """What passes and scores read of ``classifier.examples``."""
    bounded_batches(examples.sparkSession)
    kept = [c for c in ("review_id", "aspect_idx", "label", "weight") if c in examples.columns]
    return examples.select(*kept, F.coalesce(slots_of(examples, slots), F.array().cast("array<int>")).alias("slots"))


def _vectors(rows: pa.ListArray, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every row its distinct slots, and their counts as a vector of length one."""
    places, end = rows.flatten().to_numpy(zero_copy_only=False), 0
    for many in pc.list_value_length(rows).fill_null(0).to_pylist():
        first, end = end, end + many
        counts = np.bincount(places[first:end], minlength=slots) if many else np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(counts)
        n = counts[at]
        yield at, n / np.sqrt(n @ n) if many else n.astype(float)


def _chances(weights: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    logits = x @ weights[at] if len(at) else np.zeros(weights.shape[1])
    e = np.exp(logits - logits.max())
    return e / e.sum()


def one_pass(train: DataFrame, weights: np.ndarray, step: float) -> np.ndarray:
    """The weights after every task went through its rows once; a ``weight`` column scales a row's steps."""
    bounded_batches(train.sparkSession)
    shared, columns = train.sparkSession.sparkContext.broadcast(weights), [c for c in ("slots", "label", "weight") if c in train.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value.copy(), 0
        for batch in batches:
            scale = batch.column("weight").to_pylist() if "weight" in columns else [1.0] * batch.num_rows
            for (at, x), label, times in zip(_vectors(batch.column("slots"), len(own)), batch.column("label").to_pylist(), scale):
                slope = _chances(own, at, x)
                slope[LABELS.index(label)] -= 1
                own[at] -= x[:, None] * (step * (times or 0.0) * slope)
                rows += 1
        if rows:
            changed = np.flatnonzero((own != shared.value).any(axis=1))
            moved = (own[changed] - shared.value[changed]) * rows
            data = {"slot": pa.array([-1, *changed.tolist()], pa.int32())}
            first = [float(rows)] + [0.0] * (len(LABELS) - 1)
            yield pa.RecordBatch.from_pydict(data | {f"w{k}": pa.array([first[i], *moved[:, i]], pa.float64()) for i, k in enumerate(LABELS)})

    known = train.where(F.col("label").isin(*LABELS)).select(*columns)
    sums = known.mapInArrow(run, STATE).groupBy("slot").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in LABELS]).collect()  # a row a slot
    total = next((r["w0"] for r in sums if r.slot < 0), 0.0)
    out = weights.copy()
    for r in sums:
        if r.slot >= 0:
            out[r.slot] += np.array(r[1:]) / total
    return out


def scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Predictions as ``(review_id, logits, aspect_idx, label, predicted)``."""
    bounded_batches(rows.sparkSession)
    shared, kinds = rows.sparkSession.sparkContext.broadcast(weights), rows.select("review_id", "aspect_idx", "label").schema
    columns = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [np.log(_chances(shared.value, *v)).tolist() for v in _vectors(batch.column("slots"), len(shared.value))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(logits, pa.list_(pa.float64()))], names=[*columns, "logits"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return with_predictions(rows.select(*columns, "slots").mapInArrow(run, f"{ddl}, logits array<double>"))


def stored_state(spark, path: str, number: int, slots: int = SLOTS) -> np.ndarray:
    """The weights after a pass."""
    out = np.zeros((slots, len(LABELS)))
    rows = spark.read.schema(STATE).parquet(f"{path}/pass={number}").collect()  # at most a row a slot
    if rows:
        out[[r.slot for r in rows]] = np.array([r[1:] for r in rows])
    return out


def train_in_passes(
    train: DataFrame, validation: DataFrame, path: str, passes: int = PASSES, slots: int = SLOTS, step: float = STEP
) -> tuple[int, list[float]]:
    """Train, store every state below ``path`` and return the best pass (from 1, the first of equals) and all macro-F1.

    Both tables are ``prepared``; balance the classes by drawing the rows or by ``weight``, not both.
    """
    spark, weights, reached = train.sparkSession, np.zeros((slots, len(LABELS))), []
    tasks = shuffle_partitions(spark)
    for number in range(1, passes + 1):
        # Dealt and ordered by a hash of its own in each pass, so no task sees the same rows in the same order twice.
        order = F.xxhash64(F.lit(number), "review_id", "aspect_idx")
        dealt = train.withColumn("_order", order).repartition(tasks, "_order").sortWithinPartitions("_order").drop("_order")
        weights = one_pass(dealt, weights, step / np.sqrt(number))
        used = np.flatnonzero(weights.any(axis=1))
        rows = [(int(s), *map(float, weights[s])) for s in used]
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/pass={number}")
        reached.append(macro_f1(scored(validation, weights)).first()["macro_f1"] or 0.0)
    return 1 + int(np.argmax(reached)), reached
