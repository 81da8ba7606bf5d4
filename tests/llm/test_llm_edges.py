"""Very long texts and many rows under one id, for the operators whose own tests have neither."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import documents, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kuchikomi.llm import bpe, fingerprints, packed_ids, pitman_yor, quality, secret_scan, sharding, token_counts


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    long = [sentence(rng, 40_000), "xy9" * 30_000, "语料清洗" * 5_000 + "été " * 30_000]
    return long + [sentence(rng, rng.randint(1, 8)) for _ in range(240)] + ["the same text"] * 60


@pytest.fixture
def docs(spark, texts):
    """Two in three rows under one id, half of the others under none; an order of their own tells them apart."""
    rows = documents(spark, texts).withColumn("own", F.col("doc_id"))
    one = F.when(F.col("own") % 3 > 0, F.lit(7)).when(F.col("own") % 2 == 0, F.col("own"))
    return rows.withColumn("doc_id", one.cast("long"))


def ids_of_rows(texts):
    return [7 if i % 3 else i if i % 2 == 0 else None for i in range(len(texts))]


def test_encoded_and_counted_as_the_library_does(docs, texts, library):
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    key = lambda row: tuple((x is None, x) for x in row)
    rows = bpe.digests(docs).select("doc_id", "n_tokens", "ids_sha256").collect()
    wanted = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in zip(ids_of_rows(texts), ids)]
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)
    counted = token_counts.counted(docs).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(tuple, counted), key=key) == sorted(((d, len(t.encode()), len(i)) for d, t, i in zip(ids_of_rows(texts), texts, ids)), key=key)
    packed = packed_ids.file_digests(docs).select("doc_id", "n_tokens", "ids_crc32").collect()
    ended = [np.array([*i, packed_ids.END_ID], "<u4") for i in ids]
    assert sorted(map(tuple, packed), key=key) == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in zip(ids_of_rows(texts), ended)), key=key)


def test_fingerprints_of_every_row(docs, texts):
    rows = fingerprints.compared(docs).collect()
    assert len(rows) == len(texts) and sorted(r.n_chars for r in rows) == sorted(map(len, texts))
    assert all(0 < r.near_edited <= 1 for r in rows if r.n_chars > 60_000)
    assert len({r.fingerprint for r in rows if r.n_chars == len("the same text")} & {r.fingerprint for r in rows}) >= 1


def test_shards_stay_even(docs, texts):
    rows = sharding.balanced_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sorted(r.size for r in rows) == sorted(len(t.encode()) + 1 for t in texts)


def test_scores_of_every_row(spark, docs, texts):
    rows = pitman_yor.held_out_scores(docs).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(t.encode().translate(pitman_yor.FOLD).split()) + 1 for t in texts)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 6)], "doc_id long, quality int, toxic int")
    judged = quality.judged(docs, marks).collect()
    assert len(judged) == len(texts) and max(r.n_symbols for r in judged) > 90_000
    assert quality.filtered(docs, marks).columns == docs.columns
    assert secret_scan.digests(docs).count() == len(texts)
