"""Token counts, packed ids and BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import awkward, documents, empty, sentence

from kuchikomi.llm import bpe, packed_ids, token_counts
from kuchikomi.llm.rows import texts
from kuchikomi.llm.vocabulary import Vocabulary, default_path

ALPHABET = list("abcdeeiosstt  '") + list("ÀéßΣσİıſﬁ中文字ไทยनि́̈\x1c\x85   ​﻿12²½Ⅷ_-!?<|>") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "\n", "😀", "👍🏽"]


@pytest.fixture(scope="module")
def file():
    with open(default_path(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(file):
    return Vocabulary(file).library


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(1)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    return odd + ["".join(rng.choice("aabehnstior") for _ in range(rng.randint(1, 80))) for _ in range(500)] + ["ab" * 400, "é" * 300, sentence(rng, 300)]


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_transducer_counts(file, library, fuzz):
    machine = token_counts.Transducer(file)
    for text in fuzz:
        n = len(ids_of(library, text))
        assert machine.between(text.encode()) == n
        for size in (1, 3, 8):
            maps = [machine.state_map(text[i : i + size].encode()) for i in range(0, len(text), size)] or [(b"", 0, None)]
            assert machine.total(maps) == n


def test_composition_is_associative(file):
    machine = token_counts.Transducer(file)
    a, b, c = (machine.state_map(t.encode()) for t in ("one thi", "ng", "s of the wor"))
    assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_encoder_ids_and_text(file, library, fuzz):
    encoder = bpe.Encoder(file)
    for text, ids in zip(fuzz, encoder.encode(fuzz)):
        expected = ids_of(library, text)
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)
    assert 0 < encoder.merged_words < len(encoder.words[0])


def test_compatibility_of_pairs(file):
    encoder = bpe.Encoder(file)
    v = encoder.vocabulary
    rng = random.Random(2)
    plain = [i for i in range(2000) if v.suffix not in v.names[i]]
    pairs = [(rng.choice(plain), rng.randrange(2000)) for _ in range(3000)]
    spelled = {i: v.trie and _spelled(v, i) for i in range(2000)}
    sound = [v.merge(spelled[a]) == [a] and v.merge(spelled[b]) == [b] for a, b in pairs]
    found = encoder.compatible(*(np.array(x) for x in zip(*pairs)))
    for (a, b), one, fine in zip(pairs, found, sound):
        assert one == v.compatible(a, b)
        if fine:
            assert one == (v.merge(spelled[a] + spelled[b]) == [a, b])


def _spelled(v, i):
    return [i] if v.parts[i] is None else _spelled(v, v.parts[i][0]) + _spelled(v, v.parts[i][1])


def test_token_counts_rows(spark, library):
    docs = awkward(spark)
    plain = {(r.doc_id, r.text) for r in texts(docs).collect()}
    for chunk_chars in (1 << 16, 50):
        rows = token_counts.token_counts(docs, chunk_chars=chunk_chars).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in set(rows)) == sorted({(str(i), len(t.encode()), len(ids_of(library, t))) for i, t in plain})
        assert len(rows) == 12
    assert token_counts.counted(empty(spark)).collect() == []


def test_bpe_rows(spark, library):
    rows = bpe.digests(awkward(spark)).collect()
    whole = {r.doc_id: r.text for r in texts(awkward(spark)).collect()}
    assert len(rows) == 12
    for r in rows:
        ids = ids_of(library, whole[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encodings = bpe.encoded(awkward(spark))
    again = {r.doc_id: r.decoded for r in bpe.decoded(encodings).collect()}
    assert again == {r.doc_id: r.decoded for r in encodings.collect()}
    assert bpe.digests(empty(spark)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 1000])
@pytest.mark.parametrize("most", [0, 1, 300, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, most):
    rng = np.random.default_rng(n)
    values = rng.integers(0, most, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
    values[rng.random(n) < 0.05] = most
    blob = packed_ids.pack(values)
    assert (packed_ids.unpack(blob) == values).all()
    for first, last in ((0, 1), (1, 3), (2, None), (50, 60)):
        stop = n if last is None else last * packed_ids.BLOCK
        assert packed_ids.unpack(blob, first, last).tolist() == values[first * packed_ids.BLOCK : stop].tolist()


def test_outliers_do_not_widen_blocks():
    small = np.arange(1280, dtype=np.uint32) % 16
    spiked = small.copy()
    spiked[::128] = 2**31
    assert len(packed_ids.pack(spiked)) < len(packed_ids.pack(small)) + 10 * 5 + 1
    with pytest.raises(ValueError):
        packed_ids.unpack(b"XXXX" + packed_ids.pack(small)[4:])


def test_files_hold_all_documents_in_order(spark, library):
    rng = random.Random(9)
    values = [sentence(rng, rng.randint(0, 40)) for _ in range(200)] + [None, ""]
    docs = documents(spark, values, first=5).repartition(6)
    rows = {r.doc_id: r for r in packed_ids.file_digests(docs).collect()}
    start = 0
    for i, text in enumerate(values):
        ids = np.array(ids_of(library, text or "") + [packed_ids.END_ID], "<u4")
        r = rows[5 + i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    back = packed_ids.read(packed_ids.write(docs)).collect()
    assert sum(len(r.ids) for r in back) == 4 * start


def test_packed_awkward_rows(spark):
    rows = packed_ids.file_digests(awkward(spark)).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows} >= {2**60 + 1, None}
    spans = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packed_ids.file_digests(empty(spark)).collect() == []


def test_library_encoder_looks_up_a_chunk_once(file, library, fuzz):
    encoder = packed_ids.LibraryEncoder(file)
    asked = []
    encoder.chunks = type("Asked", (dict,), {"__missing__": lambda self, c: asked.append(c) or encoder._chunk(c)})()
    texts_ = ["Same words, same words", " same  words,\tsame ", "", "words, Words. words"]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts_)] == [ids_of(library, t) for t in texts_]
    assert sorted(asked) == sorted(set(asked))
    assert [np.frombuffer(i, "<u4").tolist() for i in packed_ids.LibraryEncoder(file).encode(fuzz)] == [ids_of(library, t) for t in fuzz]


def test_texts_are_encoded_in_bounded_parts(monkeypatch, file, library):
    monkeypatch.setattr(packed_ids, "BYTES_AT_ONCE", 10)
    assert list(packed_ids._parts([4, 4, 4, 30, 1, 0])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    texts_ = ["one two", "a word longer than a part", "", "three"]
    assert [np.frombuffer(i, "<u4").tolist() for i in packed_ids.LibraryEncoder(file).encode(texts_)] == [ids_of(library, t) for t in texts_]


def test_python_gets_small_batches(spark):
    from kuchikomi.llm.rows import ARROW_ROWS, ROWS_AT_ONCE, per_row

    spark.conf.set(ARROW_ROWS, "10000")
    seen = per_row(spark.range(0, 5000, 1, 1), lambda b: b.assign(id=len(b)), "id long")
    assert int(spark.conf.get(ARROW_ROWS)) == ROWS_AT_ONCE and seen.distinct().count() == 1
    spark.conf.unset(ARROW_ROWS)


def test_encoder_holds_no_second_vocabulary(file, library, fuzz):
    """Cutting needs the file's normalizer and pre-tokenizer alone, and what is remembered stays within its bound."""
    encoder = bpe.Encoder(file, most_kept=20)
    ids = [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(fuzz * 2)]
    assert ids == [ids_of(library, t) for t in fuzz * 2]
    assert "library" not in vars(encoder.vocabulary) and encoder.vocabulary.cutter.get_vocab_size() == 0
    # Two generations; a part of 64 texts is always held whole.
    fresh = max(len({c for t in fuzz[i : i + 64] for c in t.encode("utf-8", "replace").split()}) for i in range(0, len(fuzz), 64))
    assert all(len(memory) <= 20 + 2 * fresh for memory in encoder.ids)
