from __future__ import annotations

import hashlib
import random

import pytest
from cases import awkward, documents, empty, sentence

from kuchikomi.llm import fingerprints as fp


def brute(text: str, k: int, window: int) -> list[tuple[int, int]]:
    """Selected (position, hash) by definition, on the operator's own hashes."""
    hashes = fp.Winnower(k, window).hashes(fp.code_points(text)).tolist()
    width = min(window, len(hashes))
    chosen = []
    for i in range(len(hashes) - width + 1 if hashes else 0):
        part = hashes[i : i + width]
        at = max(j for j in range(width) if part[j] == min(part)) + i
        if not chosen or chosen[-1][0] != at:
            chosen.append((at, hashes[at]))
    return chosen


@pytest.mark.parametrize("text", ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc", sentence(random.Random(2), 60), "😀é" * 40])
def test_selection_by_definition(text):
    positions, hashes = fp.Winnower(5, 4).select(fp.code_points(text))
    assert list(zip(positions.tolist(), hashes.tolist())) == brute(text, 5, 4)


def test_hash_depends_on_the_run_alone():
    h = fp.Winnower(6, 4).hashes(fp.code_points("xyzabcdefuvwabcdef"))
    assert h[3] == h[12] and len(set(h.tolist())) == len(h) - 1


def test_shared_runs_are_found():
    rng = random.Random(3)
    winnower = fp.Winnower(8, 5)
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh") for _ in range(8 + 5 - 1))
        a, b = ("".join(rng.choice("ijkl") for _ in range(rng.randint(0, 40))) for _ in range(2))
        own, other = (set(winnower.select(fp.code_points(x))[1].tolist()) for x in (a + shared + b, b + shared + a))
        assert own & other


def test_compared_against_definition(spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(0, 80)) for _ in range(60)] + [None, "", "x"]
    docs = documents(spark, texts, first=10).repartition(5)
    rows = {r.doc_id: r for r in fp.compared(docs, k=6, window=5).collect()}
    assert sorted(rows) == list(range(10, 73))
    winnower = fp.Winnower(6, 5)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, following = (winnower.select(fp.code_points(t)) for t in (text, changed, after))
        r = rows[10 + i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.written(*own), fp.written(*other))
        assert (r.near_edited, r.near_next) == (fp.likeness(own[1], other[1]), fp.likeness(own[1], following[1]))


def test_awkward_rows(spark):
    rows = fp.compared(awkward(spark)).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows} >= {2**60 + 1, None}
    same = {r.fingerprint for r in rows if r.doc_id in (7, 8)}
    assert len(same) == 1 and {r.fingerprint for r in rows if r.doc_id in (3, 4, 10)} == {""}
    assert fp.compared(empty(spark)).collect() == []
    (one,) = fp.compared(documents(spark, ["abcdef"])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_positions_are_kept(spark):
    (row,) = fp.fingerprints(documents(spark, ["abcdefgh" * 20]), k=4, window=3).collect()
    assert row.positions == sorted(row.positions) and len(row.positions) == len(row.hashes) > 20


def test_short_half_edited_texts_stay_alike():
    rng = random.Random(6)
    winnower = fp.Winnower()
    for n in range(2 * (fp.K + fp.WINDOW - 1), 200):
        text, after = ("".join(rng.choice("abcdefghij klmnopq") for _ in range(n)) for _ in range(2))
        own, other = (winnower.select(fp.code_points(t)) for t in (text, fp.edited(text, after)))
        assert fp.likeness(own[1], other[1]) > 0
    assert 2 * (fp.K + fp.WINDOW - 1) < 50


def test_written_fingerprints_can_be_read():
    for text, k, window in [("", 8, 16), ("ab", 8, 16), (sentence(random.Random(7), 300), 8, 16), (sentence(random.Random(7), 3000), 8, 1500)]:
        positions, hashes = fp.Winnower(k, window).select(fp.code_points(text))
        back = fp.read(fp.written(positions, hashes))
        assert back[0].tolist() == positions.tolist() and back[1].tolist() == hashes.tolist()
