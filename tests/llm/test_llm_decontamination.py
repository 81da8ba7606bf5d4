from __future__ import annotations

import random

import pytest
from cases import awkward, documents, empty, items, sentence

from kuchikomi.llm import decontamination as dc


def brute(texts, benchmark, window):
    out = {}
    known = [(i, dc.words(t)) for i, t in benchmark if t is not None]
    for doc, text in enumerate(texts):
        found, hit, ids = dc.words(text or ""), set(), set()
        for item, words in known:
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                for j in range(len(found) - n + 1):
                    if found[j : j + n] == words[i : i + n]:
                        hit.update(range(j, j + n))
                        ids |= {str(item)} - {"None"}
        out[doc] = (len(found), sorted(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block_windows", [200_000, 5])
def test_against_all_positions(spark, block_windows):
    rng = random.Random(7)
    benchmark = [(i, sentence(rng, rng.randint(1, 18))) for i in range(12)] + [(50, "of the"), (51, "..."), (52, None), (None, "an id of none"), (None, "re the ha of ing"), (53, "of the"), (3, "THE, end of it")]
    texts = []
    for _ in range(80):
        parts = [sentence(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += [(rng.choice(benchmark[:12])[1]).replace(" ", rng.choice([" ", ", ", "\n"])), sentence(rng, rng.randint(0, 9))]
        texts.append(" ".join(parts))
    texts += [None, "", "OF THE", "so re the HA of ing"]
    rows = dc.occurrences(documents(spark, texts), items(spark, benchmark), window=6, block_windows=block_windows).collect()
    assert {r.doc_id: (r.n_words, r.hits, r.item_ids) for r in rows} == brute(texts, benchmark, 6)
    clean = dc.clean(documents(spark, texts), items(spark, benchmark), 6, block_windows).collect()
    assert {r.doc_id for r in clean} == {i for i, v in brute(texts, benchmark, 6).items() if not v[1]}


def test_shifts_skip_positions():
    words = [[b"%d" % i for i in range(10)]]
    machine = dc.WuManber(10, words, [["a"]])
    assert machine.jump == 9 and machine.shift[(b"8", b"9")] == 0 and machine.shift[(b"0", b"1")] == 8
    assert [at for at, _ in machine.search([b"x"] * 7 + words[0] + [b"y"])] == [7]


def test_awkward_rows(spark):
    rows = dc.contamination(awkward(spark), items(spark, [(1, "the thing ha"), (2, None)])).collect()
    assert len(rows) == 12
    hit = {r.doc_id: r for r in rows if r.contaminated}
    assert set(hit) == {2**60 + 1, 9} and hit[9].n_hit == 3 and hit[9].n_items == 1
    assert dc.contamination(empty(spark), items(spark, [(1, "a")])).collect() == []
    assert not any(r.contaminated for r in dc.contamination(awkward(spark), items(spark, [])).collect())
    nameless = [r for r in dc.contamination(awkward(spark), items(spark, [(None, "the thing ha")])).collect() if r.contaminated]
    assert {(r.doc_id, r.n_hit, r.n_items) for r in nameless} == {(2**60 + 1, 3, 0), (9, 3, 0)}
    long = documents(spark, ["of the ing " * 60_000 + "so it ends"])
    assert dc.contamination(long, items(spark, [(1, "so it ends")])).first().n_hit == 3
    assert dc.clean(awkward(spark), items(spark, [])).count() == 12
