from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, documents, empty, sentence

from kuchikomi.llm import sharding as sh


def check_law(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in rows} <= {"rows"} and {r.grown_shard for r in rows} <= {None}


def uncut(shard_of, groups):
    """Share of the links between copies that stay inside a shard."""
    inside = sum(n * (n - 1) for g in groups for n in Counter(shard_of[i] for i in g).values())
    return inside / sum(len(g) * (len(g) - 1) for g in groups)


def groups_of(texts):
    found = defaultdict(list)
    for i, t in enumerate(texts):
        if t:
            found[t].append(i)
    return [g for g in found.values() if len(g) > 1]


@pytest.mark.parametrize("case", ["pairs", "mixed", "hot"])
def test_even_shards_and_few_cuts(spark, case):
    rng = random.Random(3)
    base = [sentence(rng, 12) for _ in range(300)]
    texts = {"pairs": base + base, "mixed": base + base[:60] * 2, "hot": base + [base[0]] * 150}[case]
    rng.shuffle(texts)
    rows = sh.balanced_shards(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    check_law(rows, 8)
    groups, final = groups_of(texts), {r.doc_id: r.shard for r in rows}
    assert uncut(final, groups) >= {"pairs": 0.6, "mixed": 1.0, "hot": 0.2}[case]
    assert uncut({i: i % 8 for i in final}, groups) < 0.15
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_grants_by_definition():
    asked = {(0, 1): 10, (1, 0): 4, (2, 1): 6}
    granted = sh._granted(asked, [0, 5, 0])
    assert granted[1, 0] == 4 and granted[0, 1] == 4 + 2 and granted[2, 1] == 0 + 2
    assert sum(granted[s, t] - min(asked[s, t], asked.get((t, s), 0)) for s, t in asked if t == 1) <= 5


def test_quotas():
    assert sh.quotas(10, 8) == [2, 2, 1, 1, 1, 1, 1, 1] and sh.quotas(0, 2) == [0, 0]


def test_awkward_rows(spark):
    rows = sh.balanced_shards(awkward(spark)).collect()
    assert len(rows) == 12
    check_law(rows, 8)
    assert {r.size for r in rows if r.doc_id in (3, 4, 10)} == {1}
    assert sh.balanced_shards(empty(spark)).collect() == []
    few = sh.balanced_shards(documents(spark, ["a", "a", "b"])).collect()
    assert len({r.shard for r in few}) == 3


def test_no_python_on_executors(spark):
    plan = sh.balanced_shards(documents(spark, ["a", "a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
