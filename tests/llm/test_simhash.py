import numpy as np
import pytest
import xxhash

from pulsegrid.llm import simhash as S
from pulsegrid.llm.components import forest

from .fixtures import awkward, corpus, empty


def slow_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def test_fingerprint_equals_plain_count():
    for _, text in corpus(4, 60):
        assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint("") == 0 and S.fingerprint(" \n") == 0
    assert S.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_every_close_pair_meets_in_a_segment(segments):
    rng = np.random.default_rng(3)
    plan = S.plan(segments)
    assert sum(r + 1 for *_, r in plan) == S.DISTANCE + 1 and sum(w for _, w, _ in plan) == 64
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(((x ^ y) >> s & (1 << w) - 1).bit_count() <= r for s, w, r in plan)


@pytest.mark.parametrize("how", [{}, {"segments": 2}, {"segments": 5}, {"block": 3}, {"segments": 2, "block": 2}])
def test_links_equal_brute_force(spark, how):
    rows = corpus(2, 220)
    got = sorted(map(tuple, S.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()))
    prints = [slow_fingerprint(t) for _, t in rows]
    assert got == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, reach([i for i, _ in rows], prints), strict=True))


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_crowded_keys_keep_every_link(spark, block):
    """A family within few bits of one fingerprint, and others that share a segment with it."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    flip = lambda x, n, low, high: x ^ sum(1 << int(b) for b in rng.choice(np.arange(low, high), n, replace=False))
    prints = [flip(base, int(rng.integers(0, 5)), 0, 64) for _ in range(150)] + [flip(base, int(rng.integers(8, 20)), 24, 64) for _ in range(250)]
    prints += [flip(p, 3, 24, 64) for p in prints[150:200]]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints], "fp long")
    roots = {r["class"]: r["root"] for r in S.links(nodes, 3, block=block).collect()}
    want = reach(list(range(len(prints))), prints)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    got = [roots.get(s, s) for s in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_copies_of_one_text_are_dealt_out(spark):
    rows = [(i, "the same text again and again") for i in range(3000)] + [(5000 + i, f"w{i} x{i} y{i} z{i} a{i} b{i}") for i in range(200)]
    got = S.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id < 5000 and component_id = 0").count() == 3000 and got.count() == 3200


def test_awkward_rows(spark):
    got = S.link(awkward(spark))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()]
    assert len(rows) == 9 and {r[2] for r in rows if r[0] is None} == {None}
    assert {r for r in rows if r[0] in (1, 2, 3)} == {(k, "0" * 16, 1) for k in (1, 2, 3)}
    assert [r[2] for r in rows if r[0] == 5] == [5, 5]
    assert S.link(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.plan(6)


def test_forest():
    a, b = np.array([5, 9, 7, 1, 3]), np.array([9, 7, 5, 2, 4])
    assert sorted(zip(*(x.tolist() for x in forest(a, b)), strict=True)) == [(2, 1), (4, 3), (7, 5), (9, 5)]
    assert len(forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
