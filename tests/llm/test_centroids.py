import hashlib
import math

import numpy as np
import pytest

from pulsegrid.llm import centroids as C


def brute(rows, clusters=40, rounds=5, size=64):
    """Plain integers: whole distances in every round."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    now = [v for _, v in start]
    if not now:
        return []
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for k in range(rounds + 1):
        own = [min(range(len(now)), key=lambda c, v=v: (far(v, now[c]), c)) for _, v in kept]
        if k < rounds:
            for c in range(len(now)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    now[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    d = [far(v, now[o]) for (_, v), o in zip(kept, own, strict=True)]
    each = [sum(x for x, o in zip(d, own, strict=True) if o == c) for c in range(len(now))]
    return [(i, o, x, each[o], sum(d), hashlib.sha256(",".join(map(str, now[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, d, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 25)])
def test_equals_brute_force(spark, seed, n):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    rows = [(i, (middle[i % 12] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]
    rows += [(900 + k, rows[0][1]) for k in range(40)]  # a very common vector, ties between centroids
    rows += [(3, rows[3][1]), (None, rows[5][1])]  # a repeated row, a row without an id
    rows += [(7000, None), (7001, [1.0] * 63), (7002, [None] + [1.0] * 63), (7003, [float("nan")] + [1.0] * 63), (7004, [float("inf")] + [1.0] * 63), (7005, [])]
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance double").repartition(3)
    assert order(C.cluster(df).collect()) == order(brute(rows))


def test_float_vectors_and_other_parameters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = C.cluster(df, size=8, clusters=5, rounds=3)
    assert dict(got.dtypes)["vec_id"] == "int"
    assert order(got.collect()) == order(brute(rows, 5, 3, 8))


def test_products_take_up_changes_only():
    rng = np.random.default_rng(6)
    v, old = rng.integers(-300, 300, (20, 64)).astype(np.int32), rng.integers(-300, 300, (7, 64))
    new = old.copy()
    new[2, [3, 60]] += 5
    new[4] -= 1
    assert (C.moved(v, v.astype(np.int64) @ old.T, new - old) == v.astype(np.int64) @ new.T).all()


def test_no_rows_and_large_components(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert C.cluster(none).count() == 0 and C.cluster(none).columns[1] == "cluster"
    assert C.cluster(spark.createDataFrame([(None, [1.0] * 64)], none.schema)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 64)], none.schema)).count()
