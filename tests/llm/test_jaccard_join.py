import numpy as np
import pytest

from pulsegrid.llm import jaccard_join as J

from .fixtures import awkward, corpus, empty


def brute(rows, width=5, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def linked(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, J.link(df, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"light": 2, "bucket": 2000}, {"light": 30, "hot": 4}])
def test_equals_brute_force(spark, how):
    rows = corpus(1, 260)
    assert linked(spark, rows, **how) == brute(rows)


@pytest.mark.parametrize("letters,most", [("abc", 9), ("ab", 30)])
def test_tiny_sets_and_deletion_neighbourhoods(spark, letters, most):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list(letters), rng.integers(0, most)))) for i in range(200)]
    assert linked(spark, rows, light=2) == brute(rows)


def test_other_threshold(spark):
    rows = corpus(3, 150)
    assert linked(spark, rows, percent=90) == brute(rows, percent=90)
    with pytest.raises(ValueError):
        J.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=10)


def test_large_group_of_near_copies(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(300)]
    assert {r[2] for r in linked(spark, rows)} == {0}


def test_awkward_rows(spark):
    got = {(r[0], r[2]) for r in J.link(awkward(spark)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (None, None), (9, 9)}
    assert J.link(awkward(spark)).count() == 9
    assert J.link(empty(spark)).count() == 0


def test_bands_hold_every_partner():
    bands = J.Bands(75)
    for n in range(1, 3000):
        least = -(-75 * n // 100)
        assert bands.of(n) - bands.of(least) <= 1
        assert bands.segments(bands.of(n)) > J.most_different(n)


def test_a_group_says_whether_it_has_more_pairs(spark):
    """Only such a group is looked at again once its components have grown."""
    rows = [(1, 1, 1), (1, 2, 2), (2, 3, 3), (2, 4, 3), (2, 5, 5)]
    groups = spark.createDataFrame([(*r, True, 40, bytes(J.SKETCH)) for r in rows], "set long, class long, comp long, own boolean, n long, sketch binary")
    got = {(r.a, r.b) for r in J.close_pairs(groups, 75, best=True).where("margin >= 0").collect()}
    assert len(got) == 2 and (1, 2) in got and got < {(1, 2), (3, 5), (4, 5)}
    assert [r.a for r in J.close_pairs(groups, 75, best=True).where(f"margin = {J.MORE}").collect()] == [2]
    assert {(r.a, r.b) for r in J.close_pairs(groups, 75).collect()} == {(1, 2), (3, 5), (4, 5)}
