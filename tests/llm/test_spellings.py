import random
import re
import time
import zlib
from collections import Counter

import pytest

from pulsegrid.llm import spellings as W

from .fixtures import awkward, empty


def counts(rows, noise=31, least=7, most=2):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= most}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def brute(rows):
    n = counts(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in W.group_spellings(df).collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abé", k=rng.randint(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "Straße×÷ÿ" * 2]
    weights = [rng.choice([1, 1, 1, 30, 400]) for _ in vocabulary]

    def spoilt(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]]) if rng.random() < 0.15 else w

    rows = [(i, " 1".join(spoilt(w).upper() if rng.random() < 0.1 else spoilt(w) for w in rng.choices(vocabulary, weights, k=60))) for i in range(150)]
    got = grouped(spark, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_chains_end_at_their_last_form(spark):
    rows = [(None, " ".join(["abcdefgh"] * 2000 + ["abcdefgx"] * 200 + ["abcdefyx"] * 20 + ["abcdezyx"] * 2))]
    assert {(r[0], r[2]) for r in grouped(spark, rows)} == {(w, "abcdefgh") for w in ("abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx")}


@pytest.mark.parametrize("n", [62, 63, 64, 65, 66, 300])
def test_long_words_meet_as_short_ones_do(spark, n):
    rng = random.Random(n)
    base = "".join(rng.choices("abcdefgh", k=n))
    words = [base, base[:20] + base[21:], base[: n // 2] + "z" + base[n // 2 :], base[:-1] + "z", "y" + base, base[::-1]]
    rows = [(None, " ".join([words[0]] * 40 + words[1:] * 2))]
    assert grouped(spark, rows) == brute(rows)


def test_two_very_long_words(spark):
    start, base = time.time(), "abcdefghij" * 40_000
    rows = [(None, " ".join([base] * 30 + [base[:777] + "x" + base[778:]] * 2))]
    got = {len(r[0]): r for r in grouped(spark, rows) if "x" in r[0]}
    assert got[400_000][1] == base and got[400_000][4] == 1
    assert time.time() - start < 60


def test_awkward_rows(spark):
    got = {r.word: r.n for r in W.group_spellings(awkward(spark)).collect()}
    assert got == {w: 4000 for w in ("consectetur", "adipiscing")}
    assert W.group_spellings(empty(spark)).count() == 0
