import random
import zlib

import numpy as np
import pytest

from pulsegrid.llm import language as G
from pulsegrid.llm import toxicity as T

from .fixtures import awkward, empty


def near(a, b):
    """Whether one edit at most parts the words."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1] <= 1


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = ["abcab", "bcabca", "aaaaa", "abab", "cabbac"]
    walk = T.Automaton(terms, [])
    for _ in range(6000):
        w = "".join(rng.choices("abc", k=rng.randint(0, 8)))
        want = w in terms or any(len(t) >= T.FUZZY_LEN and near(w, t) for t in terms)
        got = walk.classify(w)
        assert (got is not None) == want
        if got:
            assert (got[1] == 0) == (w in terms) and (got[0] == w or near(got[0], w))


def test_stems_start_words():
    walk = T.Automaton(["moron"], ["lowei"])
    assert walk.classify("loweixyz") == ("lowei", 0) and walk.classify("lowex") is None and walk.classify("mor0n") == ("moron", 1)


def test_quotation_counts_less():
    s = T.Scorer({"moron": (False, 5.0)})
    abuse, quoted = s.features("you are a moron here"), s.features('he said "you moron" and left')
    assert abuse[0] > 0 and abuse[1] == 0 and quoted[0] == 0 and quoted[1] > 0 and quoted[3] < abuse[3]
    assert s.features("") == [0.0] * len(T.FEATURES)


def talk(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bad = ["foolio", "grumbus", "snarkel"]
    docs, labels = [], []
    for i in range(size):
        w, toxic = rng.choices(words, k=rng.randint(20, 80)), int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                t = rng.choice(bad)
                w[rng.randrange(len(w))] = t if rng.random() < 0.8 else t[:2] + "x" + t[3:]
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = talk(2, 900)
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.learn(frame, marks)
    assert {"foolio", "grumbus", "snarkel"} <= set(model.lexicon)
    scores = {r.doc_id: r.score for r in model.score(frame).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(scores[i] >= T.THRESHOLD) == bool(dict(labels)[i]) for i in held]
    assert np.mean(right) > 0.97
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id long, toxic int")
    assert np.allclose(T.learn(frame, other).weights, model.weights)
    kept = {r.doc_id for r in model.reject(frame).collect()}
    assert kept == {i for i in scores if scores[i] < T.THRESHOLD}
    assert model.score(awkward(spark)).count() == 9 and model.score(empty(spark)).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.learn(awkward(spark), none).score(awkward(spark)).collect()
    assert len(got) == 9 and {r.score for r in got} == {0.5}
    assert T.learn(empty(spark), spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")).score(empty(spark)).count() == 0


def speech(seed, size):
    rng = random.Random(seed)
    sounds = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ung", "keit", "ß"], "fr": ["eau", "é", "que", "oi"], "es": ["ción", "ñ", "ado", "que"]}
    return [(i, " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang) for i in range(size) for lang in [rng.choice(list(sounds))]]


def test_language_on_held_out_rows(spark):
    rows = speech(3, 600)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in G.learn(frame).classify(frame).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_every_labelled_language_is_learned(spark, monkeypatch):
    # Seventy languages with an alphabet each, the last ones rarer than all others.
    monkeypatch.setattr(G, "IN_ALL", 1400)
    rng = random.Random(6)
    sounds = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(70)]
    rows = [(lang * 100 + k, " ".join(sounds[lang] for _ in range(rng.randint(3, 9))), f"x{lang:02d}") for lang in range(70) for k in range(30 if lang < 65 else 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.learn(frame)
    assert model.languages == [f"x{lang:02d}" for lang in range(70)]
    assert all(model.predict(text)[0] == lang for _, text, lang in rows[-40:])


def test_language_awkward_rows(spark):
    got = G.learn(awkward(spark)).classify(awkward(spark)).collect()
    assert len(got) == 9 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in G.learn(empty(spark)).classify(awkward(spark)).collect()} == {"und"}
    assert G.learn(awkward(spark)).classify(empty(spark)).count() == 0


def test_vector_counts_over_strides(monkeypatch):
    text = "abcdefghij" * 50
    whole = G.vector(text)
    monkeypatch.setattr(G, "STRIDE", 7)
    assert np.allclose(G.vector(text), whole) and np.isclose(np.linalg.norm(whole), 1)


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_machine_separates(share):
    rng = np.random.default_rng(0)
    y = np.where(rng.random(300) < share, 1.0, -1.0)
    x = rng.normal(size=(300, 10)) + 2 * y[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = G.fit_machine(x.astype(np.float32), y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_machine_of_few_rows_is_the_same():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(60) < 0.3, 1.0, -1.0)
    x = rng.normal(size=(60, 40)) + y[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Columns of zeros change nothing but which way is taken.
    assert np.allclose(G.fit_machine(x, y)[[*range(40), -1]], G.fit_machine(np.c_[x, np.zeros((60, 40))], y)[[*range(40), -1]], atol=1e-9)
