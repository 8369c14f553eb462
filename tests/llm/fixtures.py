"""Rows that every text operator must take, and a generator of small corpora with near copies."""

import random

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 4000

AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\r ", "en", "a"), (4, LONG, None, "b"), (5, "one two three four five six seven", "fr", None),
    (5, "one two three four five six seven", "fr", None), (None, "a row without an id", "de", "c"), (None, None, None, None), (9, "naïve café — 日本語 🙂 ſecret K", "xx", "a"),
]
CLASHES = ("id", "class", "n", "score", "host", "bucket", "piece", "kept", "part", "template", "spans", "of")


def awkward(spark):
    """The rows, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return awkward(spark).limit(0)


def corpus(seed: int, size: int, words: int = 300, passage: int = 40) -> list[tuple[int, str]]:
    """Texts of mixed lengths, a third of them edited copies of earlier ones, half of the rest around one passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    common = rng.choices(vocabulary, k=passage)
    out: list[tuple[int, str]] = []
    for i in range(size):
        if rng.random() < 0.35 and out:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 20, 40, 80, 160]))
            if rng.random() < 0.5:
                w = w[:20] + common + w[20:]
        out.append((i * 7 % (size + 1), " ".join(w)))
    return out
