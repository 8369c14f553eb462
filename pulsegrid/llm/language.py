"""Language identification by hierarchical discrimination.

A text's byte n-grams (one to three) are hashed into a vector of unit length.  Linear support vector
machines first choose the language family, then, inside it, each pair of languages has a machine
of its own and the language with most votes wins.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan, table

#: Length of the vectors; training documents of a language; of all languages together, unless that leaves a language fewer than FEWEST.
SIZE, PER_LANGUAGE, IN_ALL, FEWEST = 4096, 400, 25_600, 16
#: Bytes whose n-grams are counted at a time.
STRIDE = 1 << 20

# Families of common languages; one that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl sk cs pl",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tt tk",
    "uralic": "fi et hu",
}
FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs.split()}


def vector(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams over the whole text (a unit vector; zeros for an empty text)."""
    raw = text.lower().encode()
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(raw), STRIDE):
        # Two more bytes, so that n-grams over the edge count once.
        b = np.frombuffer(raw[at : at + STRIDE + 2], np.uint8).astype(np.uint32)
        one = b[:STRIDE]
        total += np.bincount((one * np.uint32(2654435761)) >> np.uint32(20), minlength=SIZE)
        if len(b) > 1:
            two = (b[:-1] * np.uint32(257) + b[1:])[:STRIDE]
            total += np.bincount((two * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(20), minlength=SIZE)
        if len(b) > 2:
            three = ((b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(263) + b[2:])[:STRIDE]
            total += np.bincount((three * np.uint32(3266489917) + np.uint32(13)) >> np.uint32(20), minlength=SIZE)
    return np.sqrt(total / max(1, total.sum())).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """A linear machine (weights, then intercept) for labels +1 and -1: squared hinge loss, both classes with equal weight, accelerated gradient."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    # Weights stay sums of rows: with fewer rows than weights, the rows' shares in them are found instead, from the rows' products.
    few = len(x) < x.shape[1]
    score = (x @ x.T).__matmul__ if few else x.__matmul__
    w = v = np.zeros(len(x) if few else x.shape[1], x.dtype)
    # Unit vectors and a one: the loss bends by 4 at most.
    for k in range(rounds):
        pull = -2 * share * y * np.maximum(0, 1 - y * score(v))
        new = v - ((pull if few else pull @ x) + ridge * v) / (4 + ridge)
        v = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w @ x if few else w


class Model:
    """Machines between families, and between the languages of each; small, sent to the tasks as it is."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        """``y`` indexes ``languages``."""
        self.languages = languages
        family = [FAMILY.get(lang.split("-")[0].lower(), lang) for lang in languages]
        self.families = sorted(set(family))
        self.members = [[k for k, f in enumerate(family) if f == g] for g in self.families]
        of = np.array([self.families.index(f) for f in family], np.int64)[y] if len(y) else np.zeros(0, np.int64)
        self.top = {(a, b): self._pair(x, of, a, b) for a, b in itertools.combinations(range(len(self.families)), 2)}
        self.inner = {(a, b): self._pair(x, y, a, b) for m in self.members for a, b in itertools.combinations(m, 2)}

    @staticmethod
    def _pair(x, y, a, b) -> np.ndarray:
        own = (y == a) | (y == b)
        return fit_machine(x[own], np.where(y[own] == a, 1.0, -1.0)).astype(np.float32)

    @staticmethod
    def _vote(v: np.ndarray, among: list[int], machines: dict) -> tuple[int, float]:
        """The choice with most votes, ties by the sum of margins, and its certainty: the weakest of its duels."""
        if len(among) == 1:
            return among[0], 1.0
        votes, least = dict.fromkeys(among, 0.0), dict.fromkeys(among, 1.0)
        for a, b in itertools.combinations(among, 2):
            w = machines[a, b]
            p = float(1 / (1 + np.exp(-4 * np.clip(v @ w[:-1] + w[-1], -7, 7))))
            votes[a] += (p >= 0.5) + p / 1e3
            votes[b] += (p < 0.5) + (1 - p) / 1e3
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(among, key=lambda k: votes[k])
        return best, least[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        v = vector(text)
        f, sure = self._vote(v, list(range(len(self.families))), self.top)
        k, inner = self._vote(v, self.members[f], self.inner)
        return self.languages[k], sure * inner

    def classify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, lang_pred, score)`` of every row; ``und`` with score 0 where the text is null or has no letter.

        Null ids and repeated rows stay; no row gives no row.  Other columns are not read.
        """

        def start():
            def one(part, texts):
                got = [self.predict(t) for t in texts]
                return table(**{id_col: part.column(id_col)}, lang_pred=pa.array([g[0] for g in got], pa.string()), score=pa.array([g[1] for g in got], pa.float64()))

            return one

        return scan(docs, [id_col, text_col], text_col, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double", start)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents with a language whose id is not held out.

    Every language with a labelled document is learned, from PER_LANGUAGE documents at most, or fewer where
    there are so many languages that they would be more than IN_ALL, by the order of a hash of the id; without
    any the model answers ``und``.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = own.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return Model([], np.zeros((0, SIZE)), np.zeros(0, np.int64))
    each = max(FEWEST, min(PER_LANGUAGE, IN_ALL // languages))
    # About twice the documents that are kept of each language, so that the last step has few rows.
    share = F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("count") + F.lit(1e-9)).alias("share")
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # One row for each language: without the hint, the texts of a large language would be one task.
    some = own.join(F.broadcast(counts.select("lang", share)), "lang").where(draw < F.col("share"))

    def start():
        def one(part, texts):
            return table(lang=part.column("lang"), draw=part.column("draw"), x=pa.array([vector(t).astype("<f4").tobytes() if has_letter(t) else None for t in texts], pa.binary()))

        return one

    rows = scan(some.withColumn("draw", draw), ["text", "lang", "draw"], "text", "lang string, draw double, x binary", start).where("x is not null")
    # Bounded: languages times the documents of each.
    order = Window.partitionBy("lang").orderBy("draw", "x")
    kept = rows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= each).select("lang", "x").collect()
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in kept]) if kept else np.zeros((0, SIZE), np.float32)
    seen = sorted({r["lang"] for r in kept})
    return Model(seen, x, np.array([seen.index(r["lang"]) for r in kept], np.int64))
