"""Toxicity scores from a learned lexicon that also catches misspelled terms.

The lexicon (whole terms, and stems that start terms) comes from labelled documents by a
likelihood-ratio test.  Terms form a trie; its intersection with the Levenshtein automaton of each
term is walked as one deterministic automaton whose states are sets of (trie node, edits so far),
made as words need them.  What stands around a hit decides whether it counts as quoted or as
abuse; a logistic regression over the hits turns them into a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import scan, table

#: Labelled documents of each label that the fit reads at most, by the order of a hash.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 20_000
#: Terms that the lexicon holds at most, and what a term must show: documents, log odds, likelihood ratio.
LEXICON, LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 400, 3, 2.0, 18.0
#: Characters of stems; terms of at least FUZZY_LEN characters may be one edit off.
STEMS, FUZZY_LEN = (4, 5, 6), 5
#: Words on each side that are read as a hit's context.
CONTEXT = 6
#: Words whose hits a worker remembers, none of more than CACHED characters.
CACHE, CACHED = 200_000, 40
THRESHOLD = 0.7

# Marks around words; words that report speech; words that address someone.
EDGES = ".,;:!?()[]{}<>|*%&$#/\\-_~+=…¡¿'\"“”„«»‘’`"
QUOTES = "\"“”„«»"
REPORTS = frozenset("said says say wrote writes called calls quoted quote quotes reported according sagte sagt schrieb zitierte nannte dit disait écrit appelé dijo dice escribió llamó".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch euer tu te toi ton vous votre tú ti usted ustedes vosotros".split())

FEATURES = ("abuse", "quoted", "fuzzy", "top", "density", "distinct", "addressed")


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Automaton:
    """Deterministic walk of a term trie with at most one edit; ``classify`` gives ``(term, edits)`` or None."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int] | None] = [None]  # term and the edits it allows
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # whether a term that allows an edit lies below
        for t in terms:
            edits = int(len(t) >= FUZZY_LEN)
            node = self._add(t, bool(edits))
            self.ends[node] = (t, edits)
        for s in stems:
            self.stem[self._add(s, False)] = s
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _add(self, word: str, fuzzy: bool) -> int:
        node = 0
        self.fuzzy[0] |= fuzzy
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.stem.append(None)
                self.fuzzy.append(False)
            node = self.children[node][c]
            self.fuzzy[node] |= fuzzy
        return node

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The state of a set, with the places that a left-out letter reaches; -1 for none."""
        items = items | {(k, 1) for n, e in items if e == 0 for k in self.children[n].values() if self.fuzzy[k]}
        key = frozenset(items)
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            done = [(e, self.ends[n][0]) for n, e in key if self.ends[n] and e <= self.ends[n][1]]
            self.final.append((min(done)[1], min(done)[0]) if done else None)
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for n, e in self.sets[state]:
            if c in self.children[n]:
                k = self.children[n][c]
                if e == 0 or self.fuzzy[k]:
                    out.add((k, e))
            if e == 0:
                if self.fuzzy[n]:
                    out.add((n, 1))
                out.update((k, 1) for k in self.children[n].values() if self.fuzzy[k])
        self.next[state][c] = made = self._state(out)
        return made

    def classify(self, word: str) -> tuple[str, int] | None:
        state, node, stem = self.start, 0, None
        for c in word:
            if node >= 0:
                node = self.children[node].get(c, -1)
                if node >= 0 and self.stem[node]:
                    stem = self.stem[node]
            if state >= 0:
                after = self.next[state].get(c)
                state = self.step(state, c) if after is None else after
            if state < 0 and node < 0:
                break
        found = self.final[state] if state >= 0 else None
        if found and (found[1] == 0 or not stem):
            return found
        return (stem, 0) if stem else None


class Scorer:
    """Feature vectors of texts under a lexicon ``{term: (is_stem, log odds)}``."""

    def __init__(self, lexicon: dict[str, tuple[bool, float]]):
        self.odds = {t: o for t, (_, o) in lexicon.items()}
        self.walk = Automaton([t for t, (s, _) in lexicon.items() if not s], [t for t, (s, _) in lexicon.items() if s])
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        own = set(words)
        new = own - self.seen
        if new:
            if len(self.seen) > CACHE:
                self.seen, self.hits = set(), {}
                new = own
            self.seen.update(w for w in new if len(w) <= CACHED)
            for w in new:
                found = self.walk.classify(w.strip(EDGES))
                if found:
                    self.hits[w] = found
        known = self.hits.keys() & own
        if not known:
            return [0.0] * len(FEATURES)
        abuse = quoted = fuzzy = addressed = 0.0
        top, kinds = 0.0, set()
        for k, w in enumerate(words):
            if w not in known:
                continue
            term, edits = self.hits[w]
            weight = self.odds[term]
            near = words[max(0, k - CONTEXT) : k] + words[k + 1 : k + 1 + CONTEXT]
            before = "".join(words[max(0, k - 4 * CONTEXT) : k]) + w[: len(w) - len(w.lstrip(EDGES))]
            marks = sum(before.count(q) for q in QUOTES)
            quotation = marks % 2 == 1 or any(x.strip(EDGES) in REPORTS for x in near)
            direct = any(x.strip(EDGES) in ADDRESS for x in near)
            kinds.add(term)
            top = max(top, weight * (0.5 if quotation else 1.0) * (0.5 if edits else 1.0))
            if edits:
                fuzzy += weight
            elif quotation:
                quoted += weight
            else:
                abuse += weight
            addressed += direct and not quotation
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), top, math.log1p(100 * (abuse + fuzzy) / len(words)), math.log1p(len(kinds)), math.log1p(addressed)]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, is_stem, toxic, clean)``: documents of ``(text, toxic)`` with each term, summed inside tasks first."""

    def run(batches):
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                whole = {w for w in (x.strip(EDGES) for x in set(words_of(text or ""))) if 4 <= len(w) <= 40}
                for key in {(w, False) for w in whole} | {(w[:n], True) for w in whole for n in STEMS if len(w) > n}:
                    counts.setdefault(key, [0, 0])[1 - label] += 1
                if len(counts) > 500_000:
                    yield flat(counts)
                    counts = {}
        if counts:
            yield flat(counts)

    def flat(counts):
        return table(term=[k[0] for k in counts], is_stem=[k[1] for k in counts], toxic=pa.array([v[0] for v in counts.values()], pa.int64()), clean=pa.array([v[1] for v in counts.values()], pa.int64()))

    parts = docs.select("text", "toxic").mapInArrow(run, "term string, is_stem boolean, toxic long, clean long")
    return parts.groupBy("term", "is_stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(counts: DataFrame, toxic_docs: int, clean_docs: int) -> dict[str, tuple[bool, float]]:
    """The terms most telling of toxic documents; a stem or term that a better stem starts is left out."""
    a, b = F.col("toxic"), F.col("clean")
    rate = (a + b) / F.lit(float(max(1, toxic_docs + clean_docs)))

    def part(seen: Column, size: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (rate * size))).otherwise(0.0)

    odds = F.log((a + 0.5) / (toxic_docs + 1)) - F.log((b + 0.5) / (clean_docs + 1))
    ratio = 2 * (part(a, toxic_docs) + part(b, clean_docs))
    good = counts.where(a >= LEAST_DOCS).withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
    # Equal evidence: the whole term before its stems, longer stems before shorter ones.
    top = good.orderBy(F.desc("ratio"), "is_stem", F.desc(F.length("term")), "term").limit(4 * LEXICON).collect()
    out: dict[str, tuple[bool, float]] = {}
    for r in top:
        covered = any(stem and r["term"].startswith(t) for t, (stem, _) in out.items())
        widens = r["is_stem"] and any(t.startswith(r["term"]) for t in out)
        if not covered and not widens and r["term"] not in out and len(out) < LEXICON:
            out[r["term"]] = (bool(r["is_stem"]), float(r["odds"]))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton steps on the ridge-penalised likelihood."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_rows(docs: DataFrame, id_col: str, text_col: str, scorer: Callable[[], Scorer], weights: np.ndarray, others: list[str]) -> DataFrame:
    """``(others, score)``: the score of every row's whole text."""

    def start():
        s = scorer()

        def one(part, texts):
            x = np.array([s.features(t) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            return table(**{c: part.column(c) for c in others}, score=score)

        return one

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", score double"
    return scan(docs, list(dict.fromkeys([*others, text_col])), text_col, schema, start)


class Model:
    """A lexicon with the weights of its features; holds no documents."""

    def __init__(self, lexicon: dict[str, tuple[bool, float]], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, score)`` of every row; null and empty texts get the score of a text without hits.

        Null ids and repeated rows stay; no row gives no row.  Other columns are not read.
        """
        return score_rows(docs, id_col, text_col, lambda: Scorer(self.lexicon), self.weights, [id_col])

    def reject(self, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """The rows, all columns of any names, that score under the threshold.

        Null and empty texts count as texts without hits; null ids stay, repeated rows stay or go together; no row gives no row.
        """
        model = self

        def start():
            s = Scorer(model.lexicon)

            def one(part, texts):
                x = np.array([s.features(t) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
                return part.filter(pa.array(p < threshold))

            return one

        return scan(docs, [F.col(f"`{c}`") for c in docs.columns], text_col, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes), start)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents whose id is not held out.

    The fit reads at most TOXIC_SAMPLE and CLEAN_SAMPLE labelled documents; with none of either label
    the lexicon is empty and every score is the share of toxic ones (one half without labels).
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # Bounded: two limits.
    picked = ids.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(TOXIC_SAMPLE).unionByName(ids.where("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(CLEAN_SAMPLE))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic")
    sample = materialise(sample, "toxic-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Model({}, np.r_[math.log(share / (1 - share)), np.zeros(len(FEATURES))])
    lexicon = learn_lexicon(term_counts(sample), toxic, clean)

    def start():
        s = Scorer(lexicon)
        return lambda part, texts: table(toxic=part.column("toxic"), x=pa.array([s.features(t) for t in texts], pa.list_(pa.float64())))

    # Seven numbers for each of the bounded sample's documents.
    rows = scan(sample, ["text", "toxic"], "text", "toxic int, x array<double>", start).toPandas()
    return Model(lexicon, fit_logistic(np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float)))
