"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be met with up to k = floor(rate * n) edits.  Cut into k + 1 pieces, at
least one piece of it then occurs unchanged, so exact piece hits (one automaton pass over a document)
give every place worth checking; a bit-parallel edit distance over the window around it decides.
Items are taken in blocks of bounded size, so what tasks hold does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan, table

#: Edits allowed for each character of an item.
RATE = 0.05
#: Items shorter than this, normalised, must occur exactly, between spaces.
SHORT = 40
#: Normalised bytes of items in one pass over the documents.
BLOCK = 4 << 20

_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str) -> str:
    """Lower case, runs of ASCII other than letters and digits as one space; a character for each UTF-8 byte."""
    return b" ".join(text.lower().encode().translate(_KEPT).split()).decode("latin-1")


def distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edits between the pattern and any part of the text, and where that part ends; None beyond ``most``.

    Myers' bit-vectors: bit i of ``up`` (``down``) says that the column rises (falls) by one at row i.
    """
    size = len(pattern)
    if not size:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, (most + 1, 0)
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(x | up) & full, up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~((eq | down) | rise) & full, rise & (eq | down)
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


def budget(size: int, rate: float = RATE) -> int:
    return int(rate * size) if size >= SHORT else 0


class Matcher:
    """Finds a block of items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.pieces = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            k, n = budget(len(text), rate), len(text)
            own = f" {text} " if n < SHORT else text
            cuts = [len(own) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(own[a:b], []).append((len(self.items), a))
            self.items.append((key, own, k))
        for piece, where in at.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """``(item key, edits)`` of the items in the text, least edits of each."""
        text = f" {text} "
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.pieces.iter(text):
            for no, a in where:
                places.setdefault(no, set()).add(end + 1 - size - a)
        out = []
        for no, starts in places.items():
            key, own, k = self.items[no]
            best, checked = None, -1
            if any(s >= 0 and text.startswith(own, s) for s in starts):
                best = 0
            elif k:
                # One window for each run of places that could be the same occurrence.
                runs: list[list[int]] = []
                for s in sorted(starts):
                    if runs and s <= runs[-1][1] + 2 * k:
                        runs[-1][1] = s
                    else:
                        runs.append([s, s])
                for first, last in runs:
                    window = text[max(0, first - k) : last + len(own) + k]
                    found = distance(own, window, k if best is None else best - 1)
                    best = found[0] if found else best
            if best is not None:
                out.append((key, best))
        return sorted(out)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in runs of at most ``limit`` bytes (or one item); null and empty ones are left out."""
    out, size = [], 0
    for key, text in benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull()).toLocalIterator():
        text = normal(text or "")
        if not text:
            continue
        if out and size + len(text) > limit:
            yield out
            out, size = [], 0
        out.append((key, text))
        size += len(text)
    if out:
        yield out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """``(id, item, edits)``: a row for each document that holds an item within its budget of edits.

    Null or empty texts and items match nothing; repeated documents and items give a row each; null
    document ids stay null.  With no item or document the result is empty.  Other columns are not read.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    kind = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    for items in blocks(benchmark, item_col, item_text_col, block):

        def start(items=items):
            match = Matcher(items, rate)

            def one(part, texts):
                rows = [(k, *m) for k, t in enumerate(texts) for m in match(normal(t))]
                ids = part.column(id_col).take(pa.array([r[0] for r in rows], pa.int64()))
                return table(**{id_col: ids, item_col: pa.array([r[1] for r in rows], kind), "edits": pa.array([r[2] for r in rows], pa.int32())})

            return one

        out = out.union(scan(docs, [id_col, text_col], text_col, schema, start))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows, all columns of any names, of the documents that hold no item.

    Null and empty texts hold none; null and empty items are held by none; ids are not read, repeated rows stay or go
    together; no item leaves the rows as they are, no row gives no row.
    """
    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    for items in blocks(benchmark, item_col, item_text_col, block):

        def start(items=items):
            match = Matcher(items, rate)
            return lambda part, texts: part.filter(pa.array([not match(normal(t)) for t in texts], pa.bool_()))

        docs = scan(docs, [F.col(f"`{c}`") for c in docs.columns], text_col, schema, start)
    return docs
