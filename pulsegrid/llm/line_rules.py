"""Quality rules of documents, and lines that recur across the documents of a host.

A line, normalised and hashed, is common on a host when more than a share of its distinct texts, and
more than a number of them, hold it.  ``clean`` removes common lines from the texts; a document of which
too little is left is rejected (``judge``).  Exact copies count once, so that a copied document does not make its own lines common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import LOWER, scan, table

#: A line is common in more than this many distinct texts of a host, and more than this share of them.
LEAST, SHARE = 20, 0.01
#: Share of a document's words that must be left.
LEFT = 0.3
#: Parts over which the rows of one line are dealt when they meet its count.
PARTS = 16

_NORMAL = bytes.maketrans(b"123456789", b"000000000")
BLANK = " \t\n\v\f\r"


def normal_line(words: list[bytes]) -> bytes:
    """Words in lower case, one space apart, every ASCII digit as 0."""
    return b" ".join(words).translate(LOWER).translate(_NORMAL)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    no: dict[bytes, int] = {}
    ids = np.fromiter((no.setdefault(w, len(no)) for w in words), np.int64, len(words))
    key = ids[: len(ids) - width + 1]
    for k in range(1, width):
        # Renumbered after each step, so that the pairs stay exact.
        key = np.unique(key * len(no) + ids[k : len(ids) - width + 1 + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, host, content, base figures, lines)``: a row for each document; ``lines`` are its distinct normalised lines with their words."""

    def start():
        def one(part, texts):
            cols: list[list] = [[] for _ in range(7)]
            for t in texts:
                raw = t.encode()
                words = raw.split()
                chars = len(t) - sum(map(t.count, BLANK))
                symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
                seen, again, lines = set(), 0, {}
                for line in raw.split(b"\n"):
                    own = line.split()
                    if own:
                        again += line in seen
                        seen.add(line)
                        h = xxhash.xxh3_64_intdigest(normal_line(own)) - (1 << 63)
                        lines[h] = lines.get(h, 0) + len(own)
                row = (xxhash.xxh3_64_intdigest(raw) - (1 << 63), len(words), chars, symbols, again, repeated_words(words), [{"line": h, "words": n} for h, n in lines.items()])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            named = {n: pa.array(c, pa.int64()) for n, c in zip(("content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), cols, strict=False)}
            return table(id=part.column("id"), host=part.column("host"), **named, lines=pa.array(cols[6], _LINES))

        return one

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return scan(own, ["id", "host", "text"], "text", f"id {kind}, host string, content long, {BASE}, lines array<struct<line:long,words:long>>", start)


def common_lines(base: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``(host, content, line, words)`` of the lines of each distinct text that are common on its host."""
    lines = base.select("host", "content", F.explode("lines").alias("x")).select("host", "content", "x.line", "x.words").groupBy("host", "content", "line").agg(F.first("words").alias("words"))
    lines = materialise(lines, "lines")
    size = base.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    common = common.join(size, "host").where(F.col("n") > share * F.col("host_docs")).select("host", "line")
    common = common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return lines.withColumn("part", F.pmod(F.col("content"), F.lit(PARTS)).cast("int")).join(common, ["host", "line", "part"])


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _kept(left: float) -> Column:
    return ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= left * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """``(id, base figures, base_failed, n_common_words, kept)`` of every row.

    Null text has no words and fails the base rules; a null host is a host of its own (the empty name);
    null ids and repeated rows stay, each judged like its copies; no row gives no row.
    """
    base = materialise(base_rules(docs, id_col, text_col, host_col), "line-rules")
    gone = common_lines(base, least, share).groupBy("host", "content").agg(F.sum("words").alias("n_common_words"))
    out = base.drop("lines").join(gone, ["host", "content"], "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)))
    out = out.withColumn("base_failed", _failed())
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", _kept(left).alias("kept"))


def without(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised hash is in ``gone``."""
    kept = [line for line in text.encode().split(b"\n") if not (own := line.split()) or xxhash.xxh3_64_intdigest(normal_line(own)) - (1 << 63) not in gone]
    return b"\n".join(kept).decode()


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """``(id, text, n_common_words, kept)`` of every row: its text without the common lines, their words, and the verdict of ``judge``.

    Null text stays null; null ids and repeated rows stay; rejected documents stay too, with ``kept`` false.
    """
    base = materialise(base_rules(docs, id_col, text_col, host_col), "line-rules")
    gone = common_lines(base, least, share).groupBy("host", "content").agg(F.sum("words").alias("n_common_words"), F.collect_list("line").alias("gone"))
    gone = materialise(gone, "common-lines")
    # Figures and lines belong to a text on a host, so one row of each is met by all its copies.
    one_each = base.groupBy("host", "content").agg(*[F.first(c).alias(c) for c in ("n_words", "n_repeat_words")])
    one_each = one_each.join(gone, ["host", "content"], "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0))).withColumn("base_failed", _failed())
    one_each = one_each.select("host", "content", "n_common_words", _kept(left).alias("kept"), "gone")

    def key():
        def one(part, texts):
            content = pa.array([xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts], pa.int64())
            return table(id=part.column("id"), host=part.column("host"), content=content, text=part.column("text"))

        return one

    def start():
        def one(part, texts):
            lines, known = part.column("gone").to_pylist(), part.column("text").is_valid().to_pylist()
            new = [(without(t, set(g)) if g else t) if k else None for t, g, k in zip(texts, lines, known, strict=True)]
            return table(**{id_col: part.column("id"), text_col: pa.array(new, pa.string())}, n_common_words=part.column("n_common_words"), kept=part.column("kept"))

        return one

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    keyed = scan(own, ["id", "host", "text"], "text", f"id {kind}, host string, content long, text string", key)
    return scan(keyed.join(one_each, ["host", "content"]), ["id", "text", "n_common_words", "kept", "gone"], "text", f"`{id_col}` {kind}, `{text_col}` string, n_common_words long, kept boolean", start)
