"""Words that differ by one code point, by permuterm rotations.

Every word gets a terminator, and all its rotations are sorted.  A replaced code point at the end of a rotation
is what a prefix range leaves out: words of one length that differ there only have the rotation's other code points
in common.  A word with one code point more has, but for that one at its end, the whole rotation of the shorter
word.  So each word is entered under its rotations without their last code point and under its whole
rotations; equal keys stand together after the sort, and a scan of each group emits its neighbours.  A group
has at most one row for each letter and one whole rotation.

Keys are dealt out by their hash and sorted in the tasks: a range never reaches beyond its key.  Long keys and
words are named by their start and a digest, so that a row is bounded however long a word is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import LOWER, slices, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, NOISE, RATIO = 7, 2, 31, 10
END = "$"
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Code points of a key or name that are written out; longer ones go on as a digest.
WRITTEN = 64
#: Letters that one pattern match reads at a time has no bound; rows that a task holds before it hands them on.
ROWS = 50_000

_PRIME, _BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F


def runs_of(text: str, least: int = LEAST_CHARS) -> list[str]:
    """Maximal runs of letters of ``least`` code points or more, A-Z in lower case."""
    return _pattern(least).findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))


def _pattern(least: int) -> re.Pattern:
    return re.compile(f"[{LETTERS}]{{{least},}}")


def spelled(doc_id: int | None, run: str, noise: int = NOISE) -> str:
    """The run, without the code point that its document's hash strikes; runs of a document without an id stay."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST_CHARS, count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """``(word, n)`` of ``(id, text)``: words of ``least`` code points or more that occur ``count`` times or more."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for doc_id, text in zip(part.column("id").to_pylist(), texts, strict=True):
                    for word, times in Counter(runs_of(text, least)).items():
                        word = spelled(doc_id, word, noise)
                        if len(word) >= least:
                            held[word] += times
                    if len(held) > HELD:
                        yield table(word=list(held), n=list(held.values()))
                        held.clear()
        yield table(word=pa.array(held, pa.string()), n=pa.array(held.values(), pa.int64()))

    return docs.select("id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def named(word: str) -> str:
    """The word, or the start and digest of a long one."""
    return word if len(word) <= WRITTEN else word[:WRITTEN] + END + hashlib.sha256(word.encode()).hexdigest()


def rotations(word: str) -> tuple[list[str], list[str]]:
    """``(keys without place j, whole rotations)`` of a word: ``w[j+1:] $ w[:j]`` and ``w[j:] $ w[:j]``."""
    n, ring = len(word), word + END + word
    if n < WRITTEN:
        return [ring[j + 1 : j + 1 + n] for j in range(n)], [ring[j : j + 1 + n] for j in range(n + 1)]
    # Digests of all stretches of the ring from those of its prefixes; equal strings have equal digests, at any length.
    prefix = [0]
    for c in ring:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)

    def stretch(a: int, length: int, power: int) -> str:
        return f"{ring[a : a + WRITTEN // 4]}\x00{length}\x00{(prefix[a + length] - prefix[a] * power) % _PRIME:032x}" if length > WRITTEN else ring[a : a + length]

    skip, whole = pow(_BASE, n, _PRIME), pow(_BASE, n + 1, _PRIME)
    return [stretch(j + 1, n, skip) for j in range(n)], [stretch(j, n + 1, whole) for j in range(n + 1)]


TURNED = "key string, name string, place int, letter string, n long"


def rotated(words: DataFrame) -> DataFrame:
    """TURNED rows of ``(word, n)``: under each rotation without its last code point (``letter``), and whole (null).

    Where a letter repeats the one before it, leaving out either gives the same shorter word; the place is then
    negative, and counts for replacements only.
    """

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                name, (skips, wholes) = named(word), rotations(word)
                for j, key in enumerate(skips):
                    rows.append((key, name, -j if j and word[j] == word[j - 1] else j, word[j], n))
                    if len(rows) >= ROWS:
                        yield turned(rows)
                for j, key in enumerate(wholes):
                    rows.append((key, name, j, None, n))
                    if len(rows) >= ROWS:
                        yield turned(rows)
        yield turned(rows)

    return words.select("word", "n").mapInArrow(run, TURNED)


def turned(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "name", "place", "letter", "n"])


#: What a group says of one of its words: near words, the largest count of one, and the edit that makes it (the smallest by code point).
NEIGHBOURS = "name string, near long, most long, place int, cut boolean, letter string"


def group_neighbours(rows: list[tuple]) -> list[tuple]:
    """NEIGHBOURS of a key's rows ``(name, place, letter, n)``."""
    out: list[tuple] = []
    skips = [r for r in rows if r[2] is not None]
    whole = next((r for r in rows if r[2] is None), None)
    if len(skips) > 1:
        best = sorted(skips, key=lambda r: (-r[3], r[2]))[:2]
        for name, place, letter, _ in skips:
            other = best[0] if best[0][2] != letter else best[1]
            out.append((name, len(skips) - 1, other[3], abs(place), True, other[2]))
    if whole:
        longer = [r for r in skips if r[1] >= 0]
        if longer:
            top = min(longer, key=lambda r: (-r[3], r[2]))
            out.append((whole[0], len(longer), top[3], whole[1], False, top[2]))
            out += [(r[0], 1, whole[3], r[1], True, "") for r in longer]
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """NEIGHBOURS rows of all groups of equal keys, found by one scan over the sorted keys."""

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(rows) > 1:
                        out += group_neighbours(rows)
                        if len(out) >= ROWS:
                            yield near_batch(out)
                    key, rows = k, []
                rows.append(tuple(row))
        if len(rows) > 1:
            out += group_neighbours(rows)
        yield near_batch(out)

    return rotated(words).repartition("key").sortWithinPartitions("key").mapInArrow(run, NEIGHBOURS)


def near_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    cols = list(zip(*out, strict=True)) or [()] * 6
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in NEIGHBOURS.split(", ")])


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n)``: near words of each word, and its most frequent one if that is ``ratio`` times as frequent."""

    def run(batches):
        for batch in batches:
            own, n, most, edits = (batch.column(c).to_pylist() for c in ("word", "n", "most", "edits"))
            form = [min(w[: e["place"]] + e["letter"] + w[e["place"] + e["cut"] :] for e in es) if m is not None and m >= ratio * k else None for w, k, m, es in zip(own, n, most, edits, strict=True)]
            yield table(word=batch.column("word"), n=batch.column("n"), n_near=batch.column("near"), form=pa.array(form, pa.string()), form_n=pa.array([m if f is not None else None for m, f in zip(most, form, strict=True)], pa.int64()))

    near = neighbours(words)
    # A word has at most two rows for each of its places; only the best edits are kept.
    edits = near.groupBy("name").agg(F.sum("near").alias("near"), F.max("most").alias("most"), F.collect_list(F.struct("most", "place", "cut", "letter")).alias("all"))
    edits = edits.select("name", "near", "most", F.filter("all", lambda e: e["most"] == F.col("most")).alias("edits"))
    name = F.when(F.length("word") <= WRITTEN, F.col("word")).otherwise(F.concat(F.substring("word", 1, WRITTEN), F.lit(END), F.sha2("word", 256)))
    joined = words.withColumn("name", name).join(edits, "name", "left")
    return joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("near"), "most", "edits").mapInArrow(run, "word string, n long, n_near long, form string, form_n long")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, count: int = LEAST_COUNT, noise: int = NOISE, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the texts.

    Null, empty and letterless texts have no words; repeated rows count each; runs of a row with a null id are
    taken as they are; of equally frequent near words the smallest in code-point order is the form; no word gives no
    row; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = materialise(word_counts(texts, least, count, noise), "words")
    of = materialise(forms(words, ratio), "forms")
    # A form is at least ``ratio`` times as frequent as its word, so that chains are short; their ends are found by doubling.
    roots = of.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").head(1):
            break
        roots = roots.drop("moved")
    return of.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_sql(least: int = LEAST_CHARS, count: int = LEAST_COUNT, noise: int = NOISE, ratio: int = RATIO) -> str:
    """DuckDB SQL for ``group_spellings`` of ``documents``: CRC-32 by its bits, near words by one left-out code point."""
    crc = "list_reduce(list_prepend({start}, {bytes}), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1]))"
    bits = "list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT list({bits} ORDER BY x) AS crc FROM (SELECT unnest(range(256)) AS x)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
once AS (SELECT doc_id, w, count(*) AS c, hex(doc_id || ':' || w) AS h FROM runs WHERE length(w) >= {least} GROUP BY ALL),
hashed AS (SELECT w, c, xor({crc.format(start="4294967295::BIGINT", bytes="list_transform(range(0, length(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT)")}, 4294967295) AS h FROM once, t),
spelt AS (SELECT CASE WHEN h % {noise} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= {least} GROUP BY 1 HAVING sum(c) >= {count}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.key UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.key),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM pairs GROUP BY 1),
chosen AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN b END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root FROM chosen UNION ALL SELECT chain.word, chosen.form FROM chain JOIN chosen ON chain.root = chosen.word WHERE chosen.form IS NOT NULL)
SELECT c.word, c.form, r.root, c.n, c.n_near, c.form_n FROM chosen c JOIN (SELECT chain.word, root FROM chain JOIN chosen ON root = chosen.word WHERE chosen.form IS NULL) r ON c.word = r.word"""
