"""Near-duplicates by 64-bit fingerprints: multi-index hashing with small Hamming balls.

A fingerprint is cut into segments with a radius each, such that the radii plus one add up to the distance
plus one: two fingerprints within the distance are then within some segment's radius there.  Every distinct
fingerprint is entered in each segment's table under its value and looks up the values of the Hamming ball
around it; of two values the smaller looks up the larger, so each pair is met from one side.  Whole
distances are verified where a table's rows of one value meet.

The tables are rows ``(key, fingerprint, entered or looked up)``, dealt out and sorted by key.  What a
task verifies leaves it as a forest (each fingerprint and its least linked one), not as pairs, so that a large
family of near copies costs no more rows than it has fingerprints.  Keys of more entries than a block are dealt
over blocks; then only fingerprints outside a key's largest component meet the other blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import LOWER, scan, table
from .components import components, forest

WIDTH, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Entries of a key in one block.
BLOCK = 2048
#: Rows of a key from which entries are compared one by one instead of as expanded pairs; pairs held at a time.
WIDE, PAIRS = 64, 1 << 20
#: Hashes whose bits are counted at a time.
HASHES = 1 << 16
#: A fingerprint with more than this share of the rows is dealt over several tasks; there are at most as many as its inverse.
HOT_SHARE = 1 / 1024

U64 = np.uint64


def shingle_hashes(text: str, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles, repeats included, in runs of bounded length."""
    words = text.encode().translate(LOWER).split()
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    del words
    if not n:
        return
    starts = np.r_[0, ends[:-1] + 1]
    if n >= width:
        starts, ends = starts[: n - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    for k in range(0, len(starts), HASHES):
        pairs = zip(starts[k : k + HASHES].tolist(), ends[k : k + HASHES].tolist(), strict=True)
        yield np.array([h(joined[a:b], SEED) for a, b in pairs], U64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Bits set in over half of the shingles' hashes; 0 without a word."""
    ones, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, width):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(id, fp)`` of every row of ``(id, text)``; the fingerprint as a signed number."""

    def start():
        return lambda part, texts: table(id=part.column("id"), fp=np.array([fingerprint(t, width) for t in texts], U64).view(np.int64))

    return scan(docs, ["id", "text"], "text", "id long, fp long", start)


def plan(segments: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """``(shift, bits, radius)`` of each segment: widths as even as can be, the larger radii on the first."""
    if not 1 <= segments <= distance + 1:
        raise ValueError("segments must be from 1 to distance + 1")
    edge = [BITS * k // segments for k in range(segments + 1)]
    spare = distance + 1 - segments
    radius = [spare // segments + (k < spare % segments) for k in range(segments)]
    return [(a, b - a, r) for a, b, r in zip(edge, edge[1:], radius, strict=False)]


def segments_for(count: int) -> int:
    """Segments whose values are about as many as there are fingerprints: fewer, longer ones with larger balls for more rows."""
    return int(np.clip(round(BITS / np.log2(max(count, 2))), 2, 3))


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` of ``bits`` bits, the empty one first."""
    sets = (c for r in range(radius + 1) for c in itertools.combinations(range(bits), r))
    return np.array([sum(1 << b for b in c) for c in sets], U64)


def table_rows(nodes: DataFrame, segments: int, distance: int = DISTANCE) -> DataFrame:
    """``(key, fp, entry)``: each fingerprint under its segments' values, and under the larger values of their balls."""
    parts = [(k, s, w, ball(w, r)) for k, (s, w, r) in enumerate(plan(segments, distance))]

    def run(batches):
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(U64)
            step = max(1, (1 << 20) // max(len(m) for *_, m in parts))
            for at in range(0, len(all_fp), step):
                fp = all_fp[at : at + step]
                for k, shift, width, masks in parts:
                    own = (fp >> U64(shift)) & U64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF)
                    to = own[:, None] ^ masks[None, :]
                    who, which = np.nonzero((to > own[:, None]) | (masks == 0)[None, :])
                    # A segment of all 64 bits is the only one, so that its number needs no room.
                    key = to[who, which] | (U64(k) << U64(61) if segments > 1 else U64(0))
                    yield table(key=key.view(np.int64), fp=fp[who].view(np.int64), entry=which == 0)

    return nodes.select("fp").mapInArrow(run, "key long, fp long, entry boolean")


def linked_in(fp: np.ndarray, entry: np.ndarray, edge: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between an entry and any row of its group; group ``k`` is ``edge[k]:edge[k + 1]``."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    some = np.add.reduceat(entry.astype(np.int64), edge[:-1]) > 0 if len(size) else np.zeros(0, bool)
    lone = np.flatnonzero(entry & (size[group] > 1) & (size[group] <= WIDE))
    todo = np.cumsum(size[group[lone]])
    start = 0
    while start < len(lone):
        stop = max(start + 1, int(np.searchsorted(todo, (todo[start - 1] if start else 0) + PAIRS, side="right")))
        own = lone[start:stop]
        times = size[group[own]]
        x = np.repeat(own, times)
        y = np.repeat(edge[:-1][group[own]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ok = (x != y) & (~entry[y] | (x < y))
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        p, q = forest(fp[x[ok]].view(np.int64), fp[y[ok]].view(np.int64))
        a.append(p)
        b.append(q)
        start = stop
    for k in np.flatnonzero(some & (size > WIDE)).tolist():
        own, inside = fp[edge[k] : edge[k + 1]], np.flatnonzero(entry[edge[k] : edge[k + 1]])
        p, q = met(own[inside], own, distance)
        a.append(p)
        b.append(q)
    return forest(np.concatenate(a), np.concatenate(b))


def met(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two lists; once all of them hang together the rest need not be compared."""
    both, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = np.arange(len(both))
    to = at[len(left) :]
    for x in at[: len(left)].tolist():
        hit = np.unique(np.r_[label[x], label[to[np.bitwise_count(both[x] ^ right) <= distance]]])
        if len(hit) > 1:
            label[np.isin(label, hit)] = hit[0]
            if (label == label[0]).all():
                break
    signed = both.view(np.int64)
    return forest(signed, signed[label])


def met_by_key(rows: DataFrame, distance: int) -> DataFrame:
    """Forest edges ``(a, b)`` of rows ``(key, fp, entry)``; the rows of a key meet in one task, a run of keys at a time."""

    def run(batches):
        rest = None

        def cut(rows, last):
            key, fp = rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(U64)
            entry = rows.column("entry").to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            if not last:
                edge = edge[:-1]  # the last group may go on
            end = int(edge[-1])
            p, q = linked_in(fp[:end], entry[:end], edge, distance)
            return table(a=p, b=q), rows.slice(end)

        for batch in batches:
            if batch.num_rows:
                whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                got, rest = cut(whole, False)
                yield got
        if rest is not None and rest.num_rows:
            yield cut(rest, True)[0]

    return rows.repartition("key").sortWithinPartitions("key").select("key", "fp", "entry").mapInArrow(run, "a long, b long")


def met_outside(rows: DataFrame, distance: int) -> DataFrame:
    """Forest edges of groups ``(at, fp, entry, rest)``: members of ``rest`` against all, one of the two an entry; groups are bounded."""

    def run(part: pa.Table) -> pa.Table:
        fp, rest = part["fp"].to_numpy().view(U64), part["rest"].to_numpy()
        entry = part["entry"].to_numpy()
        p1, q1 = met(fp[rest & entry], fp, distance)
        p2, q2 = met(fp[rest & ~entry], fp[entry], distance)
        p, q = forest(np.r_[p1, p2], np.r_[q1, q2])
        return pa.table({"a": p, "b": q})

    return rows.groupBy("at").applyInArrow(run, "a long, b long")


def links(nodes: DataFrame, segments: int, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``(class, root)``: the components of distinct fingerprints ``nodes`` that have a link."""
    rows = table_rows(nodes, segments, distance)
    crowded = rows.where("entry").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block)
    crowded = materialise(crowded.select("key", F.ceil(F.col("c") / block).alias("parts")), "crowded")
    if not crowded.head(1):
        return components(met_by_key(rows, distance))
    dealt = rows.join(crowded, "key", "left").withColumn("of", F.pmod(F.xxhash64("fp"), F.col("parts")))
    own_key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", "of"))
    # Keys that fall together by their hash are compared for nothing, but every link is verified.
    first = materialise(met_by_key(dealt.select(own_key.alias("key"), "fp", "entry"), distance), "links")
    roots = components(first)
    inside = dealt.where("parts is not null").join(roots.withColumnRenamed("class", "fp"), "fp", "left")
    inside = materialise(inside.select("key", "fp", "entry", "parts", F.coalesce("root", "fp").alias("comp")), "crowded-rows")
    size = inside.groupBy("key", "comp").agg(F.count("*").alias("c"))
    most = size.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("c"))
    most = materialise(most.where("all > c").select("key", "main", F.ceil((F.col("all") - F.col("c")) / block).alias("i"), F.ceil(F.col("all") / block).alias("j")), "crowded-keys")
    if not most.head(1):
        return roots
    open_rows = inside.join(most, "key")
    some = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    rest = open_rows.where("comp <> main").select("key", "fp", "entry", F.lit(True).alias("rest"), F.pmod(F.xxhash64("fp"), "i").alias("x"), F.explode(some("j")).alias("y"))
    every = open_rows.select("key", "fp", "entry", F.lit(False).alias("rest"), F.explode(some("i")).alias("x"), F.pmod(F.xxhash64("fp"), "j").alias("y"))
    later = met_outside(rest.unionByName(every).select(F.xxhash64("key", "x", "y").alias("at"), "fp", "entry", "rest"), distance)
    return components(first.unionByName(later))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``distance`` bits or fewer.
    Words are runs without ASCII white space, A-Z in lower case; a text with fewer words than ``width`` is one
    shingle.  Null, empty and blank texts have fingerprint zero, which links like any other; repeated rows are
    linked; a row with a null id has a null component and links nothing; no row gives no row; other columns are
    not read.  ``segments`` (2 to ``distance + 1``; by the number of fingerprints if None) changes the work, not the result.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    of = materialise(fingerprints(docs, width), "fingerprints")
    nodes = of.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("c"))
    nodes = materialise(nodes, "fingerprint-groups")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    roots = links(nodes, segments or segments_for(count), distance, block)
    named = nodes.join(roots.withColumnRenamed("class", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lead = named.groupBy("root").agg(F.min("least").alias("component"))
    # Copies of one fingerprint may be a large part of all rows: those are dealt over parts, and their component with them.
    share = max(1, int(total * HOT_SHARE))
    parts = F.ceil(F.col("c") / share)
    hot = nodes.where(F.col("c") > share).select("fp", parts.alias("parts"))
    component = named.join(lead, "root").select("fp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "component")
    rows = of.where("id is not null").join(F.broadcast(hot), "fp", "left")
    rows = rows.select("id", "fp", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0).cast("long")).alias("part")).join(component, ["fp", "part"]).select("id", "fp", "component")
    rows = rows.unionByName(of.where("id is null").select("id", "fp", F.lit(None).cast("long").alias("component")))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select(F.col("id").cast(kind).alias(id_col), shown.alias("fingerprint"), F.col("component").cast(kind).alias("component_id"))
