"""Exact n-gram Jaccard self-join by partitioning the universe of shingles.

Sets of sizes n >= s are similar only if they differ in at most H(n) shingles.  A size band hashes
every shingle into one of m segments, m somewhat above H + 1.  By the pigeonhole principle two similar sets
agree on a whole segment of any H + 1 of them, or, counted double, differ in at most one shingle there.  So
the larger set spends H + 1 units: none on a segment that is empty or whose subset is shared by many
unrelated sets, one on a subset looked up as it is, and two, where units are missing, on a subset looked up
with its one-deletion neighbourhood.  A set is indexed in its own band and the next one, where its larger
partners are.  Every candidate is verified on the sets themselves.

Equal sets are one class and take part once.  Subset groups are first linked to one member each (a star), so
that large groups of near copies become components without their pairs; only pairs of different components
are looked at after that.  Index entries travel packed, a row for each bucket and step, and meet in buckets of
bounded size; a subset that one step already meets often is reduced to its star there.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, remove
from .common import LOWER, bounded_batches, mix, slices, table, tidy
from .components import components

WIDTH, PERCENT = 5, 75
#: Segments beyond the H + 1 that must be spent, as a share and a number.
SLACK, EXTRA = 0.12, 2
#: Pairs of different components up to which all of them are compared in a subset's group.
LIGHT = 1 << 19
#: A set whose missing units exceed this share of its free segments looks up shared subsets as they are, the smallest first.
DENSE = 0.25
#: Members of a group that meet the lookups in one block.
BLOCK = 2048
#: Members in one step from which a subset goes on as a star.
HOT = 48
#: Index entries of a bucket and of a step; members in a row.
BUCKET, STEP, ROW = 600_000, 500_000, 1024
#: Bits of a key that travel beside its bucket.  Some tens of a bucket's keys meet by chance, which only makes candidates.
TRAVEL = 32
#: Least bytes of the sketch that rules out most pairs.
SKETCH = 128
#: Words whose hashes a worker remembers, and bytes of text that it takes apart at a time.
CACHE, TEXTS = 100_000, 1 << 19

U64 = np.uint64
_TURNS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words(dict):
    """64-bit hashes of words, kept as met."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:  # the cache is bounded in bytes, too
            self[w] = h
        return h


@functools.cache
def words_cache() -> Words:
    return Words()


def sets_of(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, bounds)``: the sets of hashed shingles of all texts end to end, each sorted.

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer words than ``width`` is one shingle.
    """
    known = words_cache()
    if len(known) > CACHE:
        known.clear()
    words: list[bytes] = []
    ends = []
    for t in texts:
        words += t.encode().translate(LOWER).split()
        ends.append(len(words))
    h = np.fromiter(map(known.__getitem__, words), U64, len(words))
    end = np.array(ends, np.int64)
    size = np.diff(end, prepend=0)
    text_of = np.repeat(np.arange(len(texts)), size)
    left = end[text_of] - np.arange(len(h))  # words from here to the text's end
    out = np.minimum(size, width).astype(U64)[text_of]
    for k in range(width):
        step = np.zeros(len(h), U64)
        if k < len(h):
            step[: len(h) - k] = h[k:]
        # Beyond the end of a short text there is nothing to add.
        inside = left > k
        out = np.where(inside, mix(out * _TURNS[k % len(_TURNS)] + step), out)
    starts = np.flatnonzero((left >= width) | ((left == size[text_of]) & (size[text_of] < width)))
    out, owner = out[starts], text_of[starts]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    once = np.ones(len(out), bool)
    once[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[once], np.r_[0, np.cumsum(np.bincount(owner[once], minlength=len(texts)))]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The set of one text, sorted."""
    return sets_of([text], width)[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of the values between bounds."""
    out = np.zeros(len(bounds) - 1, U64)
    filled = bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values, bounds[:-1][filled])
    return out


def classes_of(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signed 64-bit digests of sets; sets of the same digest are one class."""
    return mix(sums(mix(flat + U64(0x2545F491)), bounds) + np.diff(bounds).astype(U64)).view(np.int64)


def most_different(n, percent: int = PERCENT):
    """H(n): shingles in which a set of n and a similar one, not larger, differ at most."""
    return 2 * n * (100 - percent) // (100 + percent)


class Bands:
    """Size bands: partners of a band's sets lie in it, the one below or the one above."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges = percent, [1]

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            e = self.edges[-1]
            self.edges.append(max(e + 1, 100 * e // self.percent + 1))
        return bisect.bisect_right(self.edges, n) - 1

    def edge(self, band: int) -> int:
        """The least size of a band."""
        while len(self.edges) < band + 2:
            self.of(self.edges[-1])
        return self.edges[max(0, band)]

    @functools.cache  # noqa: B019  a few numbers for each band, as long as a task's bands live
    def segments(self, band: int) -> int:
        self.edge(band + 1)
        need = most_different(self.edges[band + 1] - 1, self.percent) + 1
        return need + int(np.ceil(SLACK * need)) + EXTRA


def spread_of(flat: np.ndarray) -> np.ndarray:
    """The value of each shingle in the sums of its segments; also decides the segment."""
    return mix(flat + U64(0x51ED2705))


def segment_sums(spread: np.ndarray, owner: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, segment, size, sum)`` of the filled segments of all sets; set ``k`` has ``m[k]`` segments."""
    first = np.cumsum(m) - m
    own = m[owner]
    at = first[owner] + (((spread >> U64(32)) * own.astype(U64)) >> U64(32)).astype(np.int64)
    total = np.zeros(int(m.sum()), U64)
    np.add.at(total, at, spread)
    size = np.bincount(at, minlength=len(total))
    filled = np.flatnonzero(size)
    who = np.searchsorted(first, filled, side="right") - 1
    return who, filled - first[who], size[filled], total[filled]


def subsets(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(segment of each shingle, value of each shingle, size and sum of values of each segment)``."""
    spread = spread_of(s)
    segment = (((spread >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
    sums = np.zeros(m, U64)
    np.add.at(sums, segment, spread)
    return segment, spread, np.bincount(segment, minlength=m), sums


def keys_of(total: np.ndarray, band, segment: np.ndarray) -> np.ndarray:
    """Keys of subsets; the lower 16 bits are left for their owners."""
    return mix(total + mix((segment.astype(U64) << U64(16)) + np.asarray(band + 1).astype(U64))) & ~U64(0xFFFF)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so that a sort by key is one by bucket."""
    return (((keys >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int64)


def named(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The name of a key: its bucket over the bits that travel."""
    return (bucket_of(keys, buckets) << TRAVEL) | low_bits(keys).astype(np.int64)


def low_bits(keys: np.ndarray) -> np.ndarray:
    """The bits of a key that travel, beside those that decide the bucket."""
    return (keys >> U64(16)) & U64((1 << TRAVEL) - 1)


def digest(members: np.ndarray) -> int:
    """A signed digest of a set of numbers, whatever their order."""
    return int(mix(members.astype(U64)).sum(dtype=U64).view(np.int64))


def sketches(flat: np.ndarray, bounds: np.ndarray, at_once: int = 1 << 20) -> list[bytes]:
    """A bit string for each set, with a bit or more for each shingle: every shingle flips one bit.

    Lengths are powers of two, so that a longer one folds onto a shorter one.
    """
    n = np.diff(bounds)
    bits = 8 * SKETCH << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (8 * SKETCH)))).astype(np.int64)
    out: list[bytes] = [b""] * len(n)
    for width in np.unique(bits).tolist():
        same = np.flatnonzero(bits == width)
        for k in range(0, len(same), max(1, at_once // width)):
            own = same[k : k + max(1, at_once // width)]
            part = np.concatenate([flat[bounds[d] : bounds[d + 1]] for d in own.tolist()])
            at = np.repeat(np.arange(len(own)), n[own]) * width + ((part >> U64(7)) % U64(width)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(own) * width) & 1).astype(np.uint8)
            for d, x in zip(own.tolist(), np.packbits(odd.reshape(len(own), -1), axis=1), strict=True):
                out[d] = x.tobytes()
    return out


def folded(raw: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` bytes, the longer ones folded."""
    rows = []
    for x in raw:
        while len(x) > width:
            half = len(x) // 2
            x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
        rows.append(x)
    return np.frombuffer(b"".join(rows), U64).reshape(len(raw), -1)


class Filter:
    """A bitmap of hashed ids, of bounded size: who is asked for may pass, few others do.

    Built by Spark's bitmap aggregates; it saves shuffling texts to find the few that are wanted.  For
    more ids than the bitmap can part, more others pass, and a join drops them later.
    """

    MOST = 1 << 26  # bits: 8 MB

    def __init__(self, ids: DataFrame):
        count = ids.count()
        self.bits = max(1 << 15, min(self.MOST, 1 << (16 * max(1, count) - 1).bit_length()))
        at = ids.select((F.pmod(F.xxhash64("id"), F.lit(self.bits)) + 1).alias("v"))
        rows = at.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
        self.map = np.zeros(self.bits // 8, np.uint8)
        for r in rows:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            self.map[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Which of the 64-bit ids may have been asked for."""
        raw = np.ascontiguousarray(ids, "<i8").view(np.uint8).reshape(-1, 8)
        at = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in raw], U64).view(np.int64) % self.bits
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def scan(self, docs: DataFrame, schema: str, fn) -> DataFrame:
        """``fn(ids, texts)`` over the rows ``(id, text)`` that pass; ``fn`` makes a batch."""
        bitmap = self.map

        def run(batches):
            for batch in batches:
                at = batch.column("at").to_numpy()
                own = batch.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                for part, texts in slices(own, "text", TEXTS):
                    yield fn(part.column("id"), texts)
            tidy(words_cache())

        return docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(self.bits)).alias("at")).mapInArrow(run, schema)


# A row of the scan carries packed entries of a bucket, stars and members of subsets met often in one step, or the sets' own rows.
ENTRIES = "bucket int, keys binary, owners binary, classes binary, sizes binary, hot binary, stars binary, sets binary, docs binary"


def squeezed(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, byte by byte in planes, so that bytes that hardly vary take little room."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, width: int) -> np.ndarray:
    planes = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(U64)


#: Steps of a size's code for each doubling; how far the codes of similar sizes may be apart (a half, and the rounding of both).
CODE_STEPS, CODE_REACH = 8, 9


def size_code(sizes: np.ndarray) -> np.ndarray:
    """Sizes in one byte, for ruling out pairs; rounded, so that a comparison must allow for it."""
    return np.minimum(np.round(CODE_STEPS * np.log2(np.maximum(sizes, 1))), 255).astype(np.uint8)


class Packer:
    """Index entries of a step: sorted by key at the end, and cut into a row for each bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.entries, self.classes, self.sizes, self.count, self.held = [], [], [], 0, 0

    def full(self, more: int = 0) -> bool:
        return self.count >= STEP or self.held + more >= 1 << 15

    def add(self, classes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, owner: np.ndarray, marks: np.ndarray) -> None:
        """``owner`` numbers ``classes``, fewer than 2**15 until ``rows``; ``marks`` is one bit of each entry."""
        self.entries.append(keys | (2 * (owner + self.held) + marks).astype(U64))
        self.classes.append(classes)
        self.sizes.append(sizes)
        self.count += len(keys)
        self.held += len(classes)

    def rows(self, hot: int = 0) -> list[tuple]:
        """Rows of the step, which ends."""
        if not self.count:
            self.clear()
            return []
        both = np.sort(np.concatenate(self.entries))
        keys, owners = both & ~U64(0xFFFF), (both & U64(0xFFFF)).astype(np.int64)
        classes, sizes = np.concatenate(self.classes), np.concatenate(self.sizes).astype(np.uint32)
        self.clear()
        hot_keys, stars, groups = np.zeros(0, U64), [], []
        if hot:
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            width = np.diff(np.r_[first, len(keys)])
            keep = np.ones(len(keys), bool)
            for a, w in zip(first[width > hot].tolist(), width[width > hot].tolist(), strict=True):
                own = owners[a : a + w]
                lead = a + leader(classes[own >> 1], own & 1)
                keep[a : a + w] = False
                keep[lead] = True
                rest = own[np.arange(a, a + w) != lead]
                stars.append(star(classes, sizes, owners[lead], rest))
                groups.append((int(keys[a]), np.c_[classes[rest >> 1], rest & 1]))
            hot_keys = keys[first[width > hot]]
            keys, owners = keys[keep], owners[keep]
        bucket = bucket_of(keys, self.buckets)
        edge = np.searchsorted(bucket, np.arange(self.buckets + 1))
        hot_bucket = bucket_of(hot_keys, self.buckets)
        out: list[tuple] = []
        low = low_bits(keys)
        for b in np.flatnonzero(np.diff(edge)).tolist():
            k, o = low[edge[b] : edge[b + 1]], owners[edge[b] : edge[b + 1]]
            seen = np.zeros(len(classes), bool)
            seen[o >> 1] = True
            used = np.flatnonzero(seen)
            at = (np.cumsum(seen) - 1)[o >> 1]
            order = np.argsort(k, kind="stable")
            k, at, o = k[order], at[order], o[order]
            packed = squeezed(np.diff(k, prepend=U64(0)), TRAVEL // 8)
            here = low_bits(hot_keys[hot_bucket == b]).astype("<u8").tobytes()
            out.append((b, packed, squeezed((2 * at + (o & 1)).astype(U64), 2), classes[used].astype("<i8").tobytes(), size_code(sizes[used]).tobytes(), here, b"", b"", b""))
        if stars:
            out.append((int(hot_keys[0] % U64(self.buckets)), *[b""] * 5, np.concatenate(stars).astype("<i8").tobytes(), b"", b""))
        for key, members in groups:
            name = int(named(np.array([key], U64), self.buckets)[0])
            for at in range(0, len(members), ROW):
                cut = np.r_[[[name, 0]], members[at : at + ROW]]
                out.append(((key + at) % self.buckets, *[b""] * 6, cut.astype("<i8").tobytes(), b""))
        return out


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ENTRIES.split(", ")])


def leader(classes: np.ndarray, own: np.ndarray) -> int:
    """Place of the least class among the members in their own band, or among all."""
    at = np.flatnonzero(own) if own.any() else np.arange(len(classes))
    return int(at[np.argmin(classes[at])])


def star(classes: np.ndarray, sizes: np.ndarray, lead: int, rest: np.ndarray) -> np.ndarray:
    """Pairs of the leader with the other owners whose sizes and classes allow a link."""
    a, b = classes[lead >> 1], classes[rest >> 1]
    n, s = sizes[lead >> 1].astype(np.int64), sizes[rest >> 1].astype(np.int64)
    ok = (a != b) & (100 * np.minimum(n, s) >= PERCENT_FLOOR * np.maximum(n, s))
    b = b[ok]
    return np.c_[np.minimum(a, b), np.maximum(a, b)]


#: Sizes that differ more than this percentage can't be similar at any threshold that is used.
PERCENT_FLOOR = 50


_DOC = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("filled", pa.int64()), ("sketch", pa.binary()), ("hash", pa.int64())])


def entry_rows(docs: DataFrame, width: int, percent: int, buckets: int, hot: int = HOT) -> DataFrame:
    """One pass over the texts: packed entries ``(key, class)`` of every set's filled segments, in its own band (marked) and the next one; and the sets' rows.

    Sets that a step has met before are not entered again.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        bands, pack, met, no = Bands(percent), Packer(buckets), set(), 0
        for batch in batches:
            for part, texts in slices(batch, "text", TEXTS):
                flat, bounds = sets_of(texts, width)
                n, cls = np.diff(bounds), classes_of(flat, bounds)
                owner = np.repeat(np.arange(len(texts)), n)
                spread = spread_of(flat)
                band = np.array([bands.of(x) if x else 0 for x in n.tolist()], np.int64)
                fresh = np.zeros(len(texts), bool)
                for k, (c, x) in enumerate(zip(cls.tolist(), n.tolist(), strict=True)):
                    if x and c not in met:
                        met.add(c)
                        fresh[k] = True
                if pack.full(len(texts)):
                    if out := pack.rows(hot):
                        yield entry_batch(out)
                    met = set(cls[fresh].tolist())
                filled = np.zeros(len(texts), np.int64)
                keys, owners, marks = [], [], []
                for up in (0, 1):
                    m = np.array([bands.segments(b) for b in (band + up).tolist()], np.int64) * (n > 0)
                    who, segment, _, total = segment_sums(spread, owner, m)
                    if not up:
                        filled = np.bincount(who, minlength=len(texts))
                    k = keys_of(total, band[who] + up, segment)
                    keys.append(k[fresh[who]])
                    owners.append(who[fresh[who]])
                    marks.append(np.full(len(owners[-1]), 1 - up))
                place = np.cumsum(fresh) - 1
                pack.add(cls[fresh], n[fresh], np.concatenate(keys), place[np.concatenate(owners)], np.concatenate(marks))
                sk = sketches(flat, bounds)
                rows = pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(np.where(n > 0, cls, 0)), pa.array(filled, pa.int64()), pa.array(sk, pa.binary()), part.column("hash")], schema=_DOC)
                no += 1
                yield entry_batch([((int(cls[0]) + no) % buckets, *[b""] * 7, packed_rows(rows))])
        if out := pack.rows(hot):
            yield entry_batch(out)
        del pack, met
        tidy(words_cache())

    return docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, ENTRIES)


def packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(rows: pa.Table, probes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, classes, size codes, marks, hot keys)`` of the keys that more than one entry of a bucket has, or that are hot; by key, then class.

    A class that several steps met counts once; with ``probes`` its marked entries count apart.
    """
    keys, classes, sizes, marks, hot = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for k, o, c, n, h in zip(*(rows[x].to_pylist() for x in ("keys", "owners", "classes", "sizes", "hot")), strict=True):
        if not k:
            continue
        keys.append(np.cumsum(unsqueezed(k, TRAVEL // 8), dtype=U64))
        owner = unsqueezed(o, 2).astype(np.int64)
        classes.append(np.frombuffer(c, "<i8")[owner >> 1])
        sizes.append(np.frombuffer(n, np.uint8).astype(np.int64)[owner >> 1])
        marks.append(owner & 1)
        hot.append(np.frombuffer(h, "<u8"))
    keys, classes, sizes, marks = map(np.concatenate, (keys, classes, sizes, marks))
    hot = np.unique(np.concatenate(hot))
    if len(keys) < 1 << 24:
        both = np.sort((keys << U64(24)) | np.arange(len(keys), dtype=U64))
        order = (both & U64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    wanted = np.r_[False, same] | np.r_[same, False]
    if len(hot):
        wanted |= hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k
    order = order[wanted[: len(order)]]
    keys, classes, sizes, marks = keys[order], classes[order], sizes[order], marks[order]
    order = np.lexsort((marks, classes, keys))
    keys, classes, sizes, marks = keys[order], classes[order], sizes[order], marks[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]) | ((marks[1:] != marks[:-1]) & probes)
    return keys[once], classes[once], sizes[once], marks[once] == 1, hot


FOUND = "kind int, a long, b long, chunk long, filled long, members binary, hash long"


def meet(rows: pa.Table) -> pa.Table:
    """What a bucket finds.  Kind 0: a set's row (id ``a``, class ``b``, size ``chunk``, ``filled``, sketch, ``hash`` of its text).  Kind 1: star pairs ``a < b``.  Kind 2: a group of three or more: name ``a``, key ``b``, members (class, own)."""
    bucket = rows["bucket"][0].as_py()
    names = [c.split()[0] for c in FOUND.split(", ")]
    keys, classes, sizes, marks, hot = unpack(rows)
    pairs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in rows["stars"].to_pylist() if x]
    out: list[tuple] = []
    for x in rows["sets"].to_pylist():
        if x:
            own = np.frombuffer(x, "<i8").reshape(-1, 2)
            out.append((2, digest(own[:1, 0]), int(own[0, 0]), digest(own[1:, 0]), 0, own[1:].tobytes(), None))
    got = []
    for x in rows["docs"].to_pylist():
        if x:
            d = pa.ipc.open_stream(x).read_all()
            got.append(pa.Table.from_arrays([pa.array(np.zeros(len(d), np.int32)), d["id"], d["class"], d["n"], d["filled"], d["sketch"], d["hash"]], names=names))
    if len(keys):
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(new)
        width = np.diff(np.r_[first, len(keys)])
        is_hot = np.isin(keys[first], hot)
        own = np.add.reduceat(marks.astype(np.int64), first) > 0
        two = first[own & (width == 2) & ~is_hot]
        two = two[np.abs(sizes[two] - sizes[two + 1]) <= CODE_REACH]
        pairs.append(np.c_[classes[two], classes[two + 1]])
        for a, w, h in zip(*(x[own & ((width > 2) | is_hot)].tolist() for x in (first, width, is_hot)), strict=True):
            c, n, m = classes[a : a + w], sizes[a : a + w], marks[a : a + w]
            lead = leader(c, m)
            ok = (c != c[lead]) & (np.abs(n - n[lead]) <= CODE_REACH)
            pairs.append(np.c_[np.minimum(c[lead], c[ok]), np.maximum(c[lead], c[ok])])
            members = np.c_[c, m.astype(np.int64)]
            key = (bucket << TRAVEL) | int(keys[a])
            # Equal groups of several keys are one set; a hot key's group is in several parts, so the key names it.
            name = digest(np.array([key])) if h else digest(members[:, 0] * 2 + members[:, 1])
            for at in range(0, w, ROW):
                cut = members[at : at + ROW]
                out.append((2, name, key, digest(cut[:, 0]), 0, cut.tobytes(), None))
    kinds = [pa.int32()] + [pa.int64()] * 4 + [pa.binary(), pa.int64()]
    if out:
        got.append(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names))
    if pairs and len(p := np.unique(np.concatenate(pairs), axis=0)):
        got.append(pa.Table.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1]), *[pa.nulls(len(p), k) for k in kinds[3:]]], names=names))
    return pa.concat_tables(got) if got else pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)


# --- groups, components, verification -------------------------------------------------------------


def members(found: DataFrame) -> DataFrame:
    """``(set, class, own, keys)``: members of the groups; equal groups once, with the number of their keys."""
    groups = found.where("kind = 2").groupBy("a", "chunk").agg(F.count("*").alias("keys"), F.first("members").alias("members"))

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("members").to_pylist()]
            if own:
                times = [len(x) for x in own]
                flat = np.concatenate(own)
                yield table(set=np.repeat(batch.column("a").to_numpy(), times), **{"class": flat[:, 0]}, own=flat[:, 1] == 1, keys=np.repeat(batch.column("keys").to_numpy(), times))

    return groups.select("a", "keys", "members").mapInArrow(run, "set long, class long, own boolean, keys long")


PAIRS = "a long, b long, margin long"
#: In place of a margin: a group has more pairs than it gave.
MORE = -1


def close_pairs(groups: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Pairs of different components that sizes and sketches allow, one of them in its own band, from groups ``(set, class, comp, own, n, sketch)``.

    ``margin`` says by how many shingles the sketches differ less than they may.  With ``best`` a group gives one pair, that of
    the largest margin, for each two components, and a row ``(set, 0, MORE)`` if it has other pairs.
    """

    def best_of(p, ka, kb):
        low, high = np.minimum(ka, kb), np.maximum(ka, kb)
        order = np.lexsort((-p[:, 2], high, low))
        low, high = low[order], high[order]
        return p[order[np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(order)]]]

    def pairs_of(name, c, k, o, n, x):
        # Members of the largest component meet only the others.
        kinds, of, size = np.unique(k, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(of != np.argmax(size))
        order = np.full(len(c), len(c))
        order[rest] = np.arange(len(rest))
        block = max(1, (1 << 20) // (len(c) * x.shape[1]))
        for at in range(0, len(rest), block):
            own = rest[at : at + block]
            a, b = np.nonzero((order[own][:, None] < order[None, :]) & (k[own][:, None] != k[None, :]))
            a = own[a]
            ok = (o[a] | o[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            margin = allowed(n[a] + n[b], percent) - np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
            a, b, margin = a[margin >= 0], b[margin >= 0], margin[margin >= 0]
            p = np.c_[np.minimum(c[a], c[b]), np.maximum(c[a], c[b]), margin]
            if best:
                every, p = len(p), best_of(p, k[a], k[b])
                if every > len(p):
                    yield np.array([[name, 0, MORE]])
            yield p

    def run(batches):
        rest = None

        def cut(rows, last):
            name = rows.column("set").to_numpy()
            edge = np.r_[0, np.flatnonzero(name[1:] != name[:-1]) + 1, len(name)]
            if not last:
                edge = edge[:-1]  # the last group may go on
            c, k, n = (rows.column(f).to_numpy() for f in ("class", "comp", "n"))
            o = rows.column("own").to_numpy(zero_copy_only=False)
            x, out = rows.column("sketch").to_pylist(), []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out += pairs_of(name[a], c[a:b], k[a:b], o[a:b], n[a:b], folded(x[a:b], min(map(len, x[a:b]))))
            p = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
            return table(a=p[:, 0], b=p[:, 1], margin=p[:, 2]), rows.slice(int(edge[-1]))

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
                got, rest = cut(rows.to_batches()[0], False)
                rest = pa.Table.from_batches([rest])
                yield got
        if rest is not None and rest.num_rows:
            yield cut(rest.combine_chunks().to_batches()[0], True)[0]

    return groups.repartition("set").sortWithinPartitions("set").select("set", "class", "comp", "own", "n", "sketch").mapInArrow(run, PAIRS)


def allowed(total: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles similar sets of the sizes' total differ at most."""
    return total - 2 * -(-percent * total // (100 + percent))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b, margin)`` that sizes and sketches do not rule out (no similar pair is lost)."""
    side = lambda x: reps.select(F.col("class").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
    sized = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            width = np.array([min(len(u), len(v)) for u, v in zip(x, y, strict=True)])
            margin = allowed(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w).tolist()
                margin[at] -= np.bitwise_count(folded([x[i] for i in at], w) ^ folded([y[i] for i in at], w)).sum(1, dtype=np.int64)
            keep = pa.array(margin >= 0)
            yield table(a=batch.column("a").filter(keep), b=batch.column("b").filter(keep), margin=margin[margin >= 0])

    return sized.mapInArrow(run, PAIRS)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the plausible pairs ``(a, b)`` that are similar, found on the sets of one document of each class."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = materialise(wanted.join(reps.select("class", F.col("rep").alias("id")), "class"), "wanted")
    classes = Filter(wanted.select(F.col("class").alias("id")))

    def sets(ids, texts):
        flat, bounds = sets_of(texts, width)
        own = classes_of(flat, bounds)
        # An id that several texts share stands for the one of a wanted class; of a class any document will do.
        keep = np.flatnonzero(classes.holds(own) & (np.diff(bounds) > 0))
        raw = [flat[bounds[k] : bounds[k + 1]].tobytes() for k in keep.tolist()]
        return table(**{"class": own[keep]}, shingles=pa.array(raw, pa.binary()))

    # Not written: both joins take them from the exchange that leaves one of each class.
    sets = Filter(wanted.select("id")).scan(docs, "class long, shingles binary", sets).dropDuplicates(["class"])
    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias("s" + x))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if len(u) > len(v):
                    u, v = v, u
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialise(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"), "links")
    for read in (wanted, pairs):
        remove(read)
    return links


# --- units spent twice: one-deletion neighbourhoods -----------------------------------------------

_SAME, _LESS = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def own_segments(docs: DataFrame, short: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """``(class, band, segment, size, b)``: the filled segments, with the names of their keys, of the sets ``short`` (class, rep) in their own band."""
    bands = Bands(percent)

    def own(ids, texts):
        flat, bounds = sets_of(texts, width)
        n, cls = np.diff(bounds), classes_of(flat, bounds)
        band = np.array([bands.of(x) if x else 0 for x in n.tolist()], np.int64)
        m = np.array([bands.segments(b) for b in band.tolist()], np.int64) * (n > 0)
        who, segment, size, total = segment_sums(spread_of(flat), np.repeat(np.arange(len(texts)), n), m)
        return table(**{"class": cls[who]}, band=band[who], segment=segment, size=size, b=named(keys_of(total, band[who], segment), buckets))

    found = Filter(short.select(F.col("rep").alias("id"))).scan(docs, "class long, band long, segment long, size long, b long", own)
    return found.dropDuplicates(["class", "segment"])


def deletion_rows(docs: DataFrame, lists: DataFrame, near: DataFrame, width: int, percent: int, buckets: int, used: dict[int, dict[int, bool]]) -> DataFrame:
    """Packed entries for the segments that are spent twice, of probes (marked) and of the index.

    Probes ``lists`` (id, class, segments): a set's subset, to meet those with one shingle more, and its deletions,
    to meet those with one less.  The index holds both, for the ``used`` segments, of every set whose id is in
    ``near``; empty subsets only where a probe has one shingle.
    """

    def packed(rows, probe: bool):
        bands, pack, out = Bands(percent), Packer(buckets), []
        for t, cls, own in rows:
            s = shingles(t, width)
            if not len(s) or (cls is not None and int(classes_of(s, np.array([0, len(s)]))[0]) != cls):
                continue
            b, keys = bands.of(len(s)), []
            for band in (b,) if probe else (b, b + 1):
                if band not in used:
                    continue
                segment, spread, size, total = subsets(s, band, bands.segments(band))
                pick = np.array(own if probe else sorted(used[band]), np.int64)
                whole = pick if probe else pick[(size[pick] > 0) | np.array([used[band][x] for x in pick.tolist()], bool)]
                at = np.flatnonzero(np.isin(segment, pick))
                keys.append(keys_of(total[whole] ^ (_LESS if probe else _SAME), band, whole))
                keys.append(keys_of((total[segment[at]] - spread[at]) ^ (_SAME if probe else _LESS), band, segment[at]))
            if keys:
                flat = np.concatenate(keys)
                one = classes_of(s, np.array([0, len(s)]))
                pack.add(one, np.array([len(s)]), flat, np.zeros(len(flat), np.int64), np.full(len(flat), int(probe)))
            if pack.full():
                out += pack.rows()
        return out + pack.rows()

    def index(ids, texts):
        rows = packed(((t, None, None) for t in texts), False)
        return entry_batch(rows) if rows else pa.RecordBatch.from_pylist([], entry_batch([(0, *[b""] * 8)]).schema)

    def probes(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", TEXTS):
                rows = packed(zip(texts, part.column("class").to_pylist(), part.column("segments").to_pylist(), strict=True), True)
                if rows:
                    yield entry_batch(rows)

    mine = Filter(lists.select("id")).scan(docs, "id long, text string", lambda ids, texts: table(id=ids, text=pa.array(texts, pa.string())))
    mine = mine.join(lists, "id").select("text", "class", "segments").mapInArrow(probes, ENTRIES)
    return mine.unionByName(Filter(near).scan(docs, ENTRIES, index))


def meet_probes(rows: pa.Table) -> pa.Table:
    """Groups (kind 2 of FOUND) of the probes and index entries of each key: probes are marked as their own."""
    bucket = rows["bucket"][0].as_py()
    keys, classes, _, marks, _ = unpack(rows, probes=True)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    out: list[tuple] = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        own, n = classes[a:b], marks[a:b].astype(np.int64)
        if not n.any() or n.all() or (own == own[0]).all():
            continue
        group = np.c_[own, n]
        name, key = digest(group[:, 0] * 2 + group[:, 1]), (bucket << TRAVEL) | int(keys[a])
        for at in range(0, len(group), ROW):
            cut = group[at : at + ROW]
            out.append((2, name, key, digest(cut[:, 0] * 2 + cut[:, 1]), 0, cut.tobytes(), None))
    kinds = [pa.int32()] + [pa.int64()] * 4 + [pa.binary(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


# --- the join --------------------------------------------------------------------------------------


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bucket: int = BUCKET, light: int = LIGHT, hot: int = HOT, detail: bool = False) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    ``component_id`` is the smallest id reachable over pairs of sets with a Jaccard similarity of ``percent``
    hundredths or more.  Null, empty and blank texts have no shingle and are linked with nothing; equal texts are
    linked; rows with a null id get a null component and link nothing; no row gives no row.  With ``detail`` two
    columns follow, for ids that stand for several texts: ``text_hash``, Spark's ``xxhash64`` of the text, and ``group_id``, which
    tells components of the same smallest id apart (null where nothing is linked by right).
    """
    if not PERCENT_FLOOR <= percent < 100:
        raise ValueError(f"percent must be from {PERCENT_FLOOR} to 99")
    kind = dict(docs.dtypes)[id_col]
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Words are rarely shorter than five characters with their space; the estimate only sizes the buckets.
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // (5 * bucket)))
    packed = entry_rows(docs, width, percent, buckets, hot)
    found = materialise(packed.groupBy("bucket").applyInArrow(meet, FOUND), "groups")
    rows = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("class"), F.col("chunk").alias("n"), "filled", F.col("members").alias("sketch"), "hash")
    real = rows.where("id is not null and n > 0")
    reps = real.groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("filled").alias("filled"), F.first("sketch").alias("sketch"))
    reps = materialise(reps, "classes")
    docs = docs.where("id is not null")
    links = verified(plausible(found.where("kind = 1"), reps, percent), reps, docs, width, percent)
    roots = components(links)

    own = members(found).join(roots, "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
    every = own = materialise(own, "members")
    parts = own.groupBy("set", "comp").agg(F.count("*").alias("c")).groupBy("set").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inner"))
    mixed = parts.withColumn("load", (F.col("size") * F.col("size") - F.col("inner")) / 2).where("load > 0").select("set", "size", "load")
    own = materialise(join_by_set(own, mixed), "mixed")
    cand = own.where(F.col("load") <= light).select("set", "class", "own")
    extra = shared_lookups(docs, reps, own.where(F.col("load") > light), found, roots, width, percent, buckets)
    if extra is not None:
        cand = cand.unionByName(extra)
    cand = materialise(cand, "candidates")
    remove(every)
    remove(own)
    sketched = lambda groups: groups.join(reps.select("class", "n", "sketch"), "class")

    # One pair for each two components first, the most likely; then all that are still apart.
    near = materialise(close_pairs(sketched(mixed_groups(cand, roots)), percent, best=True), "near")
    best = near.where(F.col("margin") != MORE)
    first = between(best, roots).groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), "margin").alias("p")).select("p.a", "p.b")
    first = materialise(first, "first")
    links = links.unionByName(verified(first, reps, docs, width, percent))
    roots = components(links)
    # Components only grow, so a group that gave all its pairs has no others now.
    more = near.where(F.col("margin") == MORE).select(F.col("a").alias("set")).distinct()
    later = close_pairs(sketched(mixed_groups(cand.join(more, "set", "left_semi"), roots)), percent)
    later = later.unionByName(between(best, roots).select(*later.columns)).select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(later, reps, docs, width, percent))
    for read in (cand, near, first):
        remove(read)
    roots = components(links)
    named_by = reps.select("class", "rep").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named_by.groupBy("root").agg(F.min("rep").alias("component"))
    of = named_by.join(least, "root").select("class", "component", "root")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    out = rows.select("id", "n", "hash", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(of, "class", "left")
    extras = [F.col("hash").alias("text_hash"), F.when(F.col("id").isNotNull(), F.col("root")).alias("group_id")] if detail else []
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), *extras)


def join_by_set(own: DataFrame, mixed: DataFrame) -> DataFrame:
    """Members of the sets of ``mixed``; a large set is dealt over parts."""
    part = F.pmod(F.col("class"), F.lit(16)).cast("int")
    return own.withColumn("part", part).join(mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["set", "part"]).drop("part")


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose components ``ca < cb`` differ."""
    of = lambda x: roots.select(F.col("class").alias(x), F.col("root").alias("r" + x))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return out.where(ra != rb).select("a", "b", "margin", F.least(ra, rb).alias("ca"), F.greatest(ra, rb).alias("cb"))


def shared_lookups(docs: DataFrame, reps: DataFrame, heavy: DataFrame, found: DataFrame, roots: DataFrame, width: int, percent: int, buckets: int) -> DataFrame | None:
    """Groups ``(set, class, own)`` of the sets whose free segments (filled, and not shared by too many) are fewer than the units to spend.

    Where few are missing, free segments are spent twice; where many are, the set belongs to a dense family, and
    its smallest shared subsets are looked up as they are.  None if no set misses a unit.
    """
    shared = heavy.where("own").groupBy("class").agg(F.sum("keys").alias("shared"))
    need = F.expr(f"(2 * n * {100 - percent}) div {100 + percent} + 1")
    short = reps.join(shared, "class", "left").withColumn("free", F.col("filled") - F.coalesce("shared", F.lit(0)))
    short = short.withColumn("missing", need - F.col("free")).where("missing > 0").withColumn("lacking", F.greatest(need - F.col("filled"), F.lit(0)))
    sparse = (F.col("missing") <= DENSE * F.col("free")) | (F.col("missing") == F.col("lacking"))
    short = short.withColumn("twice", F.when(sparse, F.col("missing")).otherwise(F.col("lacking"))).withColumn("once", F.col("missing") - F.col("twice"))
    short = materialise(short.select("class", "rep", "twice", "once"), "short")
    if not short.head(1):
        return None
    order = Window.partitionBy("class").orderBy("size", "set")
    mine = heavy.where("own").join(short.where("once > 0").select("class", "once"), "class")
    # A group of several keys is worth as many units.
    mine = mine.withColumn("before", F.sum("keys").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("keys")).where("before < once")
    mine = materialise(mine.select("set", "class", "comp"), "lookups")
    met = in_blocks(mine, heavy)
    twice = short.where("twice > 0").select("class", "rep", F.col("twice").alias("missing"))
    if twice.head(1):
        groups = materialise(spent_twice(docs, reps, twice, found, heavy, width, percent, buckets).select("set", "class", "own"), "probed")
        apart = mixed_groups(groups, roots)
        met = met.unionByName(in_blocks(apart.where("own"), apart))
    return met


def in_blocks(mine: DataFrame, every: DataFrame) -> DataFrame:
    """Groups ``(set, class, own)`` in which each of ``mine`` (own) meets ``every`` member of its set, a block of both at a time."""
    size = lambda rows, name: rows.groupBy("set").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    blocks = materialise(size(mine, "i").join(size(every, "j"), "set"), "lookup-blocks")

    def dealt(rows: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        at = rows.join(blocks, "set").withColumn("at", F.pmod(F.xxhash64("class"), F.col(own))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        first, second = ("at", "to") if probe else ("to", "at")
        return at.select(F.xxhash64("set", first, second).alias("set"), "class", F.lit(probe).alias("own"))

    return dealt(mine, "i", "j", True).unionByName(dealt(every, "j", "i", False))


def mixed_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Members ``(set, class, comp, own)`` of the groups that reach over components."""
    own = materialise(groups.join(roots, "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root"), "probed-of")
    mixed = own.groupBy("set").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("set")
    return join_by_set(own, mixed)


def spent_twice(docs: DataFrame, reps: DataFrame, short: DataFrame, found: DataFrame, heavy: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Groups ``(set, class, own)`` of the sets that miss units (own) and those they may be similar to: as many of their free segments as units are missing are spent twice.

    Cheapest first: segments of two or more shingles, then the lowest numbers, as the index pays for a segment once.
    """
    keys = found.where("kind = 2").select(F.col("a").alias("set"), "b").join(heavy.select("set").distinct(), "set").select("b").distinct()
    free = own_segments(docs, short, width, percent, buckets).join(keys, "b", "left_anti").join(short, "class")
    order = Window.partitionBy("class").orderBy(F.col("size") < 2, "segment")
    chosen = materialise(free.withColumn("no", F.row_number().over(order)).where("no <= missing").select("class", "rep", "band", "segment", "size"), "chosen")
    # Bounded by the segments of all bands: a geometric series up to the longest set.
    used: dict[int, dict[int, bool]] = {}
    for r in chosen.groupBy("band", "segment").agg(F.min("size").alias("least")).collect():
        used.setdefault(r["band"], {})[r["segment"]] = r["least"] < 2
    lists = materialise(chosen.groupBy("class", F.col("rep").alias("id")).agg(F.collect_list("segment").alias("segments")), "lists")
    # Only sets in a used band, or in the one below it, can be partners.
    bands = Bands(percent)
    spans = [(bands.edge(b - 1), bands.edge(b + 1)) for b in sorted(used)]
    near = reps.where(functools.reduce(lambda x, y: x | y, [(F.col("n") >= a) & (F.col("n") < b) for a, b in spans])) if spans else reps.limit(0)
    entries = deletion_rows(docs, lists, near.select(F.col("rep").alias("id")), width, percent, buckets, used)
    return members(entries.groupBy("bucket").applyInArrow(meet_probes, FOUND))
