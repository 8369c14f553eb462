"""Best-fit packing of tokenised documents, improved by swap-based local search.

A full piece is a sequence of its own.  The others are dealt by hash into groups of bounded size, by
their lengths alone, so each group is packed in one small task; a group starts from best fit in falling order, then empties its least
filled bins: documents move out, or are exchanged one for one or two for one against
shorter ones of other underfull bins.  Every step raises the sum of squared fills.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import pretokens
from .pretokens import byte_letters
from .common import scan, table

# Fixed value: a file whose texts are split by the public byte-level pattern alone.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Short pieces of one group, without their ids: bounds a task's memory; each group wastes at most part of one sequence.
GROUP = 8192
#: Sequences of full pieces are numbered from here, above those of all groups.
FULL = 1 << 62


#: A longer run of white space overflows the stack of tiktoken's regular expression (at about a million).
BLANKS = 50_000
_BLANK_RUN = regex.compile(rf"(?<![{pretokens.SPACE}])[{pretokens.SPACE}]{{{BLANKS},}}+")


class Encoder:
    """Little-endian 32-bit ids of texts, special strings included, as a byte-level tokenizer file gives them.

    Where the file's ids are in the order of its merges, as in rank files, the same vocabulary runs in
    tiktoken, several times as fast as tokenizers; any other file goes through tokenizers itself, and so
    does each very long run of white space.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"].get("vocab", {})
        made = [vocab[m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]] for m in model.get("merges", [])]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL and not model["ignore_merges"] and made == sorted(made)
        plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if plain:
            import tiktoken

            byte = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if all(c in byte for c in t) and i not in {x["id"] for x in spec["added_tokens"]}}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            engine = tiktoken.Encoding("of file", pat_str=pretokens.PIECES.pattern, mergeable_ranks=ranks, special_tokens=special)
            self.short = lambda t: engine.encode(t, allowed_special="all") if any(x in t for x in special) else engine.encode_ordinary(t)
            self.special = tuple(special)
            # A special string with white space inside might reach over the edge of a run.
            self.one = self._whole if any(regex.search(rf"[{pretokens.SPACE}]", x) for x in special) else self._apart
        else:
            self.one = self._whole

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _apart(self, text: str) -> list[int]:
        """Ids with each very long run of white space on its own.

        Before other characters a run is one piece up to its last character, which starts what follows
        (before a special string or the end: all of it);
        a piece never reaches into a run from the left, so the parts' ids are those of the text.
        """
        if len(text) < BLANKS:
            return self.short(text)
        out, at = [], 0
        for m in _BLANK_RUN.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(self.special, m.end()) else m.end() - 1
            out += self.short(text[at : m.start()]) if m.start() > at else []
            out += self._whole(text[m.start() : end])
            at = end
        return out + self.short(text[at:])

    def __call__(self, texts: list[str]) -> list[bytes]:
        of = {t: np.array(self.one(t), "<u4").tobytes() for t in set(texts)}
        return [of[t] for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each document's ids and the end id, cut only if longer than ``capacity``.

    The first piece takes the remainder, all others are full.  Null text is an empty document: its end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def start():
        encode = encoder(tokenizer)

        def one(part, texts):
            own, ids = part.column(id_col), encode(texts)
            rows, cols = [], ([], [], [], [], [])
            for k, b in enumerate(ids):
                b += end
                n = len(b) // 4
                at, no = 0, 0
                while at < n:
                    size = ((n - 1) % capacity + 1) if not no else capacity
                    cut = b[4 * at : 4 * (at + size)]
                    rows.append(k)
                    for c, v in zip(cols, (no, at, size, zlib.crc32(cut), cut), strict=True):
                        c.append(v)
                    at, no = at + size, no + 1
            out = {id_col: own.take(pa.array(rows, pa.int64())), "piece": pa.array(cols[0], pa.int32())}
            out |= {c: pa.array(v, pa.int64()) for c, v in zip(("start", "length", "ids_crc32"), cols[1:4], strict=True)}
            return table(**out, **({"ids": pa.array(cols[4], pa.binary())} if keep_ids else {}))

        return one

    kind = dict(docs.dtypes)[id_col]
    return scan(docs, [id_col, text_col], text_col, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""), start)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size: falling order, each into the fullest bin it fits in.

    Bins by free space; a bit for each free space that some bin has finds the tightest in one step.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, out = 0, 0, np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
        else:
            free, b, bins = capacity, bins, bins + 1
        out[k] = b
        by_free[free - size].append(b)
        some |= 1 << (free - size)
    return out


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int, steps: int = 20_000, pairs: int = 24) -> np.ndarray:
    """Exchanges documents between underfull bins until bins empty or nothing helps.

    From the least filled bin: a move into the tightest bin with room, else the one-for-one
    exchange that fills another bin most, else two documents for one.  All of them raise the sum
    of squared fills, so the search ends; ``steps`` bounds it besides.  ``pairs`` is how many of a bin's
    longest documents are tried two at a time.  Of bins with equal lengths in them one is tried: what helps
    none of them helps no other.  The result is a packing whatever the bounds.
    """
    bins = bins.copy()
    fill = np.bincount(bins, sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    members: list[set[int]] = [set() for _ in fill]
    for k, b in enumerate(bins.tolist()):
        members[b].add(k)
    stuck, hopeless = np.zeros(len(fill), bool), set()
    open_bins = int((fill > 0).sum())

    def held(b: int) -> tuple[int, ...]:
        return tuple(sorted(sizes[list(members[b])].tolist()))

    while steps > 0 and open_bins > least:
        under = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(under):
            break
        low = int(under[np.argmin(fill[under])])
        if held(low) in hopeless:
            stuck[low] = True
            continue
        changed = True
        while changed and fill[low] and steps > 0:
            changed, steps = False, steps - 1
            own = np.array(sorted(members[low]), np.int64)
            own = own[np.argsort(-sizes[own], kind="stable")]
            free = capacity - fill
            free[low] = -1
            free[(fill == 0) | (fill < fill[low])] = -1
            others = np.flatnonzero(free[bins] > 0)
            room = free[bins[others]]
            for a in own.tolist():
                ok = np.flatnonzero(free >= sizes[a])
                if len(ok):
                    to = int(ok[np.argmin(free[ok])])
                    fill[low] -= sizes[a]
                    fill[to] += sizes[a]
                    bins[a], changed = to, True
                    members[low].remove(a)
                    members[to].add(a)
                    break
            if changed:
                continue
            tried = [[a] for a in own.tolist()] + [[a, b] for i, a in enumerate(own[:pairs].tolist()) for b in own[i + 1 : pairs].tolist()]
            best, choice = 0, None
            for give in tried:
                gain = sizes[give].sum() - sizes[others]
                gain = np.where((gain > 0) & (gain <= room), gain, 0)
                if len(gain) and (top := int(gain.max())) > best:
                    best, choice = top, (give, int(others[np.argmax(gain)]))
                    if len(give) == 1 and len(own) > 1 and best == int(free.max()):
                        break
            if choice:
                give, take = choice
                to = int(bins[take])
                fill[to] += best
                fill[low] -= best
                bins[give], bins[take], changed = to, low, True
                members[low] = (members[low] - set(give)) | {take}
                members[to] = (members[to] | set(give)) - {take}
        if fill[low]:
            stuck[low] = True
            hopeless.add(held(low))
        else:
            open_bins -= 1
            stuck[:] = False
            hopeless.clear()
    return bins


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each size; offsets have no gaps."""
    bins = local_search(sizes, best_fit(sizes, capacity), capacity)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.r_[True, np.diff(bins[order]) != 0]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(sizes)]))
    return bins, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Pieces of all documents (see ``pieces``) with ``(sequence_id, offset)``.

    Null texts are empty documents; repeated rows are packed as often as they occur, and are dealt over the groups like
    any others; null ids stay null; an empty table gives no rows.  Other columns are not read.
    """
    made = pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids)
    names = made.columns
    # Stored with the pieces, so that a piece keeps its number however often it is read.
    cut = materialise(made.withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select(*names, (F.lit(FULL) + F.col("piece_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    dealt = short.select("piece_no", "length", "ids_crc32", F.pmod(F.xxhash64("piece_no"), F.lit(groups)).alias("group_no"))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("ids_crc32", "ascending"), ("piece_no", "ascending")])
        bins, offset = place(rows["length"].to_numpy(), capacity)
        no = rows["group_no"][0].as_py()
        return pa.table({"piece_no": rows["piece_no"], "sequence_id": pa.array((no << 32) + bins), "offset": pa.array(offset)})

    placed = dealt.groupBy("group_no").applyInArrow(one, "piece_no long, sequence_id long, offset long")
    return short.join(placed, "piece_no").select(*names, "sequence_id", "offset").unionByName(full)
