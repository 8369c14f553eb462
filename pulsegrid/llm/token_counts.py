"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a step lie end to end in one integer array.  In each round
every sequence finds its lowest-ranked neighbour pair, all of its places are merged
at once (left to right where a pair overlaps itself), and sequences without a pair
leave with the number of symbols that survived.  A pair can only follow from merges
of lower rank, so this ends where one-by-one merging ends.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import pretokens
from .common import scan, table

NONE = np.iinfo(np.int32).max
#: Bytes from which a piece is merged by itself, and is not kept in the cache.
LONG = 256


class Merges:
    """Merge ranks of a byte-level tokenizer file as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks, self.made = pairs[order], order.astype(np.int32), made
        self.byte = np.array([vocab[c] for c in pretokens.byte_letters()], np.int64)

    def pair_ranks(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of each symbol's pair with the next one; NONE at the last of a sequence."""
        out = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            at = np.flatnonzero(~last[:-1])
            key = (ids[at] << 32) | ids[at + 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == key, self.ranks[k], NONE)
        return out

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) piece."""
        raw = [p.encode() for p in pieces]
        long = [k for k, r in enumerate(raw) if len(r) > LONG]
        if long:
            out = np.zeros(len(raw), np.int64)
            short = [k for k, r in enumerate(raw) if len(r) <= LONG]
            out[short] = self.counts([pieces[k] for k in short]) if short else 0
            out[long] = [self.count_long(raw[k]) for k in long]
            return out
        size = np.array([len(r) for r in raw], np.int64)
        out = size.copy()
        ids = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), size)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            last = np.r_[seq[1:] != seq[:-1], True]
            rank = self.pair_ranks(ids, last)
            width = np.diff(np.r_[starts, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, starts), width)
            live = least != NONE
            ended = starts[~live[starts]]
            out[seq[ended]] = np.diff(np.r_[starts, len(ids)])[~live[starts]]
            hit = (rank == least) & live
            # In a run of overlapping places every second one is a merge.
            at = np.flatnonzero(hit)
            if len(at):
                first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                at = at[place % 2 == 0]
                ids[at] = self.made[rank[at]]
                live[at + 1] = False
            ids, seq = ids[live], seq[live]
        return out


    def count_long(self, raw: bytes) -> int:
        """Symbols left of one long piece.

        The places of its pairs wait by rank; the lowest rank is merged at all its places at once, and only the
        pairs beside them are ranked anew.  These rank higher, as a symbol is made before it is paired.
        """
        ids = self.byte[np.frombuffer(raw, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = self.pair_ranks(ids, np.arange(n) == n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[now[at] != NONE]
            rank = now[at]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(at) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[a:b])

        wait(np.arange(n))
        left = n
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[now[at] == rank]
            if not len(at):
                continue
            # Places that overlap form a chain; every second one of a chain is a merge.
            new = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0]
            gone = after[at]
            ids[at] = self.made[rank]
            now[gone] = NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left -= len(at)
            beside = before[at]
            pair = np.unique(np.r_[at, beside[beside >= 0]])
            ends = after[pair] >= n
            now[pair[ends]] = NONE
            pair = pair[~ends]
            key = (ids[pair] << 32) | ids[after[pair]]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            now[pair] = np.where(self.keys[k] == key, self.ranks[k], NONE)
            wait(pair)
        return left


class Counter:
    """Counts the tokens of texts; a cache keeps the chunks met before."""

    def __init__(self, path: str, cache: int = pretokens.CACHE):
        self.merges, self.limit, self.known = Merges(path), cache, {}
        self.heads: dict[str, int] = {}
        special = pretokens.specials(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def measure(self, strings: list[str]) -> dict[str, int]:
        """Counts of whole strings; those that the pattern cuts are the sums of their pieces."""
        whole, cuts = [], {}
        for s in strings:
            # A word of letters, with or without a space before it, is one piece.
            if s.isalpha() or s[1:].isalpha() and s[0] == " ":
                whole.append(s)
            else:
                cuts[s] = pretokens.PIECES.findall(s)
        pieces = whole + list({p for cut in cuts.values() for p in cut}.difference(whole))
        if not pieces:
            return {}
        of = dict(zip(pieces, self.merges.counts(pieces).tolist(), strict=True))
        one = of.__getitem__
        out = {s: sum(map(one, cut)) for s, cut in cuts.items()}
        for s in whole:
            out[s] = one(s)
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known = {}
        if len(self.heads) > self.limit:
            self.heads = {}
        out, parts, extra = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                out[k] = len(self.special.findall(text))
                extra += [(k, s) for s in self.special.split(text) if s]
            elif text:
                extra.append((k, text))
        new, whole = set(), set()
        for k, text in extra:
            cut = pretokens.chunks(text)
            parts.append((k, text, cut))
            if cut is None:
                whole.update(pretokens.PIECES.findall(text))
            else:
                whole.add(cut[0])
                new.update(cut[1:])
        whole.discard("")
        self.known.update(self.measure(list(whole - self.known.keys())))
        # Chunks after a space are kept by themselves, so that looking one up builds no string.
        new -= self.heads.keys()
        self.heads.update((s[1:], n) for s, n in self.measure([" " + c for c in new]).items())
        for k, text, cut in parts:
            if cut is None:
                out[k] += sum(map(self.known.__getitem__, pretokens.PIECES.findall(text)))
            else:
                out[k] += (self.known[cut[0]] if cut[0] else 0) + sum(map(self.heads.__getitem__, cut[1:]))
        # The cache is bounded in bytes, too: long strings don't stay.
        for s in [s for s in whole if len(s) > LONG]:
            del self.known[s]
        for s in [s for s in new if len(s) > LONG]:
            del self.heads[s]
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process: tasks that follow find the cache filled."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, by the tokenizer file's vocabulary.

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows stay as they are;
    special strings of the file count one token each; an empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """

    def start():
        count = counter(tokenizer)

        def one(part, texts):
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            n = np.array(count(texts), np.int64)
            return table(**{id_col: part.column(id_col), "n_bytes": sizes, "n_tokens": n, "over_limit": pa.array(n > limit)})

        return one

    kind = dict(docs.dtypes)[id_col]
    return scan(docs, [id_col, text_col], text_col, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", start)
