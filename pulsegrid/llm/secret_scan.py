"""Secrets in texts: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass finds the words and prefixes that credentials carry; a pattern is tried only
at such a hit, anchored there.  Kinds that carry a checksum or a structured header are kept only if it
holds.  Long hexadecimal runs have no keyword, so their probe is every 24th character: a run of 24
covers one of them.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import hashlib
import itertools
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan, table

# Kinds in their order of listing; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = {"access": ("AKIA",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyJ",), "private_key": ("-----BEGIN ",)}
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
TAGGED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
# A header of three dotted parts; the first two begin as an object does.
JWT_PART, JWT_START = re.compile(r"[A-Za-z0-9_-]+"), "eyJ"
# A private key: its first line, a body of these letters, and the nearest last line.
PEM_FIRST, PEM_BODY, PEM_LAST = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), re.compile(r"[A-Za-z0-9+/=\s:,-]*"), re.compile(r"(?=(-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----))")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEN, ACCESS_LEN, HEX_LEN = 6, 20, 24


def _either_case(word: str) -> str:
    """A pattern of the word in either ASCII case (no other letter folds into it)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either_case, ASSIGN_WORDS)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Every keyword, the assignment words in each mixture of cases, with kind and length."""
    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for form in itertools.product(*({c, c.upper()} for c in word)):
            a.add_word("".join(form), ("assign", len(word)))
    for kind, words in PREFIXES.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum(body: str) -> str:
    """CRC-32 of a tagged token's body, as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def _header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of lower-case hexadecimal digits, 24 or more."""
    if len(text) < HEX_LEN:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    probe = codes[HEX_LEN - 1 :: HEX_LEN]
    at = np.flatnonzero(((probe >= 48) & (probe <= 57)) | ((probe >= 97) & (probe <= 102))) * HEX_LEN + HEX_LEN - 1
    out, end, digits = [], 0, "0123456789abcdef"
    for p in at.tolist():
        if p < end:
            continue
        stop = p + 1
        while stop < len(text) and text[stop] in digits:
            stop += 1
        start = p
        while start > end and text[start - 1] in digits:
            start -= 1
        if stop - start >= HEX_LEN:
            out.append((start, stop))
        end = stop
    return out


class Stretches:
    """Where the run of a pattern's letters around a place ends; no run is read twice, however many places ask."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.pattern, self.starts, self.ends = text, pattern, [], []

    def end(self, at: int) -> int:
        """End of the run at ``at``; ``at`` itself if no letter stands there."""
        k = bisect.bisect_right(self.starts, at) - 1
        if k >= 0 and at < self.ends[k]:
            return self.ends[k]
        m = self.pattern.match(self.text, at)
        if not m or m.end() == at:
            return at
        self.starts.insert(k + 1, at)
        self.ends.insert(k + 1, m.end())
        return m.end()


def web_token(text: str, start: int, parts: Stretches) -> tuple[int, int]:
    """``(end of the header, end)`` of the token at ``start``; the end is 0 if there is none, nor any that begins inside the header."""
    n = len(JWT_START)
    first = parts.end(start)
    second = parts.end(first + 1)
    third = parts.end(second + 1)
    good = first > start + n and text.startswith("." + JWT_START, first) and second > first + 1 + n and text.startswith(".", second) and third > second + 1
    return first, third if good else 0


def private_key(text: str, start: int, bodies: Stretches, last: list[tuple[int, int]]) -> int | None:
    """End of the key whose first line is at ``start``; ``last`` are the spans of all last lines."""
    m = PEM_FIRST.match(text, start)
    if not m:
        return None
    k = bisect.bisect_left(last, (m.end(), 0))
    return last[k][1] if k < len(last) and last[k][0] <= max(m.end(), bodies.end(m.end())) else None


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed; non-overlapping within a kind."""
    out = [("hex", s, e) for s, e in hex_runs(text)]
    done = dict.fromkeys(KINDS, 0)
    parts, bodies, last = Stretches(text, JWT_PART), Stretches(text, PEM_BODY), None
    for start, kind in sorted((stop + 1 - size, kind) for stop, (kind, size) in automaton().iter(text)):
        if start < done[kind]:
            continue
        end = None
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= ASSIGN_LEN
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and len(m[0]) >= ACCESS_LEN
        elif kind in ("github", "npm"):
            m = None if start and (text[start - 1].isalnum() or text[start - 1] == "_") else TAGGED.match(text, start)
            good = m and checksum(m[1]) == m[2]
        elif kind == "jwt":
            header, end = web_token(text, start, parts)
            m = good = end and _header(text[start:header])
            done[kind] = end or header
        else:
            if last is None:
                last = [m.span(1) for m in PEM_LAST.finditer(text)]
            good = m = end = private_key(text, start, bodies, last)
        if m:
            end = end or m.end()
            done[kind] = end
        if good:
            out.append((kind, start, end))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of every row: all secrets of the whole text, in order.

    Null or empty text has no spans; null ids and repeated rows stay; no row gives no row.
    Other columns are not read.
    """

    def start():
        def one(part, texts):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts]
            return table(**{id_col: part.column(id_col), "spans": pa.array(found, _SPANS)})

        return one

    return scan(docs, [id_col, text_col], text_col, f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans {SPANS}", start)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by its kind.

    Null text stays null and empty text empty; ids are not read, repeated rows stay; no row gives no row.
    """

    def start():
        def one(part, texts):
            had = part.column(text_col).is_valid().to_pylist()
            new = pa.array([redacted(t, find(t)) if h else None for t, h in zip(texts, had, strict=True)], pa.string())
            return part.set_column(part.schema.get_field_index(text_col), text_col, new)

        return one

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return scan(docs, [F.col(f"`{c}`") for c in docs.columns], text_col, schema, start)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """Hex SHA-256 of the base kinds' spans alone."""
    return hashlib.sha256(digest([x for x in spans if x[0] in KINDS[:3]]).encode()).hexdigest()
