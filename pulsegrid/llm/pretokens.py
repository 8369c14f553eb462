"""Splits texts where byte-level pair merging never crosses.

Between two splits at single spaces no pre-token can reach over, so a text whose
white space never doubles is its space-separated chunks, each with the space
before it.  Texts with runs of white space take the full pattern.  Caches are
keyed by chunk, so each distinct chunk is counted about once in a worker.
"""

from __future__ import annotations

import json

import regex

# Fixed value: the white space of the pre-token pattern, written out as Python's class differs.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the public byte-level pre-token pattern over that white space.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
DOUBLE = regex.compile(rf"[{SPACE}][{SPACE}]")
#: Entries that a worker's cache may reach before it is emptied.
CACHE = 700_000


def specials(path: str) -> dict[str, int]:
    """Special strings of a tokenizer file, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def chunks(text: str) -> list[str] | None:
    """Chunks of a text without special strings, or None where white space doubles.

    The first has its own leading character; a space before each other one is implied.
    """
    return None if DOUBLE.search(text) else text.split(" ")


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies show each byte: printable ones as they are, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]
