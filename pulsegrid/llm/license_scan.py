"""License notices: ordered signature rules behind a keyword gate.

Every license below takes part in each signature template, which makes several hundred regular
expressions; the sentences of license bodies have rules of their own.  A rule carries literals of which
each match holds at least one; one automaton pass finds the literals, and only the rules of a literal
that occurs are tried, in a window around it.  Detections are taken by priority, then length; one that
lies inside an accepted detection is suppressed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, scan, table

# Base phrases and their labels.
BASE = (("mit", "license", "mit"), ("apache", "license", "apache"), ("general", "public", "license", "gpl"))

# Label; literals (by |) of which each match of its rules holds one; pattern of the name; the reference page, if it has one.
LICENSES = (
    ("mit", "mit", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit no attribution", ""),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?,? *(?:version|v\.?)? *2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?,? *(?:version|v\.?)? *1\.1", ""),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?,? *(?:version|v\.?)? *1\.0", ""),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license,? *(?:version|v\.?)? *3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license,? *(?:version|v\.?)? *2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license,? *(?:version|v\.?)? *1(?:\.0)?", ""),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license,? *(?:version|v\.?)? *3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license,? *(?:version|v\.?)? *2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license,? *(?:version|v\.?)? *2(?:\.0)?", ""),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license,? *(?:version|v\.?)? *3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("bsd-2-clause", "bsd", r"(?:2[- ]clause bsd|bsd[- ]2[- ]clause|simplified bsd)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3[- ]clause bsd|bsd[- ]3[- ]clause|new bsd|modified bsd)", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:4[- ]clause bsd|bsd[- ]4[- ]clause|original bsd)", ""),
    ("0bsd", "bsd", r"(?:0bsd|zero[- ]clause bsd)", ""),
    ("mpl-2.0", "mozilla", r"mozilla public license,? *(?:version|v\.?)? *2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "mozilla", r"mozilla public license,? *(?:version|v\.?)? *1\.1", ""),
    ("epl-2.0", "eclipse", r"eclipse public license,? *(?:version|v\.?)? *2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public license,? *(?:version|v\.?)? *1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", "common development", r"common development and distribution license", ""),
    ("isc", "isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", r"zlib", ""),
    ("bsl-1.0", "boost", r"boost software license", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", ""),
    ("artistic-2.0", "artistic", r"artistic license,? *(?:version|v\.?)? *2(?:\.0)?", ""),
    ("psf-2.0", "python software", r"python software foundation license", ""),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e", ""),
    ("ofl-1.1", "open font", r"(?:sil )?open font license", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"open (?:data commons )?(?:open )?database license", ""),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by-4.0", "by|attribution", r"(?:cc|creative commons)[- ](?:by|attribution)[- ]4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", "by|attribution", r"(?:cc|creative commons)[- ](?:by|attribution)[- ]3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-sa-4.0", "by-sa", r"(?:cc|creative commons)[- ]by-sa[- ]4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", "by-sa", r"(?:cc|creative commons)[- ]by-sa[- ]3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-nc-4.0", "by-nc", r"(?:cc|creative commons)[- ]by-nc[- ]4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc-3.0", "by-nc", r"(?:cc|creative commons)[- ]by-nc[- ]3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nd-4.0", "by-nd", r"(?:cc|creative commons)[- ]by-nd[- ]4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-4.0", "by-nc-sa", r"(?:cc|creative commons)[- ]by-nc-sa[- ]4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-4.0", "by-nc-nd", r"(?:cc|creative commons)[- ]by-nc-nd[- ]4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", ""),
)

# Priority, then a template around the name ({n}), the page ({u}) or the label ({i}).
TEMPLATES = (
    (95, r"spdx-license-identifier: *{i}(?:-only|-or-later)?\b"),
    (90, r"https?://(?:www\.)?{u}"),
    (85, r"\b(?:licen[sc]ed|released|distributed|published|made available|provided|covered|dual[- ]licen[sc]ed) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?{n}\b(?: licen[sc]e)?"),
    (80, r"\b(?:subject to|governed by|in accordance with|in compliance with) (?:the )?(?:terms of (?:the )?)?{n}\b(?: licen[sc]e)?"),
    (75, r"\b(?:see|under) (?:the )?{n} licen[sc]e\b"),
    (70, r"\blicen[sc]e: *{n}\b"),
    (65, r"\b{n} licen[sc]e\b"),
)
#: Titles that name a license without the word around them.
TITLES = 60
#: Sentences of license bodies.
BODY = 88
# Label, literal and pattern of a sentence that only this license's body or notice has.
BODIES = (
    ("mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", "permission", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "endorse", r"neither the names? of [^.]{1,80}? nor the names of (?:its|other|any|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl-3.0", "general", r"gnu general public license as published by the free software foundation[,;] (?:either )?version 3"),
    ("gpl-2.0", "general", r"gnu general public license as published by the free software foundation[,;] (?:either )?version 2"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license as published by the free software foundation[,;] (?:either )?version 3"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license as published by the free software foundation[,;] (?:either )?version 2\.1"),
    ("agpl-3.0", "affero", r"gnu affero general public license as published by the free software foundation[,;] (?:either )?version 3"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("bsl-1.0", "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("epl-2.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license,? (?:v|version) ?2\.0"),
    ("epl-1.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license,? (?:v|version) ?1\.0"),
    ("ofl-1.1", "font", r"the font software may be modified, altered, or added to"),
)
#: Code points on each side of a literal in which its rules may match; the part of a white-space run beyond GAP counts nothing.
WINDOW, GAP = 480, 8


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    literals: tuple[str, ...]
    pattern: re.Pattern


def _spaced(body: str) -> re.Pattern:
    """Each blank outside of brackets takes any white space."""
    return re.compile(body.replace(" ", r"\s+").replace(r"\s+*", r"\s*").replace(r"\s+?", r"\s*"))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All signature rules, highest priority first."""
    out = [Rule(label, BODY, tuple(literal.split("|")), _spaced(body)) for label, literal, body in BODIES]
    for label, literal, name, page in LICENSES:
        titled = "public license" in name or any(x in name for x in ("development and", "software license", "creative", "font", "database", "rights", "unlicense", "cc0", "wtfpl"))
        # White space inside a literal varies, so its first word stands for it.
        named = tuple(x.partition(" ")[0] for x in literal.split("|"))
        for priority, template in TEMPLATES:
            if "{u}" in template and not page:
                continue
            body = template.replace("{n}", f"(?:{name})").replace("{u}", page).replace("{i}", re.escape(label))
            own = (label,) if "{i}" in template else (page.replace("\\", "").partition("/")[0],) if "{u}" in template else named
            out.append(Rule(label, priority, own, _spaced(body)))
        if titled:
            out.append(Rule(label, TITLES, named, _spaced(rf"\b(?:{name})\b")))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def gate() -> tuple[ahocorasick.Automaton, dict[tuple[str, ...], list[Rule]]]:
    """The automaton gives, for each literal, the sets that hold it; the rules of a set are tried together."""
    by: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules():
        by.setdefault(r.literals, []).append(r)
    sets: dict[str, list[tuple[str, ...]]] = {}
    for key in by:
        for literal in key:
            sets.setdefault(literal, []).append(key)
    a = ahocorasick.Automaton()
    for literal, keys in sets.items():
        a.add_word(literal, keys)
    a.make_automaton()
    return a, by


_RUNS = re.compile(rf"\s{{{GAP + 1},}}")


def _reach(low: str):
    """``at -> (start, stop)`` of the window around a place; long runs of white space don't use it up."""
    runs = [m.span() for m in _RUNS.finditer(low)]
    if not runs:
        return lambda at: (max(0, at - WINDOW), min(len(low), at + WINDOW))
    # Places once each run is shortened to GAP: where its shortened form ends, and what was cut up to there.
    ends, cuts, cut = [], [0], 0
    for a, b in runs:
        cut += b - a - GAP
        ends.append(b - cut)
        cuts.append(cut)
    real = [b for _, b in runs]

    def window(at: int) -> tuple[int, int]:
        short = at - cuts[bisect_right(real, at)]
        start, stop = short - WINDOW, short + WINDOW
        return max(0, start + cuts[bisect_right(ends, start)]), min(len(low), stop + cuts[bisect_right(ends, stop)])

    return window


def detect(low: str) -> list[tuple[int, int, int, str]]:
    """``(start, end, priority, label)`` that survive suppression, in a lower-cased text."""
    a, by = gate()
    windows: dict[tuple[str, ...], list[list[int]]] = {}
    reach = None
    for end, keys in a.iter(low):
        reach = reach or _reach(low)
        start, stop = reach(end)
        for key in keys:
            runs = windows.setdefault(key, [])
            if runs and start <= runs[-1][1]:
                runs[-1][1] = stop
            else:
                runs.append([start, stop])
    found = set()
    for key, runs in windows.items():
        for start, stop in runs:
            for r in by[key]:
                found.update((m.start(), m.end(), r.priority, r.label) for m in r.pattern.finditer(low, start, stop))
    return suppress(found)


def suppress(found: set[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections that don't lie inside one of higher priority, or of the same and longer.

    One sweep by start, the longer first: a detection is covered if one of its priority or a higher one that began before reaches as far.
    """
    kept: list[tuple[int, int, int, str]] = []
    reach: dict[int, int] = {}
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(end >= d[1] for priority, end in reach.items() if priority >= d[2]):
            kept.append(d)
            reach[d[2]] = d[1] if d[1] > reach.get(d[2], 0) else reach[d[2]]
    return kept


# Words are runs of digits, letters and all that is not ASCII.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(start, label)`` of every base phrase; words count from 0."""
    out = []
    for k, w in enumerate(words):
        if w == b"license":
            for *phrase, label in BASE:
                n = len(phrase)
                if k + 1 >= n and words[k + 1 - n : k + 1] == [p.encode() for p in phrase]:
                    out.append((k + 1 - n, label))
    return sorted(out)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)`` of every row.

    ``score`` is the chance that at least one detection holds, each taken to hold with its priority in a
    hundred (base phrases: 65).  Null text counts as empty (no words, null places, empty labels, score 0);
    null ids and repeated rows stay; no row gives no row.  Other columns are not read.
    """

    def start():
        def one(part, texts):
            cols: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for t in texts:
                raw = t.encode().translate(LOWER)
                words = raw.translate(_WORDS).split()
                base = base_places(words) if b"license" in raw else []
                low = raw.decode()
                found = detect(low)
                own = {label for _, label in base}
                sure = [d[2] / 100 for d in found] + [0.65] * bool(base)
                row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {d[3] for d in found})))
                row += (float(1 - np.prod([1 - s for s in sure])) if sure else 0.0, [dict(zip(("start", "end", "priority", "label"), d, strict=True)) for d in found])
                for c, v in zip(cols, row, strict=True):
                    cols[c].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            return table(**{id_col: part.column(id_col)}, **{c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds, strict=True)})

        return one

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,priority:int,label:string>>"
    return scan(docs, [id_col, text_col], text_col, schema, start)
