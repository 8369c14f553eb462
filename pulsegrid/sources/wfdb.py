"""Waveform records (text header plus 16-bit samples) as a Spark data source.

Reads the common layout without any waveform library: header line
``name signals rate samples [time]``, one line per signal
``file format gain(baseline)/units ...``, samples interleaved as little-endian
16-bit integers (format 16).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = 1 << 20
MISSING = -32768  # fixed value: the format's marker of an absent sample
SCHEMA = "session_id string, sample_idx bigint, clock string, fs double, channel array<string>, vals array<double>"


def parse_header(text: str) -> dict:
    """Rate, start time and signals of a record header."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0].split()
    count = int(head[1])
    signals = []
    for line in lines[1 : 1 + count]:
        part = line.split(None, 8)
        m = re.match(r"([-\d.eE+]+)?(?:\((-?\d+)\))?", part[2]) if len(part) > 2 else None
        gain = float(m.group(1)) if m and m.group(1) else 200.0
        zero = float(part[4]) if len(part) > 4 else 0.0
        signals.append({
            "file": part[0], "format": part[1], "gain": gain or 200.0,
            "baseline": float(m.group(2)) if m and m.group(2) else zero, "name": part[8].strip() if len(part) > 8 else "",
        })
    return {
        "fs": float(head[2].split("/")[0]) if len(head) > 2 else 250.0,
        "samples": int(head[3]) if len(head) > 3 else None, "clock": head[4] if len(head) > 4 else None, "signals": signals,
    }


class Frames(InputPartition):
    def __init__(self, path, start, stop):
        self.path, self.start, self.stop = path, start, stop


class WaveReader(DataSourceReader):
    """One task per run of frames, so a long record is read in parallel."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        out = []
        for hea in sorted(glob.glob(self.path, recursive=True)):
            with open(hea) as f:
                h = parse_header(f.read())
            if any(s["format"] != "16" for s in h["signals"]) or len({s["file"] for s in h["signals"]}) != 1:
                raise ValueError(f"{hea}: only single-file 16-bit records are read")
            data = os.path.join(os.path.dirname(hea), h["signals"][0]["file"])
            n = h["samples"] or os.path.getsize(data) // (2 * len(h["signals"]))
            out += [Frames(hea, at, min(at + FRAMES, n)) for at in range(0, n, FRAMES)]
        return out

    def read(self, part: Frames) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa

        with open(part.path) as f:
            h = parse_header(f.read())
        width = len(h["signals"])
        data = os.path.join(os.path.dirname(part.path), h["signals"][0]["file"])
        raw = np.fromfile(data, "<i2", (part.stop - part.start) * width, offset=2 * width * part.start).reshape(-1, width)
        gain = np.array([s["gain"] for s in h["signals"]])
        base = np.array([s["baseline"] for s in h["signals"]])
        vals = ((raw - base) / gain).ravel()
        n = len(raw)
        flat = pa.array(vals, mask=(raw == MISSING).ravel())
        names = pa.array([s["name"] for s in h["signals"]])
        session = os.path.basename(part.path)[: -len(".hea")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([session] * n), pa.array(np.arange(part.start, part.stop)), pa.array([h["clock"]] * n, pa.string()),
                pa.array(np.full(n, h["fs"])),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.concat_arrays([names] * n) if n else names.slice(0, 0)),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, flat),
            ],
            names=["session_id", "sample_idx", "clock", "fs", "channel", "vals"],
        )


class WaveSource(DataSource):
    @classmethod
    def name(cls):
        return "pulsegrid_wave"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WaveReader(self.options)


# The two known names of each channel, in order of preference.
NAMES = {"red": ("Red Signal", "RED"), "ir": ("IR Signal", "IR")}


def read_waves(spark, path: str):
    """``(session_id, sample_idx, clock, fs, red, ir)`` of all records at ``path``
    (a glob of header files)."""
    from pyspark.sql import functions as F

    spark.dataSource.register(WaveSource)
    raw = spark.read.format("pulsegrid_wave").option("path", path).load()

    def pick(names):
        at = [F.array_position("channel", n) for n in names]
        return F.coalesce(*[F.when(p > 0, F.get("vals", (p - 1).cast("int"))) for p in at])

    known = F.arrays_overlap("channel", F.array(*[F.lit(n) for n in NAMES["red"]]))
    checked = F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no red signal among "), F.array_join("channel", ", "))).cast("boolean"))
    return raw.where(checked).select("session_id", "sample_idx", "clock", "fs", *[pick(n).alias(c) for c, n in NAMES.items()])
