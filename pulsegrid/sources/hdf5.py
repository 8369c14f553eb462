"""HDF5 recordings as a Spark data source (needs ``h5py`` on the executors)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 1 << 20
SCHEMA = "session_id string, sample_idx bigint, time double, red double, ir double, spo2 double"
CHANNELS = ("red", "ir", "spo2")


class Slice(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def common_length(shapes: dict) -> int:
    """Shortest of the mapped datasets; a missing one is an error naming it."""
    missing = [f"{k} -> {v[0]}" for k, v in shapes.items() if v[1] is None]
    if missing:
        raise KeyError(f"dataset paths not found: {missing}")
    return min(v[1] for v in shapes.values())


class HDF5Reader(DataSourceReader):
    """One task per run of rows of a file, so a long recording is read in parallel."""

    def __init__(self, options):
        self.path, self.fs = options["path"], float(options.get("fs", "100"))
        self.keys = {c: options[c] for c in CHANNELS}

    def partitions(self):
        import glob

        import h5py

        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            with h5py.File(path, "r") as f:
                n = common_length({c: (k, max(f[k].shape) if k in f else None) for c, k in self.keys.items()})
            out += [Slice(path, at, min(at + ROWS, n)) for at in range(0, n, ROWS)]
        return out

    def read(self, part: Slice) -> Iterator:
        import h5py
        import numpy as np
        import pyarrow as pa

        with h5py.File(part.path, "r") as f:
            cols = {}
            for c, k in self.keys.items():
                d = f[k]
                # a (1, n) or (n, 1) dataset is sliced along its long axis
                cut = slice(part.start, part.stop)
                v = d[:, cut] if d.ndim == 2 and d.shape[0] == 1 else d[cut]
                cols[c] = np.asarray(v, dtype=float).reshape(-1)
        idx = np.arange(part.start, part.stop)
        session = part.path.rsplit("/", 2)[-2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([session] * len(idx)), pa.array(idx), pa.array(idx / self.fs)]
            + [pa.array(cols[c], mask=~np.isfinite(cols[c])) for c in CHANNELS],
            names=["session_id", "sample_idx", "time", *CHANNELS],
        )


class HDF5Source(DataSource):
    @classmethod
    def name(cls):
        return "pulsegrid_hdf5"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return HDF5Reader(self.options)
