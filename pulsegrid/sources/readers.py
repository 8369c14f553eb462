"""Scans of recordings, headers and side tables."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACC, OPTICAL
from ..functions.scalars import rebase_millis, to_number
from ..operators.segments import dense_index

# File endings and the format they stand for.
FORMATS = {"h5": "h5", "hdf5": "h5", "csv": "csv", "txt": "txt", "tsv": "txt"}


def infer_format(path: str, strict: bool = False) -> str:
    """Format by file ending; an unknown ending is returned bare, or refused
    when ``strict`` (which also takes ``.json`` for text)."""
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    known = {**FORMATS, "json": "txt"} if strict else FORMATS
    if strict and ext not in known:
        raise ValueError(f"unsupported file ending: .{ext}")
    return known.get(ext, ext)


def format_of(path: Column) -> Column:
    """``infer_format`` on a column of paths."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), ext)


def session_of(path: Column, depth: int = 1) -> Column:
    """Session id of a file: its parent folder (``depth`` 1) or bare name (0)."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1 - depth)
    return F.regexp_replace(name, r"\.[^.]*$", "") if depth == 0 else name


def path_epoch(path: Column) -> Column:
    """Recording start from a file name that is Unix milliseconds."""
    return F.timestamp_millis(F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).cast("bigint"))


def header_start(line: Column) -> Column:
    """``(device, started)`` of a header line ``# {"<device>": {"date", "time"}}``."""
    parsed = F.from_json(F.trim(F.substring(line, 3, 1_000_000)), "map<string, struct<date:string, time:string>>")
    first = F.get(F.map_entries(parsed), F.lit(0))
    stamp = F.try_to_timestamp(F.concat_ws(" ", first["value"]["date"], first["value"]["time"]))
    return F.struct(first["key"].alias("device"), stamp.alias("started"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """First header line of every file: ``(path, device, started)``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    found = lines.where(F.col("value").startswith("# {")).groupBy("path").agg(F.min_by("value", "at").alias("value"))
    return found.select("path", F.inline(F.array(header_start(F.col("value")))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and a position in it: ``(path, line_no, value)``.

    Lines stay in file order inside a split, and splits are ordered by their
    start offset, so the number only needs the line counts of earlier splits.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), "value",
        F.monotonically_increasing_id().alias("_seq"),
    )
    return dense_index(raw, ["path"], "_seq", "line_no", bucket=F.col("_block"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace matrix with ``#`` comments: ``(session_id, sample_idx, vals)``."""
    lines = numbered_lines(spark, path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    cells = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.try_cast("double"))
    rows = lines.select(session_of(F.col("path")).alias("session_id"), "line_no", cells.alias("vals"))
    return dense_index(rows, ["session_id"], "line_no").select("session_id", "sample_idx", "vals")


def reference_from_matrix(matrix: DataFrame, fs: float = 100.0) -> DataFrame:
    """Reference channels by position: saturation 4, red 3, infrared 2."""
    at = lambda i: F.get("vals", F.lit(i))
    return matrix.select(
        "session_id", "sample_idx", (F.col("sample_idx") / F.lit(fs)).alias("time"),
        at(3).alias("red"), at(2).alias("ir"), at(4).alias("spo2"),
    )


#: Different header lines that the files of one read may have.
HEADERS = 256


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, session: Callable[[Column], Column] = session_of,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A headed table as text columns plus ``session_id`` and ``sample_idx``.

    ``sep`` None means commas for ``.csv`` and any whitespace otherwise.  Cells of
    a separator are read as CSV, so quotes may hold it; a quoted line break is
    not supported.  Each file has its own header; ``columns`` picks from them, a
    column that a file lacks is null.  Rows are numbered in file order;
    ``session`` names a recording from its path, and no two files may share a name.
    """
    if sep is None and infer_format(path) == "csv":
        sep = ","
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("session_id", session(F.col("path")))
    heads = lines.where("line_no = 0")
    doubled = heads.groupBy("session_id").agg(F.count(F.lit(1)).alias("files")).where("files > 1").limit(3).collect()
    if doubled:
        raise ValueError(f"several files share a session: {[r.session_id for r in doubled]}")
    # Bounded: the different headers, not the files.
    found = [r.value for r in heads.select("value").distinct().limit(HEADERS + 1).collect()]
    if not found or len(found) > HEADERS:
        raise ValueError(f"{len(found) or 'no'} header lines in {path}")
    rows = lines.where("line_no > 0").join(heads.select("path", F.col("value").alias("_head")), "path")
    names = {h: _split_header(h, sep) for h in found}
    wanted = list(columns) if columns is not None else list(dict.fromkeys(n for h in sorted(names) for n in names[h]))
    cells = {n: F.lit(None).cast("string") for n in wanted}
    for head, own in names.items():
        if sep is None:
            part = F.split(F.trim("value"), r"\s+")
            at = {n: F.trim(F.get(part, F.lit(i))) for i, n in enumerate(own)}
        else:
            schema = ", ".join(f"`c{i}` string" for i in range(len(own)))
            part = F.from_csv("value", F.lit(schema), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
            at = {n: part[f"c{i}"] for i, n in enumerate(own)}
        for n in wanted:
            if n in at:
                cells[n] = F.when(F.col("_head") == head, at[n]).otherwise(cells[n])
    return rows.select("session_id", (F.col("line_no") - 1).alias("sample_idx"), *[c.alias(n) for n, c in cells.items()])


def _split_header(line: str, sep: str | None) -> list[str]:
    if sep is None:
        return [n.strip('"') for n in line.split()]
    return [n.strip() for n in next(csv.reader([line], delimiter=sep, skipinitialspace=True))]


def prototype_table(
    raw: DataFrame, mapping: Mapping[str, str], fs: float = 50.0, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Prototype recording from named text or number columns.

    A mapped optical channel must exist; a mapped accelerometer axis may be
    missing.  Time comes from the timestamp column (milliseconds recognised by
    size, counted from the smallest) or from the sampling rate.
    """
    missing = [f"{c} -> {mapping[c]}" for c in OPTICAL if c in mapping and mapping[c] not in raw.columns]
    if missing:
        raise KeyError(f"prototype columns not found: {missing}")
    channels = [c for c in OPTICAL if c in mapping] + [c for c in ACC if mapping.get(c) in raw.columns]
    out = raw.select(*keys, "sample_idx", *[to_number(F.col(mapping[c])).alias(c) for c in channels],
                     *([to_number(F.col(mapping["timestamp"])).alias("_ts")] if mapping.get("timestamp") in raw.columns else []))
    if "_ts" in out.columns:
        out = rebase_millis(out, keys, "_ts").drop("_ts")
    else:
        out = out.withColumn("time", F.col("sample_idx") / F.lit(fs))
    return out.select(*keys, "sample_idx", "time", *channels)


def read_reference(spark: SparkSession, path: str, keys: Mapping[str, str], fs: float = 100.0, fmt: str = "auto") -> DataFrame:
    """Reference recording ``(session_id, sample_idx, time, red, ir, spo2)``.

    HDF5 goes through the library's data source; parquet holds the same columns
    under the mapped names.
    """
    fmt = infer_format(path) if fmt == "auto" else fmt
    if fmt == "h5":
        from .hdf5 import HDF5Source

        spark.dataSource.register(HDF5Source)
        opts = {k: keys[k] for k in ("red", "ir", "spo2")}
        return spark.read.format("pulsegrid_hdf5").options(path=path, fs=str(fs), **opts).load()
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        return raw.select(
            "session_id", "sample_idx", (F.col("sample_idx") / F.lit(fs)).alias("time"),
            *[F.col(keys[c]).cast("double").alias(c) for c in ("red", "ir", "spo2")],
        )
    raise ValueError(f"unsupported reference format: '{fmt}'")


def read_prototype(spark: SparkSession, path: str, mapping: Mapping[str, str], fs: float = 50.0, fmt: str = "auto", sep: str | None = None) -> DataFrame:
    fmt = infer_format(path) if fmt == "auto" else fmt
    if fmt in ("txt", "csv"):
        return prototype_table(read_delimited(spark, path, sep), mapping, fs)
    if fmt == "parquet":
        return prototype_table(spark.read.parquet(path), mapping, fs)
    raise ValueError(f"unsupported prototype format: '{fmt}'")


@dataclass(frozen=True)
class Source:
    """A recording's file, its format (by suffix unless given) and the file's names of our channels."""

    path: str
    columns: Mapping[str, str]
    format: str = "auto"


def reference_source(path: str, format: str = "auto", **columns: str) -> Source:
    return Source(path, {c: c for c in ("time", "red", "ir", "spo2")} | columns, format)


def prototype_source(path: str, format: str = "auto", **columns: str) -> Source:
    # The prototype's files write the axes with a capital prefix.
    named = {c: c for c in ("timestamp", *OPTICAL)} | {c: c.replace("acc", "ACC") for c in ACC}
    return Source(path, named | columns, format)


def load_data(spark: SparkSession, reference: Source, prototype: Source, reference_rate: float = 100.0, prototype_rate: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Both recordings of a session, or of as many as the paths hold."""
    return (
        read_reference(spark, reference.path, reference.columns, reference_rate, reference.format),
        read_prototype(spark, prototype.path, prototype.columns, prototype_rate, prototype.format),
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, session_id, role)``: files of a folder, ``role`` counts by name."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
        .load(path).select("path")
    )
    from pyspark.sql import Window

    by_folder = files.withColumn("session_id", session_of(F.col("path")))
    order = Window.partitionBy("session_id").orderBy("path")
    return by_folder.withColumn("role", F.row_number().over(order) - 1)


def with_sidecar(files: DataFrame, sidecars: DataFrame, suffix: str = "_ppg.dat", side_suffix: str = "_2hz.csv") -> DataFrame:
    """Waveform files whose side table exists, with their common ``stem``."""
    cut = lambda s: F.regexp_replace("path", s.replace(".", r"\.") + "$", "")
    main = files.where(F.col("path").endswith(suffix)).withColumn("stem", cut(suffix))
    side = sidecars.where(F.col("path").endswith(side_suffix)).select(cut(side_suffix).alias("stem"))
    return main.join(side, "stem", "left_semi")


def first_match(dim: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    rest = [c for c in dim.columns if c not in keys]
    best = dim.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_d"))
    return best.select(*keys, "_d.*")


def stem(suffix: str) -> Callable[[Column], Column]:
    """Session id from a file name without its ``suffix``."""
    tail = suffix.replace(".", r"\.") + "$"
    return lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), tail, "")


def read_side_table(
    spark: SparkSession, path: str, column: str = "ScalcO2", session: Callable[[Column], Column] = stem("_2hz.csv")
) -> tuple[DataFrame, DataFrame]:
    """2 Hz saturation table: samples ``(session_id, sample_idx, spo2)`` and the
    clock text of the first row ``(session_id, clock)``."""
    raw = read_delimited(spark, path, ",", session, [column, "Timestamp"])
    samples = raw.select("session_id", "sample_idx", to_number(F.col(column)).alias("spo2"))
    stamp = raw.where("sample_idx = 0").select("session_id", F.expr("substring(Timestamp, 12, length(Timestamp) - 12)").alias("clock"))
    return samples, stamp

