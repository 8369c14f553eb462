"""Repair of raw samples: validity, jumps, gaps, spikes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .quantiles import exact_quantiles
from .segments import SEGMENT_ROWS, carry_fill, join_stats, over_halo, shift_one


@dataclass(frozen=True)
class Plausible:
    """Which saturations (percent) can be true, and how far neighbours may differ."""

    low: float = 90.0
    high: float = 100.0
    jump: float = 5.0

    def __post_init__(self):
        if not self.low < self.high or self.jump <= 0:
            raise ValueError("a range needs low < high and a positive jump")


@dataclass(frozen=True)
class Spikes:
    """Length of the median window (samples), robust z limit, share of values taken as saturated."""

    window: int = 11
    limit: float = 6.0
    saturated: float = 0.999

    def __post_init__(self):
        if self.window % 2 == 0:
            raise ValueError("a median window has an odd length")


def in_range(x: Column, low: float, high: float) -> Column:
    """The value where it lies in the range, else null."""
    return F.when((x >= low) & (x <= high), x)


def jump_filter(
    df: DataFrame, keys: Sequence[str], col: str, low: float, high: float, max_jump: float,
    out: str | None = None, idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Null out-of-range samples and samples that jump from a surviving neighbour.

    Scanned in order, a nulled sample excuses the next one.  So within an
    unbroken run of too-large steps exactly the odd positions fall: the row
    needs only the distance to the start of its run, which is carried.
    """
    out = out or col
    x = F.col("_r")
    ranged = df.withColumn("_r", in_range(F.col(col), low, high))
    stepped = shift_one(ranged, keys, {"_p": x}, idx=idx, size=size)
    jump = F.coalesce(F.abs(x - F.col("_p")) > max_jump, F.lit(False))
    # the carry reads its input twice, so the shuffled step is staged
    staged = materialise(stepped.withColumn("_j", jump), "jumps")
    runs = carry_fill(staged, keys, {"_s": F.when(~F.col("_j"), F.col(idx))}, idx=idx, size=size)
    odd = F.col("_j") & ((F.col(idx) - F.col("_s")) % 2 == 1)
    return runs.withColumn(out, F.when(~odd, x)).drop("_r", "_p", "_j", "_s")


def interpolate(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column] | Sequence[str],
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fill nulls linearly by position; ends are held at the nearest value.

    ``cols`` names columns, or maps an output name to the expression to fill.
    """
    exprs = dict(cols) if isinstance(cols, Mapping) else {c: F.col(c) for c in cols}
    filled = carry_fill(
        df, keys, {f"_p_{n}": e for n, e in exprs.items()}, {f"_n_{n}": e for n, e in exprs.items()}, idx, size, positions=True
    )

    def line(n: str) -> Column:
        p, q, i, j = (F.col(c) for c in (f"_p_{n}", f"_n_{n}", f"_p_{n}_at", f"_n_{n}_at"))
        return F.when(p.isNull(), q).when(q.isNull() | (i == j), p).otherwise(p + (q - p) / (j - i) * (F.col(idx) - i))

    rest = [c for c in df.columns if c not in exprs]
    return filled.select(*rest, *[line(n).alias(n) for n in exprs])


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    a = F.sort_array(values)
    n = F.size(a)
    low = F.get(a, F.expr("0") + F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(a, F.floor(n / 2).cast("int"))) / 2


def moving_median(
    df: DataFrame, keys: Sequence[str], col: str, half: int = 2, out: str | None = None,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Centred median that shrinks at the ends and skips nulls."""
    def median(w):
        near = F.array(*[F.lag(col, j).over(w) for j in range(-half, half + 1)])
        return middle(F.array_compact(near))

    return over_halo(df, keys, {out or col: median}, idx, half, half, size)


def sanitize(
    df: DataFrame, keys: Sequence[str], col: str, low: float, high: float, max_jump: float,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Reference saturation: range, jumps, gaps, five-point median."""
    out = jump_filter(df, keys, col, low, high, max_jump, idx=idx, size=size)
    out = interpolate(materialise(out, "jumped"), keys, [col], idx, size)
    return moving_median(out, keys, col, 2, idx=idx, size=size)


def zero_edge_median(col: str, half: int):
    """Median over ``2 * half + 1`` samples with zeros beyond the ends."""
    def build(w):
        near = F.array(*[F.lag(col, j, 0.0).over(w) for j in range(-half, half + 1)])
        return F.get(F.sort_array(near), F.lit(half))

    return build


def median_filter(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], kernel: int = 11,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """``cols`` maps input to output; an even kernel is raised by one."""
    half = (kernel + 1 - kernel % 2) // 2
    return over_halo(
        df, keys, {o: zero_edge_median(c, half) for c, o in cols.items()}, idx, half, half, size
    )


def mark_spikes(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], kernel: int = 11, z: float = 6.0,
    saturation: float = 0.999, idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``{c}_base`` (median filter), ``{c}_spike`` and the session length ``_n``.

    A spike is a sample far from its local median, a step far from the usual
    step (both against the median absolute deviation), or a saturated value;
    its two neighbours are marked too, the first and last sample never are.
    The samples are staged once because three rounds of statistics read them.
    """
    half = (kernel + 1 - kernel % 2) // 2
    rest = float(1 - Decimal(repr(saturation)))
    local = {}
    for c in cols:
        local[f"{c}_base"] = zero_edge_median(c, half)
        local[f"_d_{c}"] = lambda w, c=c: F.col(c) - F.coalesce(F.lag(c, 1).over(w), F.col(c))
    staged = materialise(over_halo(df, keys, local, idx, half, half, size), "spikes")
    resid = {c: F.col(c) - F.col(f"{c}_base") for c in cols}
    first = {}
    for c in cols:
        first[f"_x_{c}"] = (F.col(c), [rest, saturation])
        first[f"_mr_{c}"] = (resid[c], [0.5])
        first[f"_md_{c}"] = (F.col(f"_d_{c}"), [0.5])
    # one row per session, read by three later branches
    with_medians = join_stats(staged, materialise(exact_quantiles(staged, keys, first), "medians"), keys)
    second = {}
    for c in cols:
        second[f"_ar_{c}"] = (F.abs(resid[c] - F.col(f"_mr_{c}")), [0.5])
        second[f"_ad_{c}"] = (F.abs(F.col(f"_d_{c}") - F.col(f"_md_{c}")), [0.5])
    spread = exact_quantiles(with_medians, keys, second)
    length = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    scored = join_stats(with_medians, spread.join(length, list(keys)), keys)
    marks = {}
    for c in cols:
        far = F.abs(0.6745 * resid[c] / (F.col(f"_ar_{c}") + 1e-12)) > z
        fast = F.abs(0.6745 * F.col(f"_d_{c}") / (F.col(f"_ad_{c}") + 1e-12)) > z
        clipped = (F.col(c) >= F.col(f"_x_{c}_1")) | (F.col(c) <= F.col(f"_x_{c}_0"))
        marks[f"_m_{c}"] = far | fast | clipped
    kept = scored.select(*df.columns, "_n", *[f"{c}_base" for c in cols], *[e.alias(m) for m, e in marks.items()])

    def widen(c):
        m = f"_m_{c}"
        inner = (F.col(idx) > 0) & (F.col(idx) < F.col("_n") - 1)
        return lambda w: inner & (
            F.col(m) | F.lag(m, 1, False).over(w) | F.lead(m, 1, False).over(w)
        )

    return over_halo(kept, keys, {f"{c}_spike": widen(c) for c in cols}, idx, 1, 1, size).drop(
        *[f"_m_{c}" for c in cols]
    )


def fill_spikes(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], kernel: int = 11, z: float = 6.0,
    saturation: float = 0.999, suffix: str = "_raw", idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Replace spikes by a straight line between good samples, as ``{c}{suffix}``.

    With fewer good samples than a tenth of the session (at least three) the
    median-filtered signal is the answer for the whole session.
    """
    marked = materialise(mark_spikes(df, keys, cols, kernel, z, saturation, idx, size), "marked")
    good = marked.groupBy(*keys).agg(*[F.count_if(~F.col(f"{c}_spike")).alias(f"_g_{c}") for c in cols])
    exprs = {f"{c}{suffix}": F.when(~F.col(f"{c}_spike"), F.col(c)) for c in cols}
    filled = join_stats(interpolate(marked, keys, exprs, idx, size), good, keys)
    floor = F.greatest(F.lit(3), F.expr("_n div 10"))
    rest = [c for c in df.columns if c not in exprs]
    chosen = {
        f"{c}{suffix}": F.when(F.col(f"_g_{c}") < floor, F.col(f"{c}_base")).otherwise(F.col(f"{c}{suffix}")) for c in cols
    }
    return filled.select(*rest, *[e.alias(n) for n, e in chosen.items()])
