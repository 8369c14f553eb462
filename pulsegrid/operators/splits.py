"""Train/test splits and block permutations over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import dense_index, join_stats


def with_length(df: DataFrame, keys: Sequence[str], idx: str, out: str = "_n") -> DataFrame:
    return join_stats(df, df.groupBy(*keys).agg((F.max(idx) + 1).alias(out)), keys)


def seeded_int(keys: Sequence[str], seed: int, below: Column) -> Column:
    """A repeatable integer in ``[0, below)`` per key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), below)


def purged_split(
    df: DataFrame, keys: Sequence[str], share: float, gap: int, start: Column, idx: str = "row", out: str = "part"
) -> DataFrame:
    """Contiguous test block from ``start``; training rows keep ``gap`` rows away.

    The block holds ``int(n * (1 - share)) + 1`` rows.  With a start below
    ``gap`` only the rows after the block train.  Rows in neither part stay out.
    """
    n, i = F.col("_n"), F.col(idx)
    size = F.floor(n * F.lit(1.0 - share))
    test = (i >= F.col("_s")) & (i <= F.col("_s") + size)
    tail = i >= F.col("_s") + size + gap
    head = (F.col("_s") >= gap) & (i < F.col("_s") - gap)
    # with no gap the row at the seam is in both parts
    part = F.array_compact(F.array(F.when(test, "test"), F.when(head | tail, "train")))
    return (
        with_length(df, keys, idx).withColumn("_s", start)
        .withColumn(out, F.explode(part)).drop("_n", "_s")
    )


def holdout_start(keys: Sequence[str], seed: int, share: float) -> Column:
    """Start position for ``purged_split``: 0 .. int(n * share) + 1 inclusive."""
    return seeded_int(keys, seed, F.floor(F.col("_n") * F.lit(share)) + 2)


def block_shuffle(
    df: DataFrame, keys: Sequence[str], block: int, rank: Column, idx: str = "row", out: str = "new_row"
) -> DataFrame:
    """Permute whole blocks of rows; an incomplete last block is dropped.

    ``rank`` is an integer that orders the blocks and may use ``_block``; a 64-bit
    hash gives a random order.  Only block numbers are ranked (one row per block,
    in buckets between quantiles of the rank, equal ranks by block), rows are moved by a join.
    """
    tagged = (
        with_length(df, keys, idx)
        .withColumn("_block", F.expr(f"`{idx}` div {block}"))
        .where(F.col("_block") < F.expr(f"_n div {block}"))
    )
    ranks = tagged.select(*keys, "_block").distinct().withColumn("_r", rank.cast("bigint"))
    cuts = ranks.groupBy(*keys).agg(F.percentile_approx("_r", [k / 64 for k in range(1, 64)], 1000).alias("_cuts"))
    ranks = join_stats(ranks, cuts, keys).withColumn("_run", F.size(F.filter("_cuts", lambda c: c <= F.col("_r"))))
    # A rank that many blocks share is the least of its bucket; its blocks are parted by their numbers.
    low = F.get("_cuts", F.col("_run") - 1)
    bucket = F.struct("_run", F.when(F.col("_r") == low, F.expr("_block div 65536")).otherwise(F.lit(1 << 62)).alias("_at"))
    blocks = dense_index(ranks.withColumn("_o", F.struct("_r", "_block")), keys, "_o", "_to", bucket=bucket).select(*keys, "_block", "_to")
    return (
        tagged.join(blocks, [*keys, "_block"])
        .withColumn(out, F.col("_to") * block + F.col(idx) % block)
        .drop("_n", "_block", "_to")
    )


def head_tail_split(df: DataFrame, keys: Sequence[str], share: float, idx: str = "row", out: str = "part") -> DataFrame:
    """First ``int(n * share)`` rows train, the rows after the next one test.

    The share is taken as the decimal it is written as: 0.7 of 90 rows are 63, though the product of doubles is less.
    """
    cut = F.floor(F.col("_n") * F.lit(Decimal(repr(share))))
    part = F.when(F.col(idx) < cut, "train").when(F.col(idx) > cut, "test")
    return with_length(df, keys, idx).withColumn(out, part).where(F.col(out).isNotNull()).drop("_n")


def repeated_holdout(
    df: DataFrame, keys: Sequence[str], repeats: int, share: float, gap: int, seed: int = 42, idx: str = "row",
    start: Column | None = None,
) -> DataFrame:
    """Mean line over ``repeats`` purged hold-outs: ``(keys, a, b)`` of a - b x.

    ``df`` holds ``x`` and ``y``.  Training blocks of the left-over length are
    cut to whole blocks of ``gap`` rows, as the block permutation does; the fit
    itself does not depend on their order.
    """
    from .models import fit_closed

    spark = df.sparkSession
    runs = df.join(F.broadcast(spark.range(repeats).withColumnRenamed("id", "rep")))
    by = [*keys, "rep"]
    first = start if start is not None else seeded_int(by, seed, F.floor(F.col("_n") * F.lit(share)) + 2)
    # a training row's place among its run's training rows, in closed form
    lined = with_length(runs.select(*by, idx, "x", "y"), by, idx).withColumn("_s", first)
    size = F.floor(F.col("_n") * F.lit(1.0 - share))
    head = F.when(F.col("_s") >= gap, F.least(F.col("_s") - gap, F.col("_n"))).otherwise(0)
    tail0 = F.col("_s") + size + gap
    place = F.when(F.col(idx) < head, F.col(idx)).otherwise(head + F.col(idx) - tail0)
    total = head + F.greatest(F.lit(0), F.col("_n") - tail0)
    kept = lined.where(((F.col(idx) < head) | (F.col(idx) >= tail0)) & (place < total - total % gap))
    fitted = fit_closed(kept.withColumn("w", F.lit(1.0)), by, ["linear"])
    return fitted.groupBy(*keys).agg(F.avg("p0").alias("a"), F.avg(-F.col("p1")).alias("b"))
