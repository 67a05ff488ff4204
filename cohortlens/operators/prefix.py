"""Prefix sums, exact percentiles and hash ranks that no hot key can break.

A plain ordered window puts a whole group into one task. Here the order is
split by value first: totals of coarse value cells are summed over a window
that is bounded by the number of cells, and only the offset travels down to
the finer level. Every window sees at most about two million rows, whatever
the distribution of the values and however large a group is.

Missing grouping keys form a group of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BEFORE = (W.unboundedPreceding, -1)


def key_of(keys: Sequence[str]) -> Column:
    """The grouping keys as one struct: never null itself, and equal where the same keys are missing."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def join_parameters(df: DataFrame, params: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join with a parameter table that holds one row per key; missing keys are equal.

    A plain equi-join: adaptive execution broadcasts the table by its measured
    size and otherwise splits the keys that repeat over a large share of ``df``.
    """
    small = params.withColumn("_key", key_of(on)).drop(*on)
    return df.withColumn("_key", key_of(on)).join(small, "_key").drop("_key")


def value_cells(value: Column) -> tuple[Column, Column]:
    """Two nested cell numbers that grow with ``value``, for any double; NaN comes last.

    The first combines the binary exponent with ten mantissa bits, the second
    takes the next 21 bits. At most 2**21 distinct doubles share both.
    """
    x = value.cast("double")
    size = F.abs(x)
    usual = (size > 0) & (size < float("inf"))  # NaN is above infinity
    exponent = F.floor(F.log2(F.when(usual, size)))
    unit = F.when(usual, x / F.pow(F.lit(2.0), exponent)).otherwise(0.0)
    band = F.when(usual, F.signum(x) * (exponent + 1100)).otherwise(0.0)
    beyond = F.when(F.isnan(x), 6_000_000).when(size == float("inf"), F.signum(x) * 5_000_000)
    coarse = F.coalesce(beyond.cast("long"), (band * 2048 + F.floor(unit * 1024.0)).cast("long"))
    fine = F.floor(unit * 2147483648.0).cast("long")
    return coarse, fine


def prefix_sums(hist: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]) -> DataFrame:
    """Add ``<m>_below`` and ``<m>_total`` for each measure of a histogram.

    ``hist`` holds one row per (keys, order). ``<m>_below`` sums the measure
    over strictly smaller ``order`` values of the same keys. Both sides of the
    joins grow with the distinct values, so neither is broadcast: the file size
    of a stored table says little about its rows here.
    """
    coarse, fine = value_cells(F.col(order))
    cells = hist.withColumn("_k", key_of(list(keys))).withColumn("_c", coarse).withColumn("_f", fine)

    def before(m: str, part: Sequence[str], by: str) -> Column:
        window = W.partitionBy(*part).orderBy(by).rowsBetween(*_BEFORE)
        return F.coalesce(F.sum(m).over(window), F.lit(0))

    sums = [F.sum(m).alias(m) for m in measures]
    middle = cells.groupBy("_k", "_c", "_f").agg(*sums)
    top = middle.groupBy("_k", "_c").agg(*sums)
    top = top.select(
        "_k",
        "_c",
        *[before(m, ["_k"], "_c").alias(f"_{m}_top") for m in measures],
        *[F.sum(m).over(W.partitionBy("_k")).alias(f"{m}_total") for m in measures],
    )
    middle = middle.join(top.hint("merge"), ["_k", "_c"]).select(
        "_k",
        "_c",
        "_f",
        *[(F.col(f"_{m}_top") + before(m, ["_k", "_c"], "_f")).alias(f"_{m}_mid") for m in measures],
        *[f"{m}_total" for m in measures],
    )
    return cells.join(middle.hint("merge"), ["_k", "_c", "_f"]).select(
        *hist.columns,
        *[
            (F.col(f"_{m}_mid") + before(m, ["_k", "_c", "_f"], order)).alias(f"{m}_below")
            for m in measures
        ],
        *[f"{m}_total" for m in measures],
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key: one output column per level.

    Works on the value histogram, so a huge group costs its distinct values.
    Missing and NaN values are ignored.
    """
    keys = list(keys)
    hist = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cells = prefix_sums(hist, keys, "_v", ["_n"])
    parts = []
    for name, level in levels.items():
        place = (F.col("_n_total") - 1) * F.lit(float(level))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("_n_below") <= rank) & (rank < F.col("_n_below") + F.col("_n"))
            parts.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}_{name}"))
        parts.append(F.max(place - F.floor(place)).alias(f"_w_{name}"))
    out = cells.groupBy(*keys).agg(*parts)
    return out.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
            ).alias(n)
            for n in levels
        ],
    )


def hash_key(key: Sequence[str], seed: int) -> Column:
    """md5 of ``seed|key``: the sampling order, stable under repartitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def hash_ranks(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``hash_rank`` (1-based, in md5 order) and ``stratum_size`` per stratum.

    ``key`` must be unique within a stratum. The hash splits each stratum into
    65,536 even slices; ranks are counted inside a slice and shifted by the
    size of the slices before it, so no task receives a whole stratum.
    """
    strata = list(strata)
    hashed = df.withColumn("_h", hash_key(key, seed)).withColumn("_slice", F.substring("_h", 1, 4)).withColumn("_k", key_of(strata))
    slices = hashed.groupBy("_k", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ordered = W.partitionBy("_k").orderBy("_slice").rowsBetween(*_BEFORE)
    slices = slices.select(
        "_k",
        "_slice",
        F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy("_k")).alias("stratum_size"),
    )
    inside = W.partitionBy("_k", "_slice").orderBy("_h", *key)
    return (
        hashed.join(slices, ["_k", "_slice"])
        .withColumn("hash_rank", F.col("_offset") + F.row_number().over(inside))
        .drop("_h", "_slice", "_offset", "_k")
    )

