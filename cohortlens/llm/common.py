"""What several operators of this package need: reading, storing, running totals, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens import llm
from cohortlens.session import materialise, scratch_path, tune

__all__ = ["arrow_map", "groups", "materialise", "ready", "row_key", "running_totals", "scratch_path", "table"]

# Executors need not have this package installed: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(llm)

#: Rows and bytes of one Arrow batch: what a Python worker holds of its input at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Adaptive execution, and Arrow batches that stay small whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's ``columns`` (all by default): equal rows share them, others do not but for a chance of 2^-128.

    Unlike row numbers they stay the same however often and wherever a table is read.
    """
    kinds = dict(df.dtypes)
    # Maps cannot be hashed.
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] else F.col(f"`{c}`") for c in columns or df.columns]
    # A hash passes over nulls, so their places go in as well.
    nulls = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in columns or df.columns])
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit(1), nulls, *parts, F.lit(2))


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with empty batches taken out."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(b for b in batches if b.num_rows)

    return df.mapInArrow(some, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def running_totals(df: DataFrame, keys: Sequence[str], spot: Column, ties: Sequence[str], value: str, slices: int = 4096) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows of the same keys) and ``total``.

    Rows of a key stand in the order of the 64-bit hash ``spot``, then ``ties``.
    The hash cuts each key into even slices: slice totals are summed first, so
    no window holds more than one slice of a key, however large the key is.
    """
    keys = list(keys)
    cut = df.withColumn("_spot", spot).withColumn("_slice", F.pmod(F.shiftright("_spot", 40), F.lit(slices)))
    parts = cut.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_part"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_sum").over(W.partitionBy(*keys)).alias("total"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = W.partitionBy(*keys, "_slice").orderBy("_spot", *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(parts, [*same, F.col("_slice") == F.col("_part")])
    before = F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn("before", before).drop("_spot", "_slice", "_part", "_ahead", *[f"_k{i}" for i in range(len(keys))])
