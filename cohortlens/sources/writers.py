"""Writers for id lists, tables, metrics, record dumps and review forms."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_ids(ids: DataFrame, path: str, name: str = "subject_id") -> None:
    """Globally sorted ids, one per line, written in parallel range partitions."""
    ordered = ids.select(F.col(name).cast("string").alias("value"), F.col(name).alias("_k"))
    ordered.repartitionByRange("_k").sortWithinPartitions("_k").select("value").write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quoting that survives line breaks in text."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_nested(df: DataFrame, path: str, groups: dict[str, Sequence[str]]) -> None:
    """JSON lines with the given columns nested under named objects."""
    nested = {c for columns in groups.values() for c in columns}
    df.select(
        *[c for c in df.columns if c not in nested],
        *[F.struct(*columns).alias(name) for name, columns in groups.items()],
    ).write.json(path)


def write_split_manifest(splits: DataFrame, path: str, mode: str, key: str = "subject_id") -> None:
    """Split manifest as JSON lines (split, key, mode): no id list is gathered."""
    splits.select("split", key, F.lit(mode).alias("split_mode")).write.partitionBy("split").json(path)


def write_records(blocks: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One formatted text block per row, column ``value``; a folder per value of ``by``."""
    blocks.select(*by, "value").write.option("lineSep", "\n").partitionBy(*by).text(path)


def review_form(scores: DataFrame, n: int = 50, key: Sequence[str] = ("subject_id", "hadm_id"), by: Sequence[str] = ()) -> DataFrame:
    """The n best-scored rows of each ``by`` group, numbered, with blank reviewer columns.

    The rank filter becomes a limit in front of the shuffle: a task sends at most n rows of a group.
    """
    number = F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), *key))
    return scores.withColumn("patient_number", number).where(F.col("patient_number") <= n).select(
        *by, "patient_number", *key, F.col("score").alias("model_score"),
        F.lit(None).cast("string").alias("reviewer_rating"),
        F.lit(None).cast("string").alias("reviewer_notes"),
    )


def stored_path(root: str, model: str, source: str) -> str:
    """Folder of one model's scores of one input: another model or input never meets it."""
    return f"{root.rstrip('/')}/{hashlib.md5(f'{model}|{source}'.encode()).hexdigest()}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """True once a write to ``path`` was committed; a half-written folder is not complete."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def reuse_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Stored scores if ``path`` holds them in full, else compute, store (over a broken write) and read back."""
    if not is_complete(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
