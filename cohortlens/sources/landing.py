"""Incremental landing of multi-line note files as Parquet.

A CSV file with line breaks inside values takes two passes to be split between
tasks, so it should be parsed once. A manifest names every landed file by path, size and time with the
batch that holds its rows. A run parses only files that the manifest does not know;
a batch counts from the moment its manifest rows are committed, so readers never
see the rows of a run that failed. A file that changed is landed again, and its
newest batch replaces the older rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.prefix import join_parameters
from cohortlens.sources.readers import split_csv

MANIFEST = "path string, length bigint, modified timestamp, batch string, landed_at timestamp"
NOTES = "hadm_id bigint, text string, path string, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The landed files, one row per file and time it was landed."""
    path = f"{target}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if _exists(spark, path) else spark.createDataFrame([], MANIFEST)


def pending_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(path, length, modified) of the files under ``source`` that are new or changed; no content is read."""
    files = spark.read.format("binaryFile").load(source)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))
    return files.join(manifest(spark, target), ["path", "length", "modified"], "left_anti")


def land_notes(spark: SparkSession, source: str, target: str) -> int:
    """Parses the new files of ``source`` (hadm_id, text) into a batch under ``target``; returns how many there were."""
    new = pending_files(spark, source, target).collect()  # one row per file, as reading them needs their names
    if not new:
        return 0
    batch = uuid.uuid4().hex
    notes = split_csv(spark, [r.path for r in new])
    notes = notes.select(F.trim("hadm_id").try_cast("bigint").alias("hadm_id"), "text", "path")
    notes.withColumn("batch", F.lit(batch)).write.parquet(f"{target}/batches/{batch}")
    rows = spark.createDataFrame([(r.path, r.length, r.modified, batch) for r in new], "path string, length bigint, modified timestamp, batch string")
    rows.withColumn("landed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return len(new)


def landed_notes(spark: SparkSession, target: str, admissions: DataFrame | None = None) -> DataFrame:
    """(hadm_id, text) of the committed batches, each file as it was landed last, kept to ``admissions`` when given."""
    known = manifest(spark, target)
    newest = known.groupBy("path").agg(F.max_by("batch", F.struct("landed_at", "batch")).alias("batch"))
    batches = [r.batch for r in newest.select("batch").distinct().collect()]  # one row per run
    if not batches:
        return spark.createDataFrame([], "hadm_id bigint, text string")
    rows = spark.read.schema(NOTES).parquet(*[f"{target}/batches/{b}" for b in batches])
    notes = join_parameters(rows, newest, ["path", "batch"]).select("hadm_id", "text")
    return notes if admissions is None else notes.join(admissions.select("hadm_id"), "hadm_id", "left_semi")
