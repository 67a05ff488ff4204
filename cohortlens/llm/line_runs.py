"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. A run is a table of line keys
with the smallest doc_id that has each, bucketed and sorted by key. A batch's keys are
merge-joined with every run without moving the runs: known keys get their owner
from there, the rest become a new run of level 0. When a level has ``fanout``
runs they are compacted into one of the next level, so a key is rewritten once
per level and a batch meets few runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, materialise, ready, scratch_path
from cohortlens.llm.shingles import code_points, line_spans, slices, span_hashes, utf8

LEAST_CODE_POINTS, BATCHES, FANOUT = 10, 6, 3
SLICE_BYTES = 2 << 20
_LAST = (1 << 63) - 1
_SECOND = 0xD6E8FEB86659FD93


def _keys(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for a, b in slices(starts, SLICE_BYTES):
                part, begins = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
                begin, end, first = line_spans(part, begins)
                line = np.arange(len(begin)) - np.repeat(first[:-1], np.diff(first))
                doc = np.repeat(np.arange(a, b), np.diff(first))
                long = code_points(part, begin, end) >= least
                begin, end, line, doc = begin[long], end[long], line[long], pa.array(doc[long])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ord").take(doc),
                        batch.column("mark").take(doc),
                        pa.array(span_hashes(part, begin, end).view(np.int64)),
                        pa.array(span_hashes(part, begin, end, _SECOND).view(np.int64)),
                        pa.array(line.astype(np.int32)),
                    ],
                    ["ord", "mark", "hi", "lo", "line"],
                )

    return work


class Runs:
    """The runs so far, by level. Tables lie under the shared scratch folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run")
        keys.write.format("parquet").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch's lines (ord, mark, hi, lo, line) in; returns those that an earlier or smaller document has."""
        keys = lines.groupBy("hi", "lo").agg(F.min("ord").alias("owner"), F.count(F.lit(1)).alias("n"))
        known: list[Column] = []
        for level in self.levels:
            for name in level:
                at = f"known_{len(known)}"
                run = self.spark.table(name).where("fresh").select("hi", "lo", F.col("owner").alias(at))
                keys = keys.join(run, ["hi", "lo"], "left")
                known.append(F.col(at))
        owner = F.coalesce(*known, F.col("owner"))
        fresh = F.coalesce(*known).isNull() if known else F.lit(True)
        name = self._write(keys.select("hi", "lo", owner.alias("owner"), "n", fresh.alias("fresh")))
        # Read by its path and not by its buckets: both sides of the join are exchanged, so adaptive
        # execution splits the lines of a key that very many documents have.
        run = self.spark.read.schema("hi long, lo long, owner long, n long, fresh boolean").parquet(self.paths[name])
        shared = run.where("not fresh or n > 1").select("hi", "lo", "owner")
        dropped = materialise(lines.join(shared, ["hi", "lo"]).where("ord > owner").select("ord", "mark", "line"), "dropped")
        self._place(name, 0)
        return dropped

    def _place(self, name: str, at: int) -> None:
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(name)
        if len(self.levels[at]) < self.fanout:
            return
        # No key is fresh in two runs, so compaction only merges.
        names, self.levels[at] = self.levels[at], []
        merged = self.spark.table(names[0]).where("fresh")
        for other in names[1:]:
            merged = merged.union(self.spark.table(other).where("fresh"))
        self._place(self._write(merged.repartition(self.buckets, "hi", "lo")), at + 1)
        self._forget(names)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs' names out of the catalog; their files stay in the scratch folder."""
        for level in self.levels:
            self._forget(level)
        self.levels = []


def _ord() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def deduplicate_lines(docs: DataFrame, least: int = LEAST_CODE_POINTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with text freed of lines that a smaller doc_id has.

    Returns a struct ``row`` of the columns of ``docs`` as they came, with
    n_lines, n_dropped and kept_text. A line's key is the line stripped of
    ASCII white space, A-Z lower-cased; keys under ``least`` code points stay.
    Null and empty texts are one empty line. Rows without doc_id come after all
    others and count as one document, as do rows of one doc_id. The outcome does
    not depend on the batches. No rows give no rows.
    """
    spark = ready(docs.sparkSession)
    mark = F.xxhash64("doc_id", "text")
    facts = docs.select(_ord().alias("ord"), mark.alias("mark"), "text")
    schema = "ord long, mark long, hi long, lo long, line int"
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.select(_ord().cast("double").alias("o")).approxQuantile("o", shares, 0.01) if shares else []
    number = sum(((F.col("ord") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    path = scratch_path(spark, "lines")
    arrow_map(facts, _keys(least), schema).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{schema}, batch int").parquet(path)
    runs, dropped = Runs(spark, fanout), None
    try:
        for number in range(len(cuts) + 1):
            found = runs.add(lines.where(F.col("batch") == number).drop("batch"))
            dropped = found if dropped is None else dropped.union(found)
    finally:
        runs.close()
    per_row = dropped.groupBy("ord", "mark").agg(F.collect_set("line").alias("_gone"))
    per_row = per_row.select(F.col("ord").alias("_o"), F.col("mark").alias("_m"), "_gone")
    rows = docs.select(F.struct("*").alias("row"), _ord().alias("_ord"), mark.alias("_mark"))
    rows = rows.join(per_row, (F.col("_ord") == F.col("_o")) & (F.col("_mark") == F.col("_m")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = rows.select("row", F.split(text, "\n").alias("_lines"), text.alias("_text"), "_gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    joined = F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    return rows.select(
        "row",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(joined).alias("kept_text"),
    )
