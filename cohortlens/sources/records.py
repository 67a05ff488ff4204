"""Records of CSV files with line breaks inside values, found by any number of tasks per file.

A line break belongs to a value when the quotes before it are odd in number.
Each split of a file counts its quotes first; the sums of the splits before it
then tell a split whether it begins inside a value. That holds for regular
records only (quotes enclose whole values, and are doubled inside), so every
record is tested: files with any other record are named and read whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Executors need not have this package installed: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VALUE = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
REGULAR = re.compile(rf"{_VALUE}(?:,{_VALUE})*")
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
RECORDS = "path string, block bigint, part int, record string, regular boolean, header boolean"


def _row(path: str, block: int, part: int, lines: list[bytes], header: bool) -> dict | None:
    """A record or part of one; an empty line between records is none."""
    raw = b"\n".join(lines)
    if not raw and part == WHOLE:
        return None
    text = raw.decode("utf-8", "replace")
    # A record that goes on in another split is tested once it is whole.
    sound = "�" not in text and (part != WHOLE or bool(text.strip() and REGULAR.fullmatch(text)))
    if header:
        sound = sound and part == WHOLE and "\n" not in text and not text.startswith("﻿")
    return {"path": path, "block": block, "part": part, "record": text, "regular": sound, "header": header}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, line, inside) in file order to ``RECORDS``."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("record", pa.string()), ("regular", pa.bool_()), ("header", pa.bool_())])
    at, held, inside, begun, first, out = None, [], False, True, False, []

    def close(ended: bool) -> None:
        nonlocal first
        part = (WHOLE if begun else HEAD) if ended else (TAIL if begun else MIDDLE)
        row = _row(*at, part, held, first)
        if row is not None:
            out.append(row)
            first = False

    for batch in batches:
        for r in batch.to_pylist():
            if at != (r["path"], r["block"]):
                if held:
                    close(False)
                at, held, inside, begun, first = (r["path"], r["block"]), [], r["inside"], not r["inside"], r["block"] == 0
            held.append(r["line"])
            inside ^= bool(r["line"].count(b'"') % 2)
            if not inside:
                close(True)
                held, begun = [], True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tests records put together from parts; one that never ended is not regular."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["regular"] = r["regular"] and r["part"] == HEAD and bool(REGULAR.fullmatch(r["record"]))
            r["part"] = WHOLE
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def found(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``RECORDS`` of the files: every record but empty ones, whether it is regular and whether it is its file's header."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    quotes = F.sum(F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit(""))))
    blocks = lines.groupBy("path", "block").agg(quotes.alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    placed = lines.select("path", "block", F.col("line").cast("binary").alias("line")).join(F.broadcast(blocks), ["path", "block"])
    return placed.mapInArrow(_records, RECORDS)


def joined(parts: DataFrame) -> DataFrame:
    """``RECORDS`` with the parts of records that cross splits put together: at most two parts per split."""
    order = W.partitionBy("path").orderBy("block", "part")
    chain = F.sum((F.col("part") == TAIL).cast("int")).over(order)
    pieces = F.sort_array(F.collect_list(F.struct("block", "part", "record")))
    # The last part decides: only a head ends the record.
    whole = parts.where(F.col("part") != WHOLE).withColumn("_chain", chain).groupBy("path", "_chain").agg(
        F.min("block").alias("block"), F.max_by("part", F.struct("block", "part")).alias("part"),
        F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"),
        F.min("regular").alias("regular"), F.max("header").alias("header"),
    ).drop("_chain").select(*parts.columns)
    return parts.where(F.col("part") == WHOLE).unionByName(whole.mapInArrow(_tested, RECORDS))
