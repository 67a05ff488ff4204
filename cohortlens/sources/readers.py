"""Typed readers. CSV headers are matched by name and bad rows are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialise
from cohortlens.sources import records

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

# Column name and type per hospital table.
TABLES: dict[str, dict[str, T.DataType]] = {
    "patients": {"subject_id": _L, "gender": _S, "anchor_age": _I, "anchor_year": _I, "anchor_year_group": _S},
    "admissions": {
        "subject_id": _L, "hadm_id": _L, "admittime": _TS, "dischtime": _TS, "deathtime": _TS,
        "edregtime": _TS, "edouttime": _TS, "admission_type": _S, "insurance": _S, "race": _S,
    },
    "diagnoses_icd": {"subject_id": _L, "hadm_id": _L, "icd_code": _S, "icd_version": _S},
    "prescriptions": {"subject_id": _L, "hadm_id": _L, "drug": _S, "starttime": _TS, "stoptime": _TS},
}


def _typed(name: str, kind: T.DataType) -> Column:
    """Lenient conversion: a value that does not parse becomes null."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    return text.try_cast(kind)


def raw_csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Header CSV with every column as text, selected by header name later."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", multiline).option("mode", "PERMISSIVE").csv(path)


def split_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``raw_csv`` of files with line breaks inside values plus ``path``; a regular file is parsed by a task per split.

    The records are stored once. A file that holds any irregular one is parsed whole, by one task.
    """
    header = raw_csv(spark, paths, multiline=True)
    rows = records.joined(materialise(records.found(spark, paths), "records"))
    odd = [r.path for r in rows.where("NOT regular").select("path").distinct().collect()]  # at most one row per file
    schema = ", ".join(f"`{c}` string" for c in header.columns)
    parsed = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    out = rows.where(~F.col("header") & ~F.col("path").isin(odd)).select("path", parsed.alias("_v")).select("_v.*", "path")
    if odd:
        whole = raw_csv(spark, paths, multiline=True).withColumn("path", F.col("_metadata.file_path")).where(F.col("path").isin(odd))
        out = out.unionByName(whole)
    return out


def read_table(spark: SparkSession, table: str, path: str, columns: list[str] | None = None) -> DataFrame:
    """Hospital table with declared types, pruned to ``columns``.

    Columns missing from the file come out null, so an extract with fewer
    columns still reads.
    """
    wanted = {c: TABLES[table][c] for c in (columns or TABLES[table])}
    raw = raw_csv(spark, path)
    return raw.select(
        *[
            (_typed(c, t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
            for c, t in wanted.items()
        ]
    )


def _field_count() -> Column:
    """Fields of a CSV line: separators outside quotes, plus one."""
    bare = F.regexp_replace("line", r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def split_rejects(spark: SparkSession, table: str, path: str, required: list[str], landed: str, header: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of a header CSV, parsed once and written aside under ``landed``.

    A line is rejected, with the first reason that holds, if it is blank, leaves a
    quote open, has too few or too many fields, or if a ``required`` value is
    blank or invalid. Rejects are (file, line, reason), the line as it stands in
    the file; good rows are typed. A value may not hold a line break here. Without
    ``header`` every file begins with the same header line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    if header is None:
        first = spark.read.text(path).first()
        header = [c.strip().strip('"') for c in first.value.split(",")] if first else []
        lines = lines.where(F.col("line") != F.lit(first.value if first else ""))
    present = {c: t for c, t in TABLES[table].items() if c in header}
    if missing := set(required) - set(present):
        raise ValueError(f"{path} has no column {sorted(missing)}")
    schema = ", ".join(f"`{c}` string" for c in header)
    parsed = F.from_csv("line", schema, {"quote": '"', "escape": '"'})
    rows = lines.withColumn("_v", parsed).select("file", "line", "_v.*")
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    reason = (
        F.when(F.trim("line") == "", "blank line")
        .when(quotes % 2 == 1, "open quote")
        .when(_field_count() < len(header), "too few fields")
        .when(_field_count() > len(header), "too many fields")
    )
    for c in required:
        reason = reason.when(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == "", f"blank {c}")
        reason = reason.when(_typed(c, present[c]).isNull(), f"invalid {c}")
    typed = [_typed(c, t).alias(c) for c, t in present.items()]
    judged = rows.select("file", "line", reason.alias("reason"), *typed)
    rejected = F.col("reason").isNotNull()
    # The text of good lines is not kept twice.
    kept = judged.withColumn("line", F.when(rejected, F.col("line"))).withColumn("rejected", rejected)
    kept.write.partitionBy("rejected").parquet(landed)
    stored = spark.read.schema(kept.schema).parquet(landed)
    return stored.where("NOT rejected").select(*present), stored.where("rejected").select("file", "line", "reason")


def read_notes(spark: SparkSession, path: str, admissions: DataFrame | None = None) -> DataFrame:
    """Multi-line note CSV as (hadm_id, text), kept to ``admissions`` when given.

    A multi-line CSV file cannot be split between tasks: ``landing.land_notes``
    parses each file once, and ``landing.landed_notes`` reads the result.
    """
    notes = raw_csv(spark, path, multiline=True).select(
        F.trim("hadm_id").try_cast("bigint").alias("hadm_id"), "text"
    )
    return notes if admissions is None else notes.join(admissions.select("hadm_id"), "hadm_id", "left_semi")


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_ids(spark: SparkSession, path: str, name: str = "subject_id") -> DataFrame:
    """One id per line; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    return lines.where("v <> ''").select(F.col("v").cast("bigint").alias(name))


def read_thresholds(spark: SparkSession, path: str, main: dict[str, str], fallback: dict[str, str] | None = None) -> DataFrame:
    """(model, threshold) from a nested metrics JSON file.

    ``main`` and ``fallback`` give the dotted field of each model; the fallback
    serves models whose main field is absent or null.
    """
    text = spark.read.text(path, wholetext=True)
    fallback = fallback or {}

    def field(dotted: str | None) -> Column:
        if dotted is None:
            return F.lit(None).cast("double")
        return F.get_json_object("value", "$." + dotted).try_cast("double")

    rows = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.coalesce(field(f), field(fallback.get(m))).alias("threshold"))
            for m, f in main.items()
        ]
    )
    return text.select(F.explode(rows).alias("r")).select("r.*")
