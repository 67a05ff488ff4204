"""Clinical-style tables derived from the given test tables.

Every stand-in covers its whole source table, so the work of a query grows
with the data. ``sql.py`` holds the same definitions for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators import spans
from cohortlens.session import spread

ERAS = ["2008 - 2010", "2011 - 2013", "2014 - 2016", "2017 - 2019"]
CODES = [" f43.1 ", "309.81", "F32.9", "296.20", "F41.1", "30500", "I10", "S06.0", "G89.4", "R45.851"]
ICD9_SLOTS = [1, 3, 5]
DRUGS = {10: "Prazosin HCl", 11: "Sertraline", 12: "VENLAFAXINE XR", 13: "Quetiapine", 15: "  "}
RACES = {
    "AUTOMOBILE": "WHITE",
    "BUILDING": "BLACK/AFRICAN AMERICAN",
    "FURNITURE": "HISPANIC/LATINO - PUERTO RICAN",
    "HOUSEHOLD": "ASIAN - CHINESE",
}
HEADERS = [
    "History of Present Illness:\n",
    "Brief Hospital Course: \n",
    "Past Medical History:\n",
    "Social History:\n",
    "Discharge Medications:\n",
    "",
    "Note that Plan: ",
]
PHRASES = [
    " Known PTSD since 2001.",
    " Post-Traumatic stress; nightmares and flashbacks.",
    " Code 309.81, trauma-related  stress.",
    " Denies trauma, on prazosin.",
]
STOPWORD_LEXICON = [
    (r"\bthe\b", 2.0, "A"),
    (r"\bthe\s+in\b", 3.0, "A"),
    (r"\band\b", 1.0, "B"),
    (r"\bof\b", 0.5, "C"),
    (r"\b(?:der|die|das)\b", 0.5, "D"),
    (r"\b(?:le|la)s?\b", 1.5, "E"),
]
MODELS = ["kw", "kw_norm", "len", "hash", "grid"]


# Declared schemas: reading needs no job to look at file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread out: their text is scanned by many patterns."""
    return spread(table(spark, sf_dir, "documents"))


def pick(index: Column, values: list[str]) -> Column:
    """The value at ``index``, null beyond the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def md5_uniform(*parts: Column | str) -> Column:
    """Uniform [0, 1) double from the first 32 bits of an md5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("subject_id"),
        F.when(key % 97 == 0, None).when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        (key % 70 + 15).cast("int").alias("anchor_age"),
        F.lit(1998).alias("anchor_year"),
        pick(F.col("c_nationkey") % 5, ERAS).alias("anchor_year_group"),
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    race = F.lit(None).cast("string")
    for name, value in RACES.items():
        race = F.when(segment == name, value).otherwise(race)
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), race.alias("race"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(people, "o_custkey", "left").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 240 as int))").alias("dischtime"),
        F.when(priority == "1-URGENT", "EW EMER.")
        .when(priority == "2-HIGH", "DIRECT EMER.")
        .when(priority == "3-MEDIUM", None)
        .otherwise("ELECTIVE")
        .alias("admission_type"),
        F.when(status == "F", "Medicaid").when(status == "O", "Self Pay").otherwise("Private").alias("insurance"),
        "race",
    )


def _line_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id")
    )
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("l_partkey") % 400
    return _line_owner(spark, sf_dir).select(
        "subject_id",
        F.col("l_orderkey").alias("hadm_id"),
        F.coalesce(pick(slot, CODES), F.lit("Z00.0")).alias("icd_code"),
        F.when(slot.isin(ICD9_SLOTS), "9").otherwise("10").alias("icd_version"),
    )


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("l_partkey") % 100
    drug = F.when(slot == 14, None).otherwise("Saline")
    for number, name in DRUGS.items():
        drug = F.when(slot == number, name).otherwise(drug)
    return _line_owner(spark, sf_dir).select(
        "subject_id",
        F.col("l_orderkey").alias("hadm_id"),
        drug.alias("drug"),
        F.when(F.col("l_orderkey") % 50 != 0, F.col("l_shipdate")).alias("starttime"),
    )


def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per document: header lines and clinical phrases are put between its lines."""
    doc = F.col("doc_id")
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            pick((doc + i) % len(HEADERS), HEADERS),
            line,
            F.coalesce(pick((doc * 3 + i) % 13, PHRASES), F.lit("")),
        ),
    )
    return documents(spark, sf_dir).select(doc.alias("hadm_id"), F.array_join(lines, "\n").alias("text"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as (subject_id, hadm_id, label, ...): the classifier rows."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("hadm_id"), "text", "lang", "n_chars")
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id")
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("hadm_id"), F.col("quality").alias("label"), "toxic"
    )
    return labels.join(docs, "hadm_id").join(owners, "hadm_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table of five stand-in models over the labelled documents."""
    docs = tx.with_lexicon_scores(labelled_docs(spark, sf_dir), "text", STOPWORD_LEXICON)
    uniform = md5_uniform("42", F.col("hadm_id"))
    values = {
        "kw": F.col("score_raw"),
        "kw_norm": F.col("score_norm"),
        "len": F.col("n_chars") / (F.col("n_chars") + 2000.0),
        "hash": F.col("_u"),
        "grid": F.floor(F.col("_u") * 20) / 20.0,
    }
    parts = F.array(*[F.struct(F.lit(m).alias("model"), values[m].cast("double").alias("score")) for m in MODELS])
    split = F.when(md5_uniform("7", F.col("subject_id")) < 0.5, "val").otherwise("test")
    return (
        docs.withColumn("_u", uniform)
        .select("subject_id", "hadm_id", "label", split.alias("split"), F.explode(parts).alias("m"))
        .select("m.model", "split", "subject_id", "hadm_id", "label", "m.score")
    )


def token_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every note with a stand-in attribution value: a row per note, an array per column.

    Pieces are at most five characters; offsets count characters of the note's
    joined sections. Notes are cut in their row.
    """
    notes = tx.with_sections(discharge(spark, sf_dir), "text").select(
        "hadm_id", tx.joined_sections(F.col("sections")).alias("note_text")
    ).where("note_text IS NOT NULL")
    texts = notes.groupBy("hadm_id").agg(F.collect_list("note_text").alias("texts"))  # of one key
    schema = "hadm_id bigint, tok_start array<bigint>, tok_end array<bigint>, token array<string>, value array<double>"
    return texts.mapInArrow(spans.cut("hadm_id", 5, "9"), schema)


def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_notes`` with a row per piece, dealt by their note: what follows per note moves no piece again."""
    notes = token_notes(spark, sf_dir).repartition("hadm_id")
    pieces = notes.select("hadm_id", "tok_start", "tok_end", "value", F.posexplode("token").alias("i", "piece"))

    def at(name: str) -> Column:
        return F.get(F.col(name), F.col("i")).alias(name)

    return pieces.select("hadm_id", at("tok_start"), at("tok_end"), F.col("piece").alias("token"), at("value"))
