"""Quality rules, line dedup, near-duplicate removal, source mixing and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, ready, row_key
from cohortlens.llm.curriculum import mixed_documents
from cohortlens.llm.hyperminhash import near_duplicates
from cohortlens.llm.line_runs import deduplicate_lines
from cohortlens.llm.outliers import judge
from cohortlens.llm.queries import packed_pieces

#: The stages are iterative or tokenize, which SQL cannot express; tests compare them with plain Python.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the robust rules keep; each row is judged by itself, whatever its doc_id.

    Rows with a null, empty or short text go. Repeated rows share their verdict,
    and null languages and sources are a group of their own. All columns stay,
    whatever their names. An empty table stays empty.
    """
    ready(spark)
    a, b = row_key(docs, ["text", "lang", "source"])
    # The statistics carry a hash of what is judged instead of the text; the rejected rows then leave by it.
    judged = judge(docs.select("doc_id", "text", "lang", "source", a.alias("_a"), b.alias("_b")), carried=("_a", "_b"))
    rejected = judged.where("NOT kept").select("_a", "_b").distinct()
    rows = docs.select(F.struct("*").alias("_row"), a.alias("_a"), b.alias("_b"))
    return rows.join(rejected, ["_a", "_b"], "left_anti").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that an earlier one has; n_chars follows the text.

    A null text stays null. Rows that share a doc_id are one document, and a null
    doc_id comes last. All columns stay, whatever their names. An empty table
    stays empty.
    """
    ready(spark)
    out = deduplicate_lines(docs)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    own = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: one with the smallest doc_id; rows without doc_id come last.

    Rows are linked by their texts, whatever their doc_id. Rows without a
    shingle (null and blank texts) are alike only if they share a doc_id. All
    columns stay, whatever their names. An empty table stays empty.
    """
    ready(spark)
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "rows")
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")))
    found = found.select(F.col("doc_id").alias("id"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    named = materialise(found.join(rows.select("id", F.col("row.doc_id").alias("doc_id")), "id"), "named")
    blank = F.col("blank") & F.col("doc_id").isNotNull()
    group = F.struct(blank.alias("blank"), F.when(blank, F.col("doc_id").cast("long")).otherwise(F.col("component_id")).alias("name"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))
    kept = named.groupBy(group.alias("group")).agg(first.alias("first")).select("first.id")
    # What goes is the smaller list; where it is short, no text is shuffled.
    gone = named.select("id").join(kept, "id", "left_anti")
    return rows.join(gone, "id", "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order.

    A null source is a source of its own. Documents without a word are never
    taken. Repeated rows count each. All columns stay, whatever their names. An
    empty table stays empty.
    """
    ready(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence.

    A null or empty text has its end id alone. Repeated rows and rows without a
    doc_id are documents of their own. Other columns than doc_id and text are not
    read. An empty table gives no pieces.
    """
    ready(spark)
    return packed_pieces(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input.

    Nulls, repeated rows, empty tables and further columns: as the stages say.
    """
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
