"""From raw notes to the masked training corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators.cohort import POSITIVE, PROXY


def allowed_admissions(extract: DataFrame) -> DataFrame:
    """Admissions whose notes may be used: index ones, and for positives earlier ones."""
    prior = (F.col("group") == POSITIVE) & (F.col("admittime") < F.col("index_admittime"))
    rows = extract.select("subject_id", "hadm_id", "group", "is_index_admission", prior.alias("is_prediagnosis"))
    return rows.where("is_prediagnosis OR is_index_admission").drop("is_index_admission")


def extract_notes(discharge: DataFrame, extract: DataFrame, order: Sequence[str] = tx.SECTION_ORDER) -> DataFrame:
    """Kept sections of every allowed note; notes without any are dropped.

    The join keeps only needed notes before any pattern runs.
    """
    notes = discharge.select("hadm_id", "text").join(allowed_admissions(extract), "hadm_id")
    parsed = tx.with_sections(notes, "text", order)
    return parsed.select(
        "subject_id", "hadm_id", "group", "is_prediagnosis",
        tx.joined_sections(F.col("sections")).alias("note_text"),
    ).where(F.col("note_text").isNotNull())


def resolve_fallback(notes: DataFrame) -> DataFrame:
    """Drop index notes of positives who also have earlier notes."""
    primary = notes.where((F.col("group") == POSITIVE) & F.col("is_prediagnosis")).select("subject_id").distinct()
    marked = notes.join(primary.withColumn("_primary", F.lit(True)), "subject_id", "left")
    redundant = (F.col("group") == POSITIVE) & ~F.col("is_prediagnosis") & F.coalesce("_primary", F.lit(False))
    return marked.where(~redundant).drop("_primary")


def notes_raw(discharge: DataFrame, extract: DataFrame) -> DataFrame:
    return resolve_fallback(extract_notes(discharge, extract))


def masked_notes(notes: DataFrame) -> DataFrame:
    """Mask the positive group and flag the masked rows."""
    positive = F.col("group") == POSITIVE
    return notes.withColumn(
        "note_text", F.when(positive, tx.mask(F.col("note_text"))).otherwise(F.col("note_text"))
    ).withColumn("is_masked", positive)


def corpus(notes: DataFrame) -> DataFrame:
    """Labelled training corpus: positives 1, unlabeled 0, proxies left out."""
    return masked_notes(notes).where(F.col("group") != PROXY).select(
        "subject_id", "hadm_id", "group",
        (F.col("group") == POSITIVE).cast("int").alias("label"),
        "note_text", "is_masked",
    )


def proxy_notes(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("group") == PROXY).select("subject_id", "hadm_id", "group", "note_text")


def leakage_audit(notes: DataFrame) -> DataFrame:
    """Before masking: earlier notes naming the target. After: notes with the token."""
    positive = F.col("group") == POSITIVE
    earlier = positive & F.col("is_prediagnosis")
    hit = tx.mentions(F.col("note_text"), tx.MASK_PATTERNS)
    with_token = F.contains(tx.mask(F.col("note_text")), F.lit(tx.MASK_TOKEN))
    counted = notes.agg(
        F.count(F.when(earlier, 1)).alias("n_prediagnosis"),
        F.count(F.when(earlier & hit, 1)).alias("n_prediagnosis_hit"),
        F.count(F.when(positive, 1)).alias("n_positive"),
        F.count(F.when(positive & with_token, 1)).alias("n_masked"),
    )
    return counted.select(
        "*",
        F.coalesce(F.try_divide("n_prediagnosis_hit", "n_prediagnosis"), F.lit(0.0)).alias("leakage_rate"),
        F.coalesce(F.try_divide("n_masked", "n_positive"), F.lit(0.0)).alias("masked_rate"),
    )


def without_section(discharge: DataFrame, base: DataFrame, order: Sequence[str] = tx.SECTION_ORDER_NO_PMH) -> DataFrame:
    """``base`` notes re-read without a section; the base text stays where that is blank."""
    wanted = discharge.select("hadm_id", "text").join(base.select("hadm_id").distinct(), "hadm_id", "left_semi")
    reread = tx.with_sections(wanted, "text", order).select(
        "hadm_id", tx.joined_sections(F.col("sections")).alias("_reduced")
    )
    return base.join(reread, "hadm_id", "left").withColumn(
        "note_text", tx.with_fallback(F.col("_reduced"), F.col("note_text"))
    ).drop("_reduced")


def changed_count(before: DataFrame, after: DataFrame, key: str = "hadm_id", text: str = "note_text") -> DataFrame:
    """How many texts differ between two versions of the same notes."""
    pair = before.select(key, F.col(text).alias("_a")).join(after.select(key, F.col(text).alias("_b")), key)
    return pair.agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("n_changed"),
    )
