"""Psychiatric control cohort and external-cohort comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import codes, demographics, text
from cohortlens.operators import cohort, sampling


def control_subjects(diagnoses: DataFrame, members: DataFrame) -> DataFrame:
    """Subjects with a control code, never target-coded, outside positives and proxies."""
    coded = cohort.coded_rows(diagnoses)
    candidates = cohort.keys_where(coded, codes.has_prefix(coded.icd_code, codes.CONTROL_PREFIXES), "subject_id")
    target = cohort.keys_where(coded, codes.is_target_code_any_version(coded.icd_code), "subject_id")
    taken = members.where(F.col("group").isin(cohort.POSITIVE, cohort.PROXY)).select("subject_id")
    return cohort.drop_members(candidates, taken.unionByName(target).distinct(), "subject_id")


def first_admission_pool(subjects: DataFrame, admissions: DataFrame, patients: DataFrame, floor: int | None = None) -> DataFrame:
    """First admission of each subject with age and matching strata (age not floored by default)."""
    rows = cohort.keep_members(admissions, subjects, "subject_id")
    first = cohort.first_rows(rows, "subject_id", "admittime", "hadm_id", ["hadm_id", "admittime"])
    aged = cohort.with_age(first, patients, floor)
    return aged.select(
        "subject_id", "hadm_id", "gender", "age_at_admission",
        demographics.age_bucket(F.col("age_at_admission")).alias("decade"),
    )


def matched_controls(extract: DataFrame, controls: DataFrame, ratio: int = 1) -> DataFrame:
    """Controls matched to the positives on age bucket and sex."""
    positives = cohort.index_rows(extract.where(F.col("group") == cohort.POSITIVE), ["gender", "age_at_admission"])
    cases = positives.withColumn("decade", demographics.age_bucket(F.col("age_at_admission")))
    return sampling.matched_sample(cases, controls, ratio)


def control_index(diagnoses: DataFrame, admissions: DataFrame, controls: DataFrame) -> DataFrame:
    """First control-coded admission of each control."""
    coded = cohort.keep_members(cohort.coded_rows(diagnoses), controls, "subject_id")
    rows = cohort.keys_where(coded, codes.has_prefix(F.col("icd_code"), codes.CONTROL_PREFIXES), "subject_id", "hadm_id")
    timed = rows.join(admissions.select("hadm_id", "admittime"), "hadm_id", "left")
    return cohort.first_rows(timed, "subject_id", "admittime", "hadm_id", ["hadm_id", "admittime"])


def hard_control_corpus(corpus: DataFrame, index: DataFrame, discharge: DataFrame) -> DataFrame:
    """subject_id, hadm_id, label, note_text and split of positives (1) and controls (0).

    Positives bring the notes of ``corpus``; a control brings the joined sections of
    its note at ``index`` (subject_id, hadm_id), if it has one. Subjects are split
    80/10/10 within their label.
    """
    columns = ["subject_id", "hadm_id", "label", "note_text"]
    noted = discharge.join(index, "hadm_id")
    noted = text.with_sections(noted, "text").withColumn("note_text", text.joined_sections(F.col("sections")))
    noted = noted.where("note_text IS NOT NULL").withColumn("label", F.lit(0))
    rows = corpus.where("label = 1").select(*columns).unionByName(noted.select(*columns))
    labels = rows.groupBy("subject_id").agg(F.min("label").alias("label"))
    return sampling.assign_rows(rows, sampling.stratified_split(labels), "subject_id")


def external_groups(corpus: DataFrame, proxies: DataFrame, n_unlabeled: int = 500, seed: int = 42) -> DataFrame:
    """Proxy notes (label 1) against one note each of sampled unlabeled subjects (label 0)."""
    pool = sampling.one_row_per_key(
        corpus.where(F.col("group") == cohort.UNLABELED), "subject_id", "hadm_id", ["hadm_id", "note_text"]
    )
    drawn = sampling.fixed_sample(pool, n_unlabeled, ["subject_id"], seed)
    columns = ["subject_id", "hadm_id", "note_text"]
    return proxies.select(*columns, F.lit(1).alias("label")).unionByName(drawn.select(*columns, F.lit(0).alias("label")))
