"""The 20-column structured feature table and its imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import demographics
from cohortlens.operators.cohort import FLAG_COLUMNS, first_rows, prior_flags
from cohortlens.operators.prefix import percentiles

# Feature names in model order.
FEATURES = [
    "age_at_admission", "sex_female", "los_days", "emergency_admission", "medicaid_selfpay",
    "n_prior_admissions",
    "race_Asian", "race_Black", "race_Hispanic", "race_Other/Unknown", "race_White",
    "dx_MDD", "dx_anxiety", "dx_SUD", "dx_TBI", "dx_pain", "dx_suicidal",
    "rx_ssri_snri", "rx_prazosin", "rx_SGA",
]
PROPENSITY_FEATURES = [
    "sex_female", "age", "emergency_admission", "medicaid_selfpay", "n_prior_admissions",
    *FLAG_COLUMNS, "prior_psych_any",
]
DEFAULT_AGE = 40.0


def structured_features(
    evaluated: DataFrame, extract: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame
) -> DataFrame:
    """One row per subject: label, the feature columns and ``prior_psych_any``.

    The index is the subject's earliest admission among the ``evaluated`` rows
    (subject_id, hadm_id, label); history is everything strictly before it.
    Training and scoring use this same plan.
    """
    used = extract.join(evaluated.select("hadm_id").distinct(), "hadm_id", "left_semi")
    columns = ["hadm_id", "admittime", "dischtime", "gender", "race", "age_at_admission", "admission_type", "insurance"]
    index = first_rows(used, "subject_id", "admittime", "hadm_id", columns)
    history = prior_flags(
        extract, index.withColumnRenamed("admittime", "index_admittime"), diagnoses, prescriptions
    )
    labels = evaluated.groupBy("subject_id").agg(F.min_by("label", "hadm_id").alias("label"))
    race = demographics.race_category(F.col("race"))
    demo = index.select(
        "subject_id",
        F.col("age_at_admission").cast("double").alias("age_at_admission"),
        (F.coalesce("gender", F.lit("")) == "F").cast("int").alias("sex_female"),
        demographics.days_between(F.col("admittime"), F.col("dischtime")).alias("los_days"),
        demographics.is_emergency(F.col("admission_type")).cast("int").alias("emergency_admission"),
        demographics.has_payer(F.col("insurance"), demographics.PAYERS_FEATURES).cast("int").alias("medicaid_selfpay"),
        *demographics.one_hot(race, list(demographics.RACE_LABELS_SHORT.values()), "race_"),
    )
    joined = labels.join(demo, "subject_id").join(history, "subject_id")
    return joined.select("subject_id", "label", *[f"`{f}`" for f in FEATURES], "prior_psych_any")


def medians(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column, as (feature, median)."""
    long = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        [], [f"`{c}`" for c in columns], "feature", "value"
    )
    return percentiles(long, ["feature"], "value", {"median": 0.5})


def impute(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the medians of ``train`` (a map of one entry per column)."""
    entries = F.map_from_entries(F.collect_list(F.struct("feature", "median")))
    table = medians(train, columns).agg(entries.alias("m")).select("m").scalar()
    filled = rows.withColumn("_m", table)
    for c in columns:
        value = F.col(f"`{c}`").cast("double")
        filled = filled.withColumn(c, F.coalesce(F.nanvl(value, F.lit(None)), F.col("_m")[c], F.lit(0.0)))
    return filled.drop("_m")


def propensity_inputs(features: DataFrame, extract: DataFrame) -> DataFrame:
    """Propensity columns per subject: demographics of the first admission, history of the features.

    Ties on the time take the smallest hadm_id. A missing age falls back to a
    constant, all other gaps to 0.
    """
    columns = ["gender", "age_at_admission", "admission_type", "insurance"]
    first = first_rows(extract, "subject_id", "admittime", "hadm_id", columns).select(
        "subject_id",
        (F.coalesce("gender", F.lit("")) == "F").cast("int").alias("sex_female"),
        F.coalesce(F.col("age_at_admission").cast("double"), F.lit(DEFAULT_AGE)).alias("age"),
        demographics.is_emergency(F.col("admission_type")).cast("int").alias("emergency_admission"),
        demographics.has_payer(F.col("insurance"), demographics.PAYERS_FEATURES).cast("int").alias("medicaid_selfpay"),
    )
    history = features.select("subject_id", "label", "n_prior_admissions", *FLAG_COLUMNS, "prior_psych_any")
    joined = history.join(first, "subject_id", "left").withColumn("age", F.coalesce("age", F.lit(DEFAULT_AGE)))
    return joined.fillna(0, [c for c in PROPENSITY_FEATURES if c != "age"])


def standardise(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and deviation 1 over ``train``; a constant column becomes 0."""
    cells = [f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    r = train.agg(*cells).first()  # two numbers per column
    scaled = {
        c: (F.col(f"`{c}`").cast("double") - float(r[f"m{i}"] or 0.0)) / float(r[f"d{i}"]) if r[f"d{i}"] else F.lit(0.0)
        for i, c in enumerate(columns)
    }
    return rows.withColumns(scaled)
