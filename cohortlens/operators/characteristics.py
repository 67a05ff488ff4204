"""Group characteristics: counts, shares, means and exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import demographics
from cohortlens.operators.cohort import FLAG_COLUMNS
from cohortlens.operators.prefix import percentiles

QUARTILES = {"Q1": 0.25, "median": 0.5, "Q3": 0.75}


def count_items() -> dict[str, Column]:
    """0/1 column of every counted item of the table, in table order."""
    race = demographics.race_category(F.col("race"), demographics.RACE_LABELS_LONG)
    bucket = demographics.age_bucket(F.col("age_at_admission"))
    gender = F.coalesce(F.col("gender"), F.lit(""))
    items: dict[str, Column] = {
        "Female": gender == "F",
        "Male": gender == "M",
        "OtherSex": ~gender.isin("F", "M"),
    }
    for name in demographics.AGE_BUCKETS:
        items[f"Age_{name}"] = bucket == name
    for name in demographics.RACE_LABELS_LONG.values():
        key = name.replace("/", "_").replace(" ", "_").replace("-", "_")
        items[f"Race_{key}"] = race == name
    items["Single_admit"] = F.col("total_admissions") == 1
    items["Multi_admit"] = F.col("total_admissions") > 1
    items["Emergency"] = demographics.is_emergency(F.col("admission_type"))
    items["MedicaidSelfPay"] = demographics.has_payer(F.col("insurance"), demographics.PAYERS_TABLE)
    for flag in FLAG_COLUMNS:
        kind, rest = flag.split("_", 1)
        items[f"{kind.capitalize()}_{rest}"] = F.col(flag) == 1
    return {k: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in items.items()}


def group_characteristics(index_rows: DataFrame) -> DataFrame:
    """Long table (group, item, value) over one index row per subject.

    ``index_rows`` carries group, demographics, total_admissions, los_days and
    the prior flags. Counts and moments come from one aggregate; the quartiles
    of all measures share one value histogram.
    """
    items = count_items()
    n = F.count(F.lit(1))
    wide = index_rows.groupBy("group").agg(
        n.cast("double").alias("N"),
        *[F.sum(c).cast("double").alias(f"{k}_n") for k, c in items.items()],
        *[(F.sum(c) / n * 100).alias(f"{k}_pct") for k, c in items.items()],
        F.avg("age_at_admission").alias("Age_mean"),
        F.stddev_samp("age_at_admission").alias("Age_sd"),
    )
    measured = [c for c in wide.columns if c != "group"]
    long = wide.unpivot(["group"], measured, "item", "value")
    measures = index_rows.select(
        "group",
        F.col("total_admissions").cast("double").alias("Admissions"),
        F.col("los_days").alias("LOS"),
    ).unpivot(["group"], ["Admissions", "LOS"], "measure", "value")
    quartiles = percentiles(measures, ["group", "measure"], "value", QUARTILES)
    quartiles = quartiles.unpivot(["group", "measure"], list(QUARTILES), "level", "value")
    quartiles = quartiles.select("group", F.concat_ws("_", "measure", "level").alias("item"), "value")
    return long.unionByName(quartiles)


def transposed(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per item, one column per declared group."""
    return table.groupBy(F.col("item").alias("characteristic")).pivot("group", list(groups)).agg(F.max("value"))


def length_distribution(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Character-length statistics of a text column per group."""
    lengths = rows.select(group, F.length(text).cast("double").alias("_len")).where(F.col("_len").isNotNull())
    basic = lengths.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_len").alias("mean"),
        F.min("_len").alias("min"),
        F.max("_len").alias("max"),
        (F.avg("_len") / 4).alias("mean_tokens"),
    )
    return basic.join(percentiles(lengths, [group], "_len", QUARTILES), group)


def predx_share(extract: DataFrame) -> DataFrame:
    """Positives with an admission before their index: number and share."""
    per_subject = extract.where("`group` = 'ptsd_pos'").groupBy("subject_id").agg(
        F.max((F.col("admittime") < F.col("index_admittime")).cast("int")).alias("has_prior")
    )
    return per_subject.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("has_prior"), F.lit(0)).alias("n_predx"),
        F.avg("has_prior").alias("predx_share"),
    )
