"""Demographic and stay-level columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age buckets; every other age, and a missing age, is "Other".
AGE_BUCKETS = ["20s", "30s", "40s", "50s", "Other"]

# Two label vocabularies for the same ordered race mapping.
RACE_LABELS_LONG = {
    "white": "White/Non-Hispanic",
    "black": "Black/African American",
    "hispanic": "Hispanic/Latino",
    "asian": "Asian",
    "other": "Other/Unknown",
}
RACE_LABELS_SHORT = {
    "white": "White",
    "black": "Black",
    "hispanic": "Hispanic",
    "asian": "Asian",
    "other": "Other/Unknown",
}

# Payer lists; the table and the feature job differ on purpose.
PAYERS_TABLE = ["MEDICAID", "SELF PAY", "SELF-PAY"]
PAYERS_FEATURES = ["MEDICAID", "SELF PAY"]

MICROS_PER_DAY = 86_400_000_000.0


def age_at(anchor_age: Column, anchor_year: Column, when: Column, floor: int | None = 18) -> Column:
    """Age in the year of ``when``; a missing input gives a missing age.

    ``greatest`` skips nulls, so the floor is applied only to known ages.
    """
    age = anchor_age + (F.year(when) - anchor_year)
    if floor is None:
        return age
    return F.when(age.isNotNull(), F.greatest(F.lit(floor), age))


def age_bucket(age: Column) -> Column:
    """Decade label of an age truncated to whole years."""
    whole = age.cast("int")
    bucket = F.lit("Other")
    for start in (50, 40, 30, 20):
        bucket = F.when(whole.between(start, start + 9), f"{start}s").otherwise(bucket)
    return bucket


def race_category(race: Column, labels: dict[str, str] = RACE_LABELS_SHORT) -> Column:
    """First matching category wins; missing or unmatched text is "other"."""
    text = F.upper(race)
    return (
        F.when(text.contains("WHITE"), labels["white"])
        .when(text.contains("BLACK") | text.contains("AFRICAN"), labels["black"])
        .when(text.contains("HISPANIC") | text.contains("LATINO"), labels["hispanic"])
        .when(text.contains("ASIAN"), labels["asian"])
        .otherwise(labels["other"])
    )


def binary_race(category: Column) -> Column:
    return F.when(category == "White", "White").otherwise("Non-White")


def is_emergency(admission_type: Column) -> Column:
    return F.coalesce(F.upper(admission_type).contains("EMER"), F.lit(False))


def has_payer(insurance: Column, payers: Sequence[str]) -> Column:
    return F.coalesce(F.upper(insurance).isin(list(payers)), F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end`` (not truncated to whole days)."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("double") / F.lit(MICROS_PER_DAY)


def one_hot(category: Column, levels: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per declared level, so absent levels stay as zeros."""
    return [
        F.when(category == level, 1).otherwise(0).alias(f"{prefix}{level}")
        for level in sorted(levels)
    ]


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to a range; a missing value stays missing."""
    return F.when(
        value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    )


def era_start(year_group: Column) -> Column:
    """First year of an era such as ``"2008 - 2010"``; null when missing."""
    return F.split_part(year_group, F.lit(" - "), F.lit(1)).try_cast("int")
