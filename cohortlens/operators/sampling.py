"""Matched sampling and subject-level splits, ordered by a seeded hash.

The order md5(seed|key) does not depend on partitioning, so every sample and
split is reproducible on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import demographics
from cohortlens.operators.prefix import hash_key, hash_ranks, join_parameters

STRATA = ["decade", "gender"]


def _complete(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Subjects with a missing stratum value are never matched."""
    return df.dropna(subset=list(strata))


def stratum_demand(cases: DataFrame, strata: Sequence[str], ratio: int) -> DataFrame:
    counts = _complete(cases, strata).groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(*strata, (F.col("_n") * ratio).alias("needed"))


def matched_sample(
    cases: DataFrame, pool: DataFrame, ratio: int = 3,
    strata: Sequence[str] = STRATA, key: str = "subject_id", seed: int = 42,
) -> DataFrame:
    """Up to ``ratio`` pool rows per case and stratum, without replacement.

    A stratum with too few candidates gives all it has. ``key`` is unique in
    ``pool``.
    """
    demand = stratum_demand(cases, strata, ratio)
    ranked = hash_ranks(_complete(pool, strata), strata, [key], seed)
    return join_parameters(ranked, demand, strata).where("hash_rank <= needed").select(*pool.columns)


def match_shortfall(cases: DataFrame, pool: DataFrame, ratio: int = 3, strata: Sequence[str] = STRATA) -> DataFrame:
    """Needed, available, taken and missing rows per stratum."""
    supply = _complete(pool, strata).groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    joined = stratum_demand(cases, strata, ratio).join(supply, list(strata), "left").fillna(0, ["available"])
    taken = F.least("needed", "available")
    return joined.select(*strata, "needed", "available", taken.alias("taken"), (F.col("needed") - taken).alias("shortfall"))


def key_labels(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """First label per key (smallest ``order``)."""
    return rows.groupBy(key).agg(F.min_by(label, order).alias(label))


def _cut(shares: dict[str, float]) -> Column:
    """Split name from the exact rank within a stratum; the last split takes the rest."""
    names = list(shares)
    out = F.lit(names[-1])
    bound = sum(shares[n] for n in names[:-1])
    for name in reversed(names[:-1]):
        limit = F.floor(F.col("stratum_size") * F.lit(round(bound, 9)) + F.lit(1e-9))
        out = F.when(F.col("hash_rank") <= limit, name).otherwise(out)
        bound -= shares[name]
    return out


def stratified_split(
    labels: DataFrame, key: str = "subject_id", label: str = "label",
    shares: dict[str, float] | None = None, seed: int = 42,
) -> DataFrame:
    """Assign each key to a split within its label stratum (80/10/10 by default)."""
    shares = shares or {"train": 0.8, "val": 0.1, "test": 0.1}
    ranked = hash_ranks(labels.select(key, label), [label], [key], seed)
    return ranked.select(key, label, _cut(shares).alias("split"))


def temporal_split(
    labels: DataFrame, patients: DataFrame, cutoff: int = 2015,
    key: str = "subject_id", label: str = "label", seed: int = 42,
) -> DataFrame:
    """Keys whose era starts before ``cutoff`` go 90/10 to train/val, all others to test.

    A missing era counts as after the cutoff.
    """
    start = F.coalesce(demographics.era_start(F.col("anchor_year_group")), F.lit(9999))
    dated = labels.select(key, label).join(patients.select(key, start.alias("_start")), key, "left")
    dated = dated.withColumn("_start", F.coalesce("_start", F.lit(9999)))
    early = stratified_split(dated.where(F.col("_start") < cutoff), key, label, {"train": 0.9, "val": 0.1}, seed)
    late = dated.where(F.col("_start") >= cutoff).select(key, label, F.lit("test").alias("split"))
    return early.unionByName(late)


def assign_rows(rows: DataFrame, splits: DataFrame, key: str = "subject_id") -> DataFrame:
    """Bring the split of each key to its rows."""
    return rows.join(splits.select(key, "split"), key)


def split_checks(splits: DataFrame, labels: DataFrame, names: Sequence[str], key: str = "subject_id") -> DataFrame:
    """Violations per check: keys in several splits, keys without a split, empty splits."""

    def row(df: DataFrame, name: str, bad: Column) -> DataFrame:
        count = F.coalesce(F.sum(bad.cast("long")), F.lit(0).cast("long"))
        return df.agg(count.alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    per_key = splits.groupBy(key).agg(F.count_distinct("split").alias("n"))
    missing = labels.select(key).distinct().join(splits.select(key), key, "left_anti")
    sizes = splits.agg(*[F.count(F.when(F.col("split") == n, 1)).alias(n) for n in names])
    return (
        row(per_key, "overlapping_keys", F.col("n") > 1)
        .unionByName(row(missing, "missing_keys", F.lit(True)))
        .unionByName(row(sizes.unpivot([], list(names), "split", "size"), "empty_splits", F.col("size") == 0))
    )


def require_valid_split(splits: DataFrame, labels: DataFrame, names: Sequence[str], key: str = "subject_id") -> None:
    """Raise unless the splits are disjoint, complete and non-empty (runs a job)."""
    bad = split_checks(splits, labels, names, key).where("violations > 0").take(3)
    if bad:
        raise ValueError("invalid split: " + ", ".join(f"{r.check_name}={r.violations}" for r in bad))


def split_summary(rows: DataFrame, key: str = "subject_id", label: str = "label") -> DataFrame:
    """Patients, rows, positives, negatives and positive share per split."""
    per_key = rows.groupBy("split", key).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("p")
    )
    return per_key.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.sum("n").alias("n_rows"),
        F.sum("p").alias("n_pos"),
        (F.sum("n") - F.sum("p")).alias("n_neg"),
        (F.sum("p") / F.sum("n") * 100).alias("pos_pct"),
    )


def fixed_sample(rows: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows in hash order: a sampling operator, so the limit is the feature."""
    return rows.withColumn("_h", hash_key(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def sample_per_group(rows: DataFrame, groups: Sequence[str], n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group in hash order; no group is sorted in one task."""
    ranked = hash_ranks(rows, groups, key, seed)
    return ranked.where(F.col("hash_rank") <= n).drop("hash_rank", "stratum_size")


def one_row_per_key(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key, without a window."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in columns])
