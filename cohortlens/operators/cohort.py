"""Cohort ids, time-band joins, index events and the admission extract.

Row-level windows over a subject are avoided throughout: per-subject facts
come from map-side combined aggregates that are joined back, so a subject
with a very large history is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import codes, demographics
from cohortlens.session import materialise

# Group labels.
POSITIVE, PROXY, UNLABELED = "ptsd_pos", "proxy", "unlabeled"

BAND_DAYS = 180
_MICROS_PER_DAY = 86_400_000_000


# ── keys and sets ───────────────────────────────────────────────────────────


def keys_where(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Distinct ``keys`` of the rows that satisfy ``condition``."""
    return df.where(condition).select(*keys).distinct()


def keep_members(df: DataFrame, cohort: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are in ``cohort`` (semi join)."""
    return df.join(cohort.select(*keys), list(keys), "left_semi")


def drop_members(df: DataFrame, cohort: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not in ``cohort`` (anti join)."""
    return df.join(cohort.select(*keys), list(keys), "left_anti")


def coded_rows(diagnoses: DataFrame) -> DataFrame:
    """Diagnoses with a normalised ``icd_code``."""
    return diagnoses.withColumn("icd_code", codes.normalise_code(F.col("icd_code")))


def target_subjects(diagnoses: DataFrame) -> DataFrame:
    """Subjects with the target diagnosis under the version-aware rule."""
    coded = coded_rows(diagnoses)
    return keys_where(coded, codes.is_target_code(coded.icd_code, coded.icd_version), "subject_id")


def target_admissions(diagnoses: DataFrame) -> DataFrame:
    coded = coded_rows(diagnoses)
    rule = codes.is_target_code(coded.icd_code, coded.icd_version)
    return keys_where(coded, rule, "subject_id", "hadm_id")


# ── band join ───────────────────────────────────────────────────────────────


def events_within(events: DataFrame, is_a: Column, is_b: Column, key: str, time: str, days: int = BAND_DAYS) -> DataFrame:
    """Keys with an event of kind ``a`` and one of kind ``b`` at most ``days`` apart.

    One scan and no pair of events. Time is cut into buckets one band wide:
    two events in one bucket always match, events two buckets apart never do,
    and for neighbouring buckets the latest event of the earlier one against
    the earliest of the later one decides. So four extremes per (key, bucket)
    carry the exact answer, and they are combined on the map side.
    """
    width = days * _MICROS_PER_DAY
    kinds = events.where(F.col(time).isNotNull()).select(
        key,
        F.unix_micros(F.col(time).cast("timestamp")).alias("t"),
        is_a.alias("a"),
        is_b.alias("b"),
    )

    def extreme(fn, kind: str) -> Column:
        return fn(F.when(F.col(kind), F.col("t"))).alias(f"{fn.__name__}_{kind}")

    buckets = (
        kinds.where("a OR b")
        .groupBy(key, F.floor(F.col("t") / width).alias("bucket"))
        .agg(extreme(F.min, "a"), extreme(F.max, "a"), extreme(F.min, "b"), extreme(F.max, "b"))
    )
    # One row per band-wide bucket: the window below is bounded by the time span.
    by_time = W.partitionBy(key).orderBy("bucket")
    adjacent = F.lag("bucket").over(by_time) == F.col("bucket") - 1
    close_ab = F.col("min_b") - F.lag("max_a").over(by_time) <= width
    close_ba = F.col("min_a") - F.lag("max_b").over(by_time) <= width
    same = F.col("min_a").isNotNull() & F.col("min_b").isNotNull()
    near = adjacent & (F.coalesce(close_ab, F.lit(False)) | F.coalesce(close_ba, F.lit(False)))
    hits = buckets.select(key, (same | F.coalesce(near, F.lit(False))).alias("hit"))
    return hits.where("hit").select(key).distinct()


def events_within_pairs(a: DataFrame, b: DataFrame, key: str, time: str, days: int = BAND_DAYS) -> DataFrame:
    """The same keys by a plain join of all event pairs: a check for small data."""
    left = a.select(key, F.col(time).alias("t_a"))
    right = b.select(key, F.col(time).alias("t_b"))
    gap = F.abs(demographics.days_between(F.col("t_a"), F.col("t_b")))
    return left.join(right, key).where(gap <= days).select(key).distinct()


def proxy_candidates(prescriptions: DataFrame, days: int = BAND_DAYS) -> DataFrame:
    """Subjects with prazosin and an SSRI/SNRI started within ``days``."""
    drug = F.col("drug")
    return events_within(
        prescriptions.where(codes.not_blank(drug)),
        codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_prazosin"]),
        codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_ssri_snri"]),
        "subject_id",
        "starttime",
        days,
    )


def proxy_subjects(diagnoses: DataFrame, prescriptions: DataFrame, days: int = BAND_DAYS) -> DataFrame:
    """Candidates that are neither target-coded nor carry an exclusion code."""
    coded = coded_rows(diagnoses)
    barred = codes.is_target_code(coded.icd_code, coded.icd_version) | codes.has_prefix(
        coded.icd_code, codes.EXCLUSION_PREFIXES
    )
    excluded = keys_where(coded, barred, "subject_id")
    return drop_members(proxy_candidates(prescriptions, days), excluded, "subject_id")


def subject_pool(
    admissions: DataFrame, patients: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame,
    days: int = BAND_DAYS,
) -> DataFrame:
    """One row per admitted subject: first admission, strata, positive and proxy flags.

    Each event table is scanned once and reduced to subjects before any join.
    """
    first = first_rows(admissions, "subject_id", "admittime", "hadm_id", ["hadm_id", "admittime"])
    coded = coded_rows(diagnoses)
    code = F.col("icd_code")
    target = codes.is_target_code(code, F.col("icd_version"))
    flags = coded.where(target | codes.has_prefix(code, codes.EXCLUSION_PREFIXES)).groupBy("subject_id").agg(
        F.max(target).alias("_target")
    )
    near = proxy_candidates(prescriptions, days).withColumn("_near", F.lit(True))
    joined = with_age(first, patients).join(flags, "subject_id", "left").join(near, "subject_id", "left")
    positive = F.coalesce("_target", F.lit(False))
    return joined.select(
        "subject_id", "gender", "age_at_admission",
        demographics.age_bucket(F.col("age_at_admission")).alias("decade"),
        positive.alias("is_positive"),
        # A row in ``flags`` means the target or an exclusion code.
        (F.col("_near").isNotNull() & F.col("_target").isNull()).alias("is_proxy"),
    )


# ── first events and index times ────────────────────────────────────────────


def first_time(df: DataFrame, key: str, time: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(time).alias(out))


def first_rows(df: DataFrame, key: str, time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Per key the row with the smallest (time, tie); missing times come last.

    One aggregate with a map-side combine instead of a ranked window.
    """
    place = F.struct(F.col(time).isNull(), F.col(time), F.col(tie))
    best = F.min_by(F.struct(*columns), place).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def admission_counts(admissions: DataFrame) -> DataFrame:
    """Distinct admissions per subject, as two combined aggregates."""
    pairs = admissions.select("subject_id", "hadm_id").where("hadm_id IS NOT NULL").distinct()
    return pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_admissions"))


def with_age(admissions: DataFrame, patients: DataFrame, floor: int | None = 18) -> DataFrame:
    """Left demographic lookup plus ``admit_year`` and ``age_at_admission``."""
    people = patients.select("subject_id", "gender", "anchor_age", "anchor_year")
    return (
        admissions.join(people, "subject_id", "left")
        .withColumn("admit_year", F.year("admittime"))
        .withColumn(
            "age_at_admission",
            demographics.age_at(F.col("anchor_age"), F.col("anchor_year"), F.col("admittime"), floor),
        )
    )


def group_members(positives: DataFrame, proxies: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """One row per subject with its label; proxy wins over positive over unlabeled."""
    ranked = [(unlabeled, 0), (positives, 1), (proxies, 2)]
    rows = [df.select("subject_id", F.lit(rank).alias("_rank")) for df, rank in ranked]
    merged = rows[0].unionByName(rows[1]).unionByName(rows[2])
    rank = F.max("_rank")
    label = F.when(rank == 2, PROXY).when(rank == 1, POSITIVE).otherwise(UNLABELED)
    return merged.groupBy("subject_id").agg(label.alias("group"))


def index_times(extract: DataFrame, coded_admissions: DataFrame) -> DataFrame:
    """Index time per subject: first coded admission for positives, else the first.

    ``extract`` needs subject_id, hadm_id, admittime and group.
    """
    marked = extract.join(
        coded_admissions.select("subject_id", "hadm_id").withColumn("_coded", F.lit(True)),
        ["subject_id", "hadm_id"],
        "left",
    )
    usable = (F.col("group") != POSITIVE) | F.col("_coded")
    return marked.where(usable).groupBy("subject_id").agg(F.min("admittime").alias("index_admittime"))


def admission_extract(
    admissions: DataFrame,
    patients: DataFrame,
    coded_admissions: DataFrame,
    members: DataFrame,
) -> DataFrame:
    """Cohort admissions with group, age and index columns.

    Several admissions can tie for the index time; all of them are flagged.
    """
    rows = with_age(admissions.join(members, "subject_id"), patients)
    return rows.join(index_times(rows, coded_admissions), "subject_id", "left").withColumn(
        "is_index_admission", F.col("admittime") == F.col("index_admittime")
    )


def index_rows(extract: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One index admission per subject; the smallest hadm_id breaks ties."""
    return first_rows(extract.where("is_index_admission"), "subject_id", "admittime", "hadm_id", columns)


def prior_rows(rows: DataFrame, index: DataFrame, index_time: str = "index_admittime") -> DataFrame:
    """Rows strictly before their subject's index time.

    ``index`` has one row per subject, so the inequality adds no fan-out.
    """
    times = index.select("subject_id", F.col(index_time).alias("_index"))
    return rows.join(times, "subject_id").where(F.col("admittime") < F.col("_index")).drop("_index")


def events_of(events: DataFrame, admissions: DataFrame) -> DataFrame:
    """Events that belong to the given admissions (two-key semi join)."""
    return keep_members(events, admissions.select("subject_id", "hadm_id").distinct(), "subject_id", "hadm_id")


# ── per-subject flags ───────────────────────────────────────────────────────


def diagnosis_flags(diagnoses: DataFrame) -> DataFrame:
    """Six any-match 0/1 flags per subject from one scan."""
    code = F.col("icd_code")
    return (
        coded_rows(diagnoses)
        .groupBy("subject_id")
        .agg(
            *[
                F.max(codes.has_prefix(code, prefixes).cast("int")).alias(name)
                for name, prefixes in codes.COMORBIDITY_PREFIXES.items()
            ]
        )
    )


def drug_flags(prescriptions: DataFrame) -> DataFrame:
    """Three any-match 0/1 flags per subject from one scan."""
    drug = F.col("drug")
    return prescriptions.groupBy("subject_id").agg(
        *[
            F.max(codes.drug_matches(drug, substrings).cast("int")).alias(name)
            for name, substrings in codes.DRUG_SUBSTRINGS.items()
        ]
    )


FLAG_COLUMNS = [*codes.COMORBIDITY_PREFIXES, *codes.DRUG_SUBSTRINGS]


def any_flag(*flags: str) -> Column:
    """Composite 0/1 flag; missing flags count as 0."""
    return F.greatest(*[F.coalesce(F.col(f), F.lit(0)) for f in flags])


def prior_flags(
    admissions: DataFrame, index: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame,
    index_time: str = "index_admittime",
) -> DataFrame:
    """Per subject of ``index``: prior admission count, nine flags, composite flag."""
    prior = prior_rows(admissions, index, index_time).select("subject_id", "hadm_id")
    counts = prior.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_prior_admissions"))
    flags = (
        index.select("subject_id")
        .join(counts, "subject_id", "left")
        .join(diagnosis_flags(events_of(diagnoses, prior)), "subject_id", "left")
        .join(drug_flags(events_of(prescriptions, prior)), "subject_id", "left")
        .fillna(0, ["n_prior_admissions", *FLAG_COLUMNS])
    )
    return flags.withColumn("prior_psych_any", any_flag("dx_MDD", "dx_anxiety", "dx_suicidal"))


def flag_coverage(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number and share of rows with each flag set, as (flag, n, share)."""
    sums = flags.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.coalesce(F.sum((F.col(c) == 1).cast("long")), F.lit(0)).alias(c) for c in columns],
    )
    return sums.unpivot(["_rows"], list(columns), "flag", "n").select(
        "flag", "n", F.try_divide(F.col("n"), F.col("_rows")).alias("share")
    )


# ── reports on cohorts ──────────────────────────────────────────────────────


def group_summary(extract: DataFrame) -> DataFrame:
    """Patients, rows and index rows per group."""
    per_subject = extract.groupBy("group", "subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_index_admission").cast("int")).alias("i")
    )
    return per_subject.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.sum("n").alias("n_admissions"),
        F.sum("i").alias("n_index"),
    )


def reconcile_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Actual against expected counts (group, n) with an OK/MISMATCH status; a group that only one side has is a mismatch."""
    wanted = expected.select(F.col("group").alias("_g"), F.col("n").cast("long").alias("expected"))
    found = actual.select("group", F.col("n").cast("long").alias("actual"))
    joined = found.join(wanted, F.col("group").eqNullSafe(F.col("_g")), "full")
    same = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    return joined.select(F.coalesce("group", "_g").alias("group"), "actual", "expected", F.when(same, "OK").otherwise("MISMATCH").alias("status"))


def value_profile(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Sorted distinct values per column, at most N each where N is given; the rows are read once."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    distinct = df.select(cells.alias("c")).select("c.*").where("value IS NOT NULL").distinct()
    distinct = materialise(distinct, "values")
    out = None
    for name, limit in columns.items():
        part = distinct.where(F.col("column_name") == name)
        part = part if limit is None else part.orderBy("value").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out
