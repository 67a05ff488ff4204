"""Cohort joins, samples and splits, including a subject that holds most rows."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import cohort, sampling

DAY = dt.timedelta(days=1)
START = dt.datetime(2000, 1, 1)


def _near(spark, rows):
    df = spark.createDataFrame(rows, "subject_id long, kind string, t timestamp")
    a, b = F.col("kind") == "a", F.col("kind") == "b"
    fast = cohort.events_within(df, a, b, "subject_id", "t")
    slow = cohort.events_within_pairs(df.where(a), df.where(b), "subject_id", "t")
    return sorted(r[0] for r in fast.collect()), sorted(r[0] for r in slow.collect())


def test_band_edges(spark):
    rows = []
    for i, gap in enumerate([180 * DAY, 180 * DAY + dt.timedelta(microseconds=1), -180 * DAY, 361 * DAY, 0 * DAY]):
        rows += [(i, "a", START + i * 37 * DAY), (i, "b", START + i * 37 * DAY + gap)]
    fast, slow = _near(spark, rows + [(9, "a", START), (8, "b", None)])
    assert fast == slow == [0, 2, 4]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_band_join_equals_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 30), rng.choice("ab"), START + rng.randint(0, 4000) * DAY / 2) for _ in range(90)]
    fast, slow = _near(spark, rows)
    assert fast == slow


def test_hot_subject_in_the_band_join(spark):
    hot = spark.range(60_000).select(
        F.lit(1).cast("long").alias("subject_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
        F.timestamp_seconds(F.col("id") * 3600).alias("t"),
    )
    found = cohort.events_within(hot, F.col("kind") == "a", F.col("kind") == "b", "subject_id", "t")
    assert [r[0] for r in found.collect()] == [1]


def test_first_rows_break_ties_and_put_missing_times_last(spark):
    rows = [(1, 12, START), (1, 11, START), (1, 10, START + DAY), (2, 5, None), (2, 6, START), (3, 7, None)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, admittime timestamp")
    got = {r.subject_id: r.hadm_id for r in cohort.first_rows(df, "subject_id", "admittime", "hadm_id", ["hadm_id"]).collect()}
    assert got == {1: 11, 2: 6, 3: 7}


def test_index_admissions_can_tie(spark):
    adm = spark.createDataFrame([(1, 10, START), (1, 11, START), (1, 12, START + DAY), (2, 20, START), (2, 21, START + DAY)], "subject_id long, hadm_id long, admittime timestamp")
    people = spark.createDataFrame([(1, "F", 30, 1998), (2, "M", 40, 1998)], "subject_id long, gender string, anchor_age int, anchor_year int")
    coded = spark.createDataFrame([(2, 21)], "subject_id long, hadm_id long")
    members = spark.createDataFrame([(1, "unlabeled"), (2, "ptsd_pos")], "subject_id long, group string")
    out = cohort.admission_extract(adm, people, coded, members)
    assert sorted(r.hadm_id for r in out.where("is_index_admission").collect()) == [10, 11, 21]
    assert sorted(r.hadm_id for r in cohort.index_rows(out, ["hadm_id"]).collect()) == [10, 21]
    prior = cohort.prior_rows(out.drop("index_admittime"), cohort.index_rows(out, ["index_admittime"]))
    assert [r.hadm_id for r in prior.collect()] == [20]


def test_group_precedence(spark):
    def ids(*x):
        return spark.createDataFrame([(i,) for i in x], "subject_id long")

    got = {r.subject_id: r.group for r in cohort.group_members(ids(1, 2), ids(2), ids(1, 2, 3)).collect()}
    assert got == {1: "ptsd_pos", 2: "proxy", 3: "unlabeled"}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(1003).select(F.col("id").alias("subject_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))


def test_split_is_stratified_disjoint_and_partition_free(labels):
    one = sorted(tuple(r) for r in sampling.stratified_split(labels.repartition(3)).collect())
    two = sorted(tuple(r) for r in sampling.stratified_split(labels.repartition(11)).collect())
    assert one == two and len(one) == 1003
    for label, n in ((1, 144), (0, 859)):
        sizes = [sum(1 for r in one if r[1] == label and r[2] == s) for s in ("train", "val", "test")]
        assert sizes[0] == int(n * 0.8) and sum(sizes) == n and abs(sizes[1] - sizes[2]) <= 1


def test_split_checks_find_faults(spark, labels):
    good = sampling.stratified_split(labels)
    sampling.require_valid_split(good, labels, ["train", "val", "test"])
    twice = good.unionByName(spark.createDataFrame([(0, 1, "extra")], good.schema))
    with pytest.raises(ValueError, match="overlapping_keys=1"):
        sampling.require_valid_split(twice, labels, ["train", "val", "test"])
    with pytest.raises(ValueError, match="missing_keys"):
        sampling.require_valid_split(good.where("split <> 'val'"), labels, ["train", "val", "test"])


def test_temporal_split_sends_unknown_eras_to_test(spark, labels):
    eras = ["2008 - 2010", "2014 - 2016", "2017 - 2019", None]
    people = spark.createDataFrame([(i, eras[i % 4]) for i in range(1000)], "subject_id long, anchor_year_group string")
    out = {r.subject_id: r.split for r in sampling.temporal_split(labels, people).collect()}
    assert len(out) == 1003
    assert all(out[i] == "test" for i in range(1003) if i >= 1000 or i % 4 in (2, 3))
    assert {out[i] for i in range(1000) if i % 4 < 2} == {"train", "val"}


def test_matched_sample_takes_all_when_short_and_skips_missing_sex(spark):
    cases = spark.createDataFrame([(1, "20s", "F"), (2, "20s", "F"), (3, "30s", "M"), (4, "30s", None)], "subject_id long, decade string, gender string")
    pool = spark.createDataFrame([(100 + i, "20s", "F") for i in range(20)] + [(200, "30s", "M"), (300, "30s", None)], "subject_id long, decade string, gender string")
    got = [r.subject_id for r in sampling.matched_sample(cases, pool, 3).collect()]
    assert sum(100 <= s < 200 for s in got) == 6 and 200 in got and 300 not in got
    short = {(r.decade, r.gender): r.shortfall for r in sampling.match_shortfall(cases, pool, 3).collect()}
    assert short == {("20s", "F"): 0, ("30s", "M"): 2}
