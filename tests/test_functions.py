"""Codes, demographics and closed-form statistics on hand-written edges."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import codes, demographics, stats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_codes(spark):
    rows = [(" f43.1 ", "10"), ("F43.12", "10"), ("309.81", "9"), ("309.81", "10"), ("F43.1", "9"), (None, "10")]
    df = spark.createDataFrame(rows, "c string, v string").select(codes.normalise_code(F.col("c")).alias("c"), "v")
    hits = [bool(r.h) for r in df.select(codes.is_target_code(F.col("c"), F.col("v")).alias("h")).collect()]
    assert hits == [True, True, True, False, False, False]
    r = one(
        spark, mdd=codes.has_prefix(F.lit("2963"), ["F32", "296"]), tail=codes.has_prefix(F.lit("XF32"), ["F32"]),
        drug=codes.drug_matches(F.lit("VENLAFAXINE XR"), codes.DRUG_SUBSTRINGS["rx_ssri_snri"]),
        none=codes.drug_matches(F.lit(None).cast("string"), ["x"]), blank=codes.not_blank(F.lit("  ")),
    )
    assert (r.mdd, r.tail, r.drug, r.none, r.blank) == (True, False, True, False, False)


def test_age_buckets_and_floor(spark):
    ages = [17, 19, 20, 29, 59, 60, None]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    assert [r[0] for r in df.select(demographics.age_bucket(F.col("a"))).collect()] == [
        "Other", "Other", "20s", "20s", "50s", "Other", "Other"
    ]
    when = F.lit("2000-05-01").cast("timestamp")
    r = one(
        spark, floored=demographics.age_at(F.lit(10), F.lit(1998), when),
        raw=demographics.age_at(F.lit(10), F.lit(1998), when, None),
        unknown=demographics.age_at(F.lit(None).cast("int"), F.lit(1998), when),
        era=demographics.era_start(F.lit("2008 - 2010")), no_era=demographics.era_start(F.lit(None).cast("string")),
    )
    assert (r.floored, r.raw, r.unknown, r.era, r.no_era) == (18, 12, None, 2008, None)


def test_race_first_match_wins(spark):
    texts = ["WHITE - BRAZILIAN", "BLACK/CAPE VERDEAN", "hispanic or latino", "ASIAN", "UNKNOWN", None, "WHITE AND BLACK"]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    assert [r[0] for r in df.select(demographics.race_category(F.col("r"))).collect()] == [
        "White", "Black", "Hispanic", "Asian", "Other/Unknown", "Other/Unknown", "White"
    ]


def test_published_mcnemar_p_values(spark):
    rows = [(90, 114, 0.10732755776161251), (125, 94, 0.042640722640095774), (60, 115, 4.4646663003300446e-05)]
    df = spark.createDataFrame([(float((abs(b - c) - 1) ** 2) / (b + c), p) for b, c, p in rows], "x double, p double")
    for r in df.select("p", stats.chi2_1df_upper_tail(F.col("x")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-9)


def test_published_ppv(spark):
    for prev, want in ((0.01, 0.0324), (0.02, 0.0634), (0.05, 0.1487)):
        r = one(spark, v=stats.ppv(F.lit(0.8455), F.lit(0.7452), F.lit(prev), stats.EPS))
        assert round(r.v, 4) == want


def test_wilson_and_infinities(spark):
    low, high = stats.wilson(F.lit(0.0516), F.lit(155))
    zero_low, zero_high = stats.wilson(F.lit(0.0), F.lit(0))
    pos, neg, odds = stats.likelihood_ratios(F.lit(1.0), F.lit(1.0))
    r = one(spark, low=low, high=high, zl=zero_low, zh=zero_high, pos=pos, neg=neg, odds=odds)
    assert (round(r.low, 4), round(r.high, 4)) == (0.0264, 0.0985)
    assert (r.zl, r.zh) == (0.0, 0.0)
    assert math.isinf(r.pos) and r.neg == 0.0 and math.isinf(r.odds)


def test_softplus_is_stable(spark):
    r = one(spark, big=stats.softplus(F.lit(800.0)), small=stats.softplus(F.lit(-800.0)), mid=stats.softplus(F.lit(0.0)))
    assert r.big == 800.0 and r.small == 0.0 and r.mid == pytest.approx(math.log(2))


def test_error_function_keeps_its_digits_far_into_the_tail(spark):
    xs = [0.0, -0.0, 0.1, -0.3, 0.46875, 0.5, -1.0, 2.0, 3.999, 4.0, 4.001, -5.0, 6.0, 8.2, 11.0, 20.0, 26.0, 30.0, -30.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", stats.erfc(F.col("x")).alias("got")).collect():
        assert r.got == pytest.approx(math.erfc(r.x), rel=1e-13, abs=1e-300)
    assert spark.createDataFrame([(None,)], "x double").select(stats.erfc(F.col("x"))).first()[0] is None
