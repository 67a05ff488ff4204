"""Prefix sums, percentiles and hash ranks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.prefix import hash_ranks, join_parameters, percentiles, prefix_sums


def _values(seed):
    rng = random.Random(seed)
    pick = [
        lambda: 0.0, lambda: -0.0, lambda: 1e-300, lambda: 5e-324, lambda: -3.5, lambda: 2.0,
        lambda: 1.9999999999999998, rng.random, lambda: -rng.random() * 1e5,
        lambda: rng.random() * 1e-9, lambda: float(rng.randint(0, 5)), lambda: 2.0 ** rng.randint(-40, 40),
    ]
    return [rng.choice(pick)() for _ in range(2000)]


def test_prefix_sums_match_brute_force(spark):
    rows = [(k, v) for k in "ab" for v in _values(k)]
    hist = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    exact = Counter((k, v + 0.0) for k, v in rows)
    out = prefix_sums(hist, ["k"], "v", ["n"]).collect()
    assert len(out) == len(exact)
    for r in out:
        assert r.n_below == sum(c for (k, v), c in exact.items() if k == r.k and v < r.v)
        assert r.n_total == 2000


def test_percentiles_match_numpy(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(0, 10)) for k in "abc" for _ in range(101)] + [("d", 7.0), ("e", None)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert set(got) == set("abcd")
    for k in "abcd":
        want = np.percentile([v for g, v in rows if g == k], [25, 50, 90])
        assert np.allclose([got[k].q1, got[k].m, got[k].q9], want, rtol=0, atol=1e-12)


def test_hash_ranks_are_exact_and_partition_free(spark):
    df = spark.range(3000).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)))
    first = {r.id: r.hash_rank for r in hash_ranks(df.repartition(3), ["s"], ["id"]).collect()}
    again = {r.id: r.hash_rank for r in hash_ranks(df.repartition(17), ["s"], ["id"]).collect()}
    assert first == again
    hot = sorted((i for i in range(0, 3000, 3)), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert [first[i] for i in hot] == list(range(1, 1001))


def test_parameter_join_takes_any_number_of_rows_and_missing_keys(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, id % 7) AS k", "id")
    params = spark.createDataFrame([(None, "none"), *[(i, str(i)) for i in range(7)]], "k long, p string")
    assert join_parameters(df, params, ["k"]).where("p = coalesce(cast(k AS string), 'none')").count() == 300
    many = spark.range(120_000).withColumn("p", F.lit(1))
    assert join_parameters(spark.range(120_000), many, ["id"]).count() == 120_000


def test_missing_keys_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    values = [3.0, nan, -inf, 1.5, inf, -0.0, 2.0, -7.0]
    rows = [(g, v, i + 1) for g in ("a", None) for i, v in enumerate(values)]
    hist = spark.createDataFrame(rows, "g string, v double, n long")
    order = sorted((v for v in values if v == v)) + [nan]
    sizes = {str(v): i + 1 for i, v in enumerate(values)}
    for r in prefix_sums(hist, ["g"], "v", ["n"]).collect():
        at = [str(v) for v in order].index(str(r.v))
        assert r.n_below == sum(sizes[str(v)] for v in order[:at]) and r.n_total == sum(sizes.values())
    assert prefix_sums(hist, ["g"], "v", ["n"]).count() == len(rows)
    got = {r.g: r.mid for r in percentiles(hist, ["g"], "v", {"mid": 0.5}).collect()}
    assert got == {"a": 1.5, None: 1.5}
    ranks = hash_ranks(hist.where("not isnan(v)"), ["g"], ["n"]).groupBy("g").agg(F.sum("hash_rank").alias("s"), F.max("stratum_size").alias("m"))
    assert {(r.g, r.s, r.m) for r in ranks.collect()} == {("a", 28, 7), (None, 28, 7)}


def test_no_side_that_grows_is_broadcast(spark):
    hist = spark.range(1000).selectExpr("id % 3 AS k", "rand(1) AS v", "1L AS n")
    out = prefix_sums(hist, ["k"], "v", ["n"])
    out.count()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
