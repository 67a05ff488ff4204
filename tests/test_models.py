"""Linear models: the penalty convention, propensity defaults and PU weights."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import calibration, descent, evaluation, models, newton


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1.0, 5.0]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    data = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "subject_id long, a double, b double, label int"), x, y


def gradient(x, y, w, coef, bias, c):
    """Gradient of C * sum(w * log-loss) + |coef|^2 / 2."""
    p = 1 / (1 + np.exp(-(x @ coef + bias)))
    r = c * w * (p - y)
    return np.append(x.T @ r + coef, r.sum())


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_balanced_fit_is_the_penalised_optimum(rows, c):
    df, x, y = rows
    (model,) = newton.fit_logistic(models.balanced(df), ["a", "b"], [c], weight="weight")
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    g = gradient(x, y, w, model.coefficients, model.intercept, c)
    assert np.abs(g).max() < 1e-9 * max(1.0, c * len(y))


def test_a_path_equals_single_fits(rows):
    df, _, _ = rows
    path = newton.fit_logistic(df, ["a", "b"], models.C_GRID)
    for m in path:
        (one,) = newton.fit_logistic(df, ["a", "b"], [m.c])
        assert np.allclose(one.coefficients, m.coefficients, atol=1e-10) and abs(one.intercept - m.intercept) < 1e-10


def test_steps_that_overshoot_are_halved(spark):
    """Separable classes far from 0: full steps from 0 would leave the range of the exponential."""
    data = [(float(v), int(v > 1010)) for v in range(1000, 1020)]
    (model,) = newton.fit_logistic(spark.createDataFrame(data, "v double, label int"), ["v"], [1000.0])
    x, y = np.array([[v] for v, _ in data]), np.array([k for _, k in data])
    assert np.abs(gradient(x, y, np.ones(20), model.coefficients, model.intercept, 1000.0)).max() < 1e-3


def test_platt_fits_each_model_by_itself(spark, rows):
    df, x, y = rows
    two = df.selectExpr("'m' AS model", "a AS score", "label").union(df.selectExpr("'n'", "b", "label"))
    fitted = calibration.fit_platt(two)
    assert [m.key for m in fitted] == ["m", "n"]
    for m, k in zip(fitted, (0, 1)):
        assert np.abs(gradient(x[:, k : k + 1], y, np.ones(len(y)), m.coefficients, m.intercept, 1.0)).max() < 1e-8
    for r in calibration.apply_platt(fitted, two).collect():
        m = fitted[r.model == "n"]
        assert r.calibrated == pytest.approx(1 / (1 + np.exp(-(r.score * m.coefficients[0] + m.intercept))))


def test_models_are_stored_as_tables(spark, rows, tmp_path):
    df, _, _ = rows
    path = newton.fit_logistic(df, ["a", "b"], [0.1, 1.0])
    newton.save_models(spark, path, str(tmp_path / "m"))
    for a, b in zip(path, newton.load_models(spark, str(tmp_path / "m")), strict=True):
        assert a.c == b.c and a.intercept == b.intercept and dict(zip(a.features, a.coefficients)) == dict(zip(b.features, b.coefficients))


def test_propensities_are_clipped_and_defaulted(rows):
    df, _, _ = rows
    est = models.propensities(df, ["a", "b"])
    r = est.agg(F.min("propensity").alias("lo"), F.max("propensity").alias("hi")).first()
    assert 0.05 <= r.lo and r.hi <= 0.95
    out = models.attach_propensity(df.select((F.col("subject_id") + 190).alias("subject_id")), est)
    assert out.where("propensity = 0.5 AND subject_id >= 200").count() == 190


def test_linear_attribution_adds_up_to_the_logit(spark, rows):
    df, _, _ = rows
    (model,) = newton.fit_logistic(df, ["a", "b"])
    table = newton.coefficient_table(spark, [model], intercept=False).select("feature", "coefficient")
    sums = models.linear_attribution(df, table, ["a", "b"]).groupBy("subject_id").agg(F.sum("value").alias("v"))
    both = models.score(model, df).join(sums, "subject_id").withColumn("d", F.abs(F.col("logit") - F.col("v") - model.intercept))
    assert both.agg(F.max("d")).first()[0] < 1e-9


# ── descent ─────────────────────────────────────────────────────────────────


def plain_pu(x, y, w, beta, prior, penalty):
    """Value and gradient of the non-negative risk in NumPy."""
    z, full = x @ beta[:-1] + beta[-1], np.column_stack([x, np.ones(len(x))])
    p, pos = 1 / (1 + np.exp(-z)), y == 1
    loss = lambda s: np.log1p(np.exp(-s))
    share = np.where(pos, w, 0) / w[pos].sum()
    up, down, unl = share @ loss(z), share @ loss(-z), loss(-z)[~pos].mean()
    rest = unl - prior * down
    ridge = np.append(beta[:-1], 0)
    g = prior * full.T @ (share * (p - 1)) + penalty * ridge
    if rest > 0:
        g = g + full.T @ np.where(pos, 0, p) / (~pos).sum() - prior * full.T @ (share * p)
    return prior * up + max(0.0, rest) + penalty / 2 * (ridge @ ridge), g


@pytest.mark.parametrize("prior", [0.05, 0.4, 0.95])
def test_pu_objective_equals_numpy(rows, prior):
    df, x, y = rows
    rng = np.random.default_rng(5)
    dense = descent.dense_rows(df.withColumn("e", 0.1 + F.col("subject_id") % 9 / 10.0), ["a", "b"], weight=1 / F.col("e")).repartition(5)
    w = 1 / (0.1 + np.arange(200) % 9 / 10.0)
    at = descent.pu_objective(dense, prior, 0.01)
    for scale in (0.0, 0.3, 3.0):
        beta = rng.normal(size=3) * scale
        value, g = at(beta)
        want, h = plain_pu(x, y, w, beta, prior, 0.01)
        assert value == pytest.approx(want, abs=1e-12) and np.allclose(g, h, atol=1e-12)


def test_pu_risk_falls_at_each_step_and_is_the_reported_risk(rows):
    df, _, _ = rows
    dense = descent.dense_rows(df, ["a", "b"], carried=["subject_id"])
    fitted = descent.fit_pu(dense, 2, 0.3, steps=15, penalty=0.0)
    assert len(fitted.path) > 3 and all(b < a for a, b in zip(fitted.path, fitted.path[1:]))
    scored = descent.with_logit(dense, fitted).withColumn("label", F.col("y").cast("int")).withColumn("model", F.lit("m"))
    assert evaluation.pu_risk(scored, F.lit(0.3)).first().pu_risk == pytest.approx(fitted.path[-1], abs=1e-9)


def test_pu_with_one_class_is_cross_entropy(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, label int")
    value, _ = descent.pu_objective(descent.dense_rows(df, ["a"]), 0.3, 0.0)(np.zeros(2))
    assert value == pytest.approx(np.log(2))


def test_sparse_fit_reaches_the_optimum_and_text_risk_falls(spark):
    rng = np.random.default_rng(8)
    words = [f"term{i}" for i in range(40)]
    data = []
    for i in range(120):
        label = int(rng.random() < 0.5)
        picks = rng.choice(words[: 25] if label else words[15:], 12)
        data.append((i, " ".join(picks), label))
    data += [(500, None, 0), (501, "", 1)]
    notes = spark.createDataFrame(data, "n long, t string, label int")
    vectors, vocabulary = models.text_vectors(notes, "n", "t", 300)
    rows = notes.join(vectors, "n").select(F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), "idx", "val")
    width = vocabulary.count()
    assert width == 300 and rows.count() == 122
    fitted = descent.fit_sparse_logistic(rows, width, 1.0)
    got = rows.collect()
    x, y = np.zeros((len(got), width)), np.array([r.y for r in got])
    for k, r in enumerate(got):
        x[k, r.idx] = r.val
    assert np.abs(gradient(x, y, np.ones(len(y)), fitted.coefficients, fitted.intercept, 1.0)).max() < 1e-3
    risk = descent.fit_pu(rows, width, 0.4, steps=6)
    assert len(risk.path) > 3 and all(b < a for a, b in zip(risk.path, risk.path[1:]))


def test_vocabulary_ties_go_by_the_hash(spark):
    import hashlib

    notes = spark.createDataFrame([(1, "aa bb cc"), (2, "aa dd ee"), (3, "aa")], "n long, t string")
    counts = models.text_counts(notes, "n", "t")
    assert {t.term: t.tf for t in counts.where("n = 1").first().terms} == {"aa": 1, "bb": 1, "cc": 1, "aa bb": 1, "bb cc": 1}
    once = ["bb", "cc", "dd", "ee", "aa bb", "bb cc", "aa dd", "dd ee"]
    first = sorted(once, key=lambda t: hashlib.md5(f"42|{t}".encode()).hexdigest())[:3]
    got = models.vocabulary(counts, "n", 4).collect()
    assert {r.term for r in got} == {"aa", *first} and sorted(r.idx for r in got) == [0, 1, 2, 3]
    assert models.vocabulary(counts, "n", 100).count() == 9
    assert models.vocabulary(counts.limit(0), "n", 100).count() == 0


def test_fits_read_stored_blocks_that_hold_every_row_once(spark):
    data = [(float(i % 2), 1.0 + i, list(range(i % 5)) + [9], [float(j) for j in range(i % 5)] + [0.5]) for i in range(40)] + [(1.0, 2.0, list(range(30)), [1.0] * 30), (0.0, 3.0, [], [])]
    rows = spark.createDataFrame(data, "y double, w double, idx array<int>, val array<double>")
    found = descent.blocks_of(rows, 8).collect()
    sizes = [np.frombuffer(b.sizes, np.int64) for b in found]
    assert all(s.sum() <= 8 or len(s) == 1 for s in sizes)
    flat = []
    for b, s in zip(found, sizes):
        ends = s.cumsum()
        y, w, idx, val = (np.frombuffer(v, k) for v, k in ((b.y, float), (b.w, float), (b.idx, np.int32), (b.val, float)))
        flat += [(y[i], w[i], tuple(idx[e - n : e]), tuple(val[e - n : e])) for i, (e, n) in enumerate(zip(ends, s))]
    assert sorted(flat) == sorted((y, w, tuple(i), tuple(v)) for y, w, i, v in data)
    keyed = spark.createDataFrame([("a", [1.0, 2.0], 1.0, 1.0), ("b", [3.0, 4.0], 0.0, 2.0), (None, [5.0, 6.0], 1.0, 1.0), ("a", [7.0, 8.0], 0.0, 1.0)], "k string, x array<double>, y double, w double")
    packed = keyed.mapInArrow(newton._packed(2), "k string, x binary, y binary, w binary").collect()
    per_key = {k: sorted(v for b in packed if b.k == k for v in np.frombuffer(b.x, float)) for k in {b.k for b in packed}}
    assert per_key == {"a": [1.0, 2.0, 7.0, 8.0], "b": [3.0, 4.0]}


def test_text_vectors_move_no_terms_and_take_any_key(spark):
    """Vectors equal plain Python, also for repeated and missing keys, and no entry of a note is shuffled."""
    from collections import Counter

    texts = [(1, "Aa bb aa bb, CC x dd"), (2, None), (3, ""), (None, "aa bb"), (4, "cc dd aa"), (5, "Ünïcode_1 ünïcode_1 x 𝔘𝔫 aa"), (6, "zz")]
    twice = [*texts, (4, "aa aa dd"), (None, "aa")]

    def count(text):
        w = [t for t in re.findall(r"\w+", (text or "").lower()) if len(t) > 1]
        return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])

    for rows in (texts, twice):
        frame = spark.createDataFrame(rows, "k long, t string").repartition(3)
        vectors, vocabulary = models.text_vectors(frame, "k", "t", 12)
        words = {r.idx: r for r in vocabulary.collect()}
        assert len(words) == 12 and all(r.df == sum(r.term in count(t) for _, t in rows) for r in words.values())
        want = []
        for k, _ in rows:
            each = [] if k is None else [count(t) for other, t in rows if other == k]
            w = [(i, (1 + np.log(c[r.term])) * (1 + np.log((1 + len(rows)) / (1 + r.df)))) for i, r in words.items() for c in each if r.term in c]
            norm = np.sqrt(sum(x * x for _, x in w))
            want.append((k or 0, [(i, round(x / norm, 9)) for i, x in sorted(w)]))
        got = [(r.k or 0, [(i, round(v, 9)) for i, v in zip(r.idx, r.val, strict=True)]) for r in vectors.collect()]
        assert sorted(got) == sorted(want)
        if rows is texts:
            assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    long = models.vector_attribution(vectors, "k", vocabulary, vocabulary.select("term", F.lit(2.0).alias("coefficient")))
    assert sum(r.value for r in long.collect()) == pytest.approx(2 * sum(sum(r.val) for r in vectors.collect()))
    assert "SortMergeJoin" not in long._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_terms_are_counted_alike_in_small_slices(monkeypatch):
    import pyarrow as pa

    from cohortlens.operators import terms

    words = [["aa", "bb", "aa"], None, [], ["bb", "aa", "bb", "aa"], ["cc"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(words, pa.list_(pa.string()))], ["k", "_words"])

    def summed(part):
        out = {}
        for r in pa.Table.from_batches(part).to_pylist():
            cf, df = out.get(r["term"], (0, 0))
            out[r["term"]] = (cf + r["cf"], df + r["df"])
        return out

    want = {"aa": (4, 2), "bb": (3, 2), "cc": (1, 1), "aa bb": (2, 2), "bb aa": (3, 2)}
    for size in (1, 3, 1 << 21):
        monkeypatch.setattr(terms, "SLICE", size)
        assert summed(terms.word_totals(iter([batch, batch.slice(0, 0)]))) == want
        counted = list(terms.counted("k")(iter([batch])))
        assert summed(terms.totals(iter(counted))) == want
        assert [r["terms"] is None for p in counted for r in p.to_pylist()] == [False, True, False, False, False]
