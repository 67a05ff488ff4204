"""Metrics against naive row-by-row computations and published figures."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import calibration, compare, decision, draws, errors, evaluation, fairness
from cohortlens.session import materialise


def average_precision(y, s):
    total, out = sum(y), 0.0
    for t in sorted(set(s), reverse=True):
        hit = [b for a, b in zip(s, y) if a >= t]
        out += sum(b for a, b in zip(s, y) if a == t) / total * sum(hit) / len(hit)
    return out


def auroc(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def make(seed=1, n=157):
    rng = random.Random(seed)
    rows = []
    for model in ("smooth", "ties", "flat"):
        for i in range(n):
            y = int(rng.random() < 0.4)
            s = {"smooth": min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), "ties": rng.randint(0, 5) / 5, "flat": 0.5}[model]
            rows.append((model, i % 40, i, y, float(s)))
    return rows


ROWS = make()


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(ROWS, "model string, subject_id long, hadm_id long, label int, score double")


def pick(model):
    return [r[3] for r in ROWS if r[0] == model], [r[4] for r in ROWS if r[0] == model]


def test_rank_metrics(scores):
    for r in evaluation.rank_metrics(scores).collect():
        y, s = pick(r.model)
        assert r.auprc == pytest.approx(average_precision(y, s), abs=1e-12)
        assert r.auroc == pytest.approx(auroc(y, s), abs=1e-12)


def test_single_class_has_no_rank_metrics(spark):
    df = spark.createDataFrame([("m", 1, 0.3), ("m", 1, 0.4)], "model string, label int, score double")
    r = evaluation.rank_metrics(df).first()
    assert (r.n, r.n_pos, r.auprc, r.auroc) == (2, 2, None, None)


def test_grid_threshold_keeps_the_binary_step(spark):
    grid = np.linspace(1.0, 0.0, 1001)
    values = [float(v) for v in grid] + [0.188, 0.9999, 1.7, 0.0005]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for r in df.select("s", evaluation.first_grid_step(F.col("s")).alias("i")).collect():
        assert r.i == next(i for i, t in enumerate(grid) if r.s >= t)
    positives = spark.createDataFrame([("m", 1, 0.188), ("m", 0, 0.9)], "model string, label int, score double")
    assert evaluation.threshold_on_grid(positives).first().threshold == 0.18799999999999994


def test_grid_threshold_matches_scan(scores):
    for r in evaluation.threshold_on_grid(scores).collect():
        y, s = pick(r.model)
        want = next((t for t in np.linspace(1.0, 0.0, 1001) if sum(b for a, b in zip(s, y) if a >= t) / sum(y) >= 0.85), 0.0)
        assert r.threshold == want


def test_unreachable_recall_gives_zero(spark):
    df = spark.createDataFrame([("m", 1, -1.0), ("m", 0, 0.5)], "model string, label int, score double")
    assert evaluation.threshold_on_grid(df).first().threshold == 0.0


def test_equal_frequency_bins_put_the_remainder_last(scores):
    rows = calibration.equal_frequency_bins(scores).where("model = 'smooth'").orderBy("bin").collect()
    y, s = pick("smooth")
    order = sorted(range(len(s)), key=lambda i: (s[i], y[i]))
    size = len(s) // 10
    assert [r.n for r in rows] == [size] * 9 + [len(s) - 9 * size]
    for r in rows:
        part = order[(r.bin - 1) * size : None if r.bin == 10 else r.bin * size]
        assert r.mean_predicted == pytest.approx(np.mean([s[i] for i in part]))
        assert r.observed_fraction == pytest.approx(np.mean([y[i] for i in part]))


def test_all_tied_scores_fill_every_bin(scores):
    rows = calibration.equal_frequency_bins(scores).where("model = 'flat'").collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 157
    assert all(r.mean_predicted == pytest.approx(0.5) for r in rows)


def test_published_calibration_error(spark):
    mean = [0.01, 0.0174, 0.0303, 0.0569, 0.1307, 0.3049, 0.6227, 0.9018, 0.9903, 0.9995]
    seen = [0.0516, 0.071, 0.1097, 0.1548, 0.2968, 0.4, 0.4581, 0.7613, 0.9484, 1.0]
    rows = [("raw", 155 if i < 9 else 156, m, o) for i, (m, o) in enumerate(zip(mean, seen))]
    df = spark.createDataFrame(rows, "model string, n long, mean_predicted double, observed_fraction double")
    assert round(calibration.expected_calibration_error(df).first().ece, 4) == 0.0881


def test_equal_width_bins_use_real_edges(spark):
    values = [i / 20 for i in range(21)] + [0.1 * 3, 0.7, 0.1 * 7]
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    edges = np.linspace(0, 1, 11)
    for r in df.select("s", calibration.equal_width_bin(F.col("s")).alias("b")).collect():
        want = next(i for i in range(10) if edges[i] <= r.s and (r.s < edges[i + 1] or (i == 9 and r.s <= 1)))
        assert r.b == want


def test_published_rank_test(spark):
    """U = 40748 with n1 = 102, n2 = 500 gives AUC .7990 and p 8.29e-22 (no ties)."""
    n1, n2, u = 102, 500, 40748
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1))
    df = spark.createDataFrame([(z,)], "z double")
    from cohortlens.functions import stats

    p = df.select(stats.normal_upper_tail(F.col("z")).alias("p")).first().p
    assert p == pytest.approx(8.2856e-22, rel=2e-3) and round(u / (n1 * n2), 4) == 0.799


def test_mann_whitney_counts_pairs(scores):
    for r in evaluation.mann_whitney(scores).collect():
        y, s = pick(r.model)
        assert r.auc == pytest.approx(auroc(y, s))


def test_rank_percent_is_average_rank(scores):
    got = {r.hadm_id: r.rank_pct for r in compare.rank_normalised(scores).where("model = 'ties'").collect()}
    _, s = pick("ties")
    for i, v in enumerate(s):
        rank = sum(x < v for x in s) + (sum(x == v for x in s) + 1) / 2
        assert got[i] == pytest.approx(rank / len(s))


def test_top_share_is_exact_under_ties(scores):
    top = compare.top_share(scores).groupBy("model").count().collect()
    assert {r.model: r["count"] for r in top} == {"smooth": 31, "ties": 31, "flat": 31}
    _, s = pick("ties")
    edge = sorted(s, reverse=True)[30]
    picked = [r.score for r in compare.top_share(scores).where("model = 'ties'").collect()]
    assert min(picked) == edge and sum(v > edge for v in picked) == sum(v > edge for v in s)


def test_decision_curve_matches_formula(scores):
    rows = decision.decision_curve(scores).where("model = 'smooth' AND deployment = '2pct'").collect()
    y, s = pick("smooth")
    study = np.mean(y)
    q = [v * 0.02 / study / (v * 0.02 / study + (1 - v) * 0.98 / (1 - study)) for v in s]
    grid = np.round(np.arange(0.01, 0.405, 0.005), 4)
    assert sorted(r.threshold for r in rows) == list(grid)
    for r in rows:
        t = r.threshold
        tp = sum(b for a, b in zip(q, y) if a >= t)
        fp = sum(1 - b for a, b in zip(q, y) if a >= t)
        assert r.net_benefit_model == pytest.approx(tp / len(y) - fp / len(y) * t / (1 - t))


def test_pair_tests_against_rows(scores):
    t = scores.select("model").distinct().withColumn("threshold", F.lit(0.5))
    decided = evaluation.with_threshold(scores, t)
    rows = compare.pair_tests(decided.withColumn("label", (F.col("hadm_id") % 2).cast("int")), ["smooth", "ties", "flat"]).collect()
    assert len(rows) == 3
    r = next(x for x in rows if (x.model_a, x.model_b) == ("smooth", "ties"))
    label = [i % 2 for i in range(157)]
    a = [int(v >= 0.5) for v in pick("smooth")[1]]
    b = [int(v >= 0.5) for v in pick("ties")[1]]
    assert r.b_only_a_correct == sum(x == y != z for x, z, y in zip(a, b, label) if z != y)
    assert r.agreement_pct == pytest.approx(100 * np.mean(np.array(a) == np.array(b)))
    flat = next(x for x in rows if x.model_b == "flat")
    assert flat.pearson_r is None and 0.0 <= flat.mcnemar_p <= 1.0


def test_alignment_needs_the_composite_key(spark, scores):
    grain = spark.createDataFrame([(1, 1), (1, 41), (99, 99)], "subject_id long, hadm_id long")
    out = compare.align_scores(grain, scores, ["smooth", "ties"])
    assert out.count() == 6
    assert {r.score for r in out.where("subject_id = 99").collect()} == {0.0}
    compare.require_aligned(scores.select("subject_id", "hadm_id").distinct(), scores)
    with pytest.raises(ValueError, match="misaligned"):
        compare.require_aligned(grain, scores)


def test_bootstrap_is_deterministic_and_covers(scores):
    rows = scores.where("model <> 'flat'")
    one = fairness.bootstrap_auprc(rows.repartition(2), ["model"], 300).orderBy("model").collect()
    two = fairness.bootstrap_auprc(rows.repartition(7), ["model"], 300).orderBy("model").collect()
    assert one == two
    rng = np.random.default_rng(0)
    for r in one:
        y, s = pick(r.model)
        point = average_precision(y, s)
        assert r.n_valid == 300 and r.auprc_ci_lo < point < r.auprc_ci_hi
        draws = []
        for _ in range(200):
            i = rng.integers(0, len(y), len(y))
            draws.append(average_precision([y[k] for k in i], [s[k] for k in i]))
        low, high = np.percentile(draws, [2.5, 97.5])
        assert abs(low - r.auprc_ci_lo) < 0.05 and abs(high - r.auprc_ci_hi) < 0.05


def test_pu_risk_falls_back_on_one_class(spark):
    df = spark.createDataFrame([("m", 1, 0.3), ("m", 1, -0.2)], "model string, label int, logit double")
    r = evaluation.pu_risk(df, F.lit(0.3)).first()
    assert r.pu_risk == pytest.approx(np.mean([math.log1p(math.exp(-0.3)), math.log1p(math.exp(0.2))]))


def test_bootstrap_does_not_depend_on_the_blocks(scores, monkeypatch):
    rows = scores.where("model <> 'flat'").withColumn("model", F.when(F.col("model") != "ties", F.col("model")))
    whole = fairness.bootstrap_auprc(rows, ["model"], 50).orderBy("model").collect()
    monkeypatch.setattr(fairness, "BLOCK_ROWS", 7)  # many blocks, and tied scores as blocks of their own
    parts = fairness.bootstrap_auprc(rows, ["model"], 50).orderBy("model").collect()
    assert {r.model for r in whole} >= {None} and [r.n_valid for r in whole] == [r.n_valid for r in parts]
    for a, b in zip(whole, parts):
        assert a.auprc_ci_lo == pytest.approx(b.auprc_ci_lo) and a.auprc_ci_hi == pytest.approx(b.auprc_ci_hi)


def test_error_tables_per_key(spark):
    """Missing keys are a key of their own, a key without lengths keeps its row, medians and quartiles are per key."""
    rows = [("a", 1, 0, 0.9, 100.0), ("a", 0, 1, 0.1, 400.0), ("a", 0, 1, 0.2, 40.0), ("a", 1, 1, 0.8, 900.0),
            (None, 0, 1, 0.3, 10.0), (None, 0, 0, 0.2, 30.0), ("b", 0, 1, None, None)]
    df = spark.createDataFrame(rows, "model string, predicted int, label int, score double, note_length double")
    got = {r.model: r for r in errors.false_negative_sparsity(df).collect()}
    assert {k: (r.n_fn, r.n_below_q1, r.n_short) for k, r in got.items()} == {"a": (2, 1, 2), None: (1, 1, 1), "b": (1, 0, 0)}
    demo = df.selectExpr("*", "'F' gender", "'20s' age_group", "'White' race_cat", "true is_emergency")
    table = {(r.model, r.error_group): r for r in errors.error_profile(demo).collect()}
    assert table["a", errors.OVERALL].median_length == 250.0 and table["a", errors.FALSE_NEGATIVE].n == 2
    assert table[None, errors.OVERALL].n == 2 and table["b", errors.OVERALL].median_length is None
    assert errors.error_profile(demo.limit(0)).count() == 0


def test_term_rates_per_key(spark):
    notes = spark.createDataFrame([(1, "nightmare"), (2, None), (3, "calm nightmare")], "hadm_id int, text string")
    facts = errors.note_facts(notes, "text", terms={"n": "nightmare", "c": "calm"})
    rows = [("x", 1, 1, 0), ("x", 2, 0, 1), ("x", 3, 1, 1), ("y", 3, 0, 1)]
    decided = spark.createDataFrame(rows, "model string, hadm_id int, predicted int, label int").join(facts, "hadm_id")
    rates = errors.term_rates(decided, ["n", "c"])
    got = {(r.model, r.term): (r.fp_rate, r.fn_rate, round(r.overall_rate, 6)) for r in rates.collect()}
    assert got == {("x", "n"): (1.0, 0.0, 0.666667), ("x", "c"): (0.0, 0.0, 0.333333), ("y", "n"): (0.0, 1.0, 1.0), ("y", "c"): (0.0, 1.0, 1.0)}
    top = {(r.model, r.side): r.term for r in errors.top_terms(rates, 1).collect()}
    assert top == {("x", "fp"): "n", ("x", "fn"): "c", ("y", "fp"): "c", ("y", "fn"): "c"}


def test_bootstrap_broadcasts_no_row_tables_and_spreads_both_passes(scores, monkeypatch):
    seen = {}

    def noted(df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, name)

    monkeypatch.setattr(fairness, "materialise", noted)
    out = fairness.bootstrap_auprc(scores, ["model"], replicates=16, row=("hadm_id",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert seen["rows"].count("BroadcastHashJoin") <= 1  # the block numbers
    assert "SortMergeJoin" in seen["rows"]
    assert "BroadcastHashJoin" not in plan
    assert plan.count("REPARTITION_BY_NUM") >= 2  # before the rows are multiplied, and by block


def shuffled_rows(plan):
    """Rows that each exchange of an executed plan wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return shuffled_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in shuffled_rows(plan.children().apply(i))]
    return below + ([plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else [])


def test_bootstrap_writes_rows_and_blocks_not_draws(scores, monkeypatch):
    """1,000 replicates are 125 chunks: a row is moved as it is, and only a block becomes a row per chunk."""
    seen = {}

    def noted(df, name):
        df.collect()
        seen[name] = shuffled_rows(df._jdf.queryExecution().executedPlan())
        return materialise(df, name)

    monkeypatch.setattr(fairness, "materialise", noted)
    out = fairness.bootstrap_auprc(scores, ["model"], 1000)
    assert out.count() == 3
    out.collect()
    seen["result"] = shuffled_rows(out._jdf.queryExecution().executedPlan())
    assert len(ROWS) in seen["totals"] and len(ROWS) in seen["result"]  # both passes move every row once
    assert max(n for found in seen.values() for n in found) < 5 * len(ROWS)


def test_bootstrap_equals_plain_replicates(spark, monkeypatch):
    """Missing keys, missing and odd scores, tied scores (blocks and pieces of their own) and repeated rows."""
    rng = random.Random(5)
    odd = [None, float("nan"), 0.0, -0.0, float("inf"), -float("inf")]
    rows = [(k, i, rng.randint(0, 1), rng.choice([*odd, rng.random(), 0.5, 0.5, 0.5])) for k in ("a", None) for i in range(120)]
    rows += [("one", 1, 1, 0.5), *[("b", i // 2, i // 2 % 2, i / 9) for i in range(40)]]
    df = spark.createDataFrame(rows, "model string, hadm_id long, label int, score double")
    expected, limits = {}, draws.poisson_limits()
    for key in ("a", None, "b"):
        values = []
        for r in range(60):
            cells = {}
            for k, i, y, s in rows:
                if k == key:
                    text = "|".join(["42", *([] if k is None else [k]), str(i)])
                    start = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % (draws.MODULUS - 1) + 1
                    x = start * pow(draws.MULTIPLIER, r + 1, draws.MODULUS) % draws.MODULUS
                    cell = cells.setdefault(0.0 if s is None or math.isnan(s) else s, [0, 0])
                    cell[y] += sum(x > limit for limit in limits)
            tp = seen = total = 0
            for s in sorted(cells, reverse=True):
                tp, seen = tp + cells[s][1], seen + sum(cells[s])
                total += cells[s][1] * tp / seen if cells[s][1] else 0.0
            if 0 < tp < seen:
                values.append(total / tp)
        values.sort()
        expected[key] = (len(values), values[int(len(values) * 0.025)], values[int(len(values) * 0.975)])
    for size in (7, 8192):
        monkeypatch.setattr(fairness, "BLOCK_ROWS", size)
        got = {r.model: (r.n_valid, r.auprc_ci_lo, r.auprc_ci_hi) for r in fairness.bootstrap_auprc(df, ["model"], 60).collect()}
        assert set(got) == set(expected)
        for key, want in expected.items():
            assert got[key] == pytest.approx(want, abs=1e-12)


def test_poisson_counts_equal_plain_steps():
    """Ends of the range, and all counts whatever number of them is drawn at a time."""
    starts = np.array([1, 2, draws.MODULUS - 1, *random.Random(3).sample(range(1, draws.MODULUS), 800)])
    limits = draws.poisson_limits()
    want = [[sum(int(x) * pow(draws.MULTIPLIER, r + 1, draws.MODULUS) % draws.MODULUS > v for v in limits) for x in starts] for r in range(100)]
    got = np.concatenate([c.copy() for _, c in draws.poisson_counts(starts, 100)])
    assert got.tolist() == want and got.max() >= 6
