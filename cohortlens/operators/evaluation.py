"""Classifier metrics on the score histogram.

Input is a long table (model, ..., label, score). ``keys`` may be any grouping
columns: every metric is an aggregate per key, and everything rank-based is a
prefix sum over ``histogram``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import stats
from cohortlens.operators.prefix import join_parameters, percentiles, prefix_sums

MODEL = ["model"]
PREVALENCES = [0.01, 0.02, 0.05, 0.10, 0.20]
TARGET_RECALL = 0.85
GRID_STEPS = 1000


def clean_scores(scores: DataFrame) -> DataFrame:
    """Missing and NaN scores become 0."""
    return scores.withColumn("score", F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)))


def histogram(scores: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Positives and negatives per distinct score; missing and NaN scores count as 0."""
    label = F.col("label").cast("long")
    return clean_scores(scores).groupBy(*keys, F.col("score").cast("double").alias("score")).agg(
        F.sum(label).alias("pos"), F.sum(1 - label).alias("neg")
    )


def ranked_histogram(scores: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Histogram with counts below each score and totals per key."""
    return prefix_sums(histogram(scores, keys), keys, "score", ["pos", "neg"])


# ── rank metrics ────────────────────────────────────────────────────────────


def _at_or_above() -> tuple[Column, Column]:
    return F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")


def rank_metric_columns() -> list[Column]:
    """AUPRC (average precision) and AUROC (ties half) of a ranked histogram."""
    tp, fp = _at_or_above()
    p, n = F.col("pos_total"), F.col("neg_total")
    ap = F.sum(F.try_divide(F.col("pos"), p) * F.try_divide(tp, tp + fp))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    both = (F.max(p) > 0) & (F.max(n) > 0)
    return [
        F.max(p + n).alias("n"),
        F.max(p).alias("n_pos"),
        F.when(both, ap).alias("auprc"),
        F.when(both, F.try_divide(wins, F.max(p) * F.max(n))).alias("auroc"),
    ]


def rank_metrics(scores: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """n, n_pos, AUPRC and AUROC per key; the last two are null for a single class."""
    return ranked_histogram(scores, keys).groupBy(*keys).agg(*rank_metric_columns())


def threshold_over_scores(scores: DataFrame, keys: Sequence[str] = MODEL, target: float = TARGET_RECALL) -> DataFrame:
    """Largest observed score whose recall reaches ``target`` (any score range).

    Falls back to the smallest score when no threshold reaches it.
    """
    tp, _ = _at_or_above()
    reached = stats.ratio(tp, F.col("pos_total")) >= target
    return ranked_histogram(scores, keys).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(reached, F.col("score"))), F.min("score")).alias("threshold")
    )


def precision_at_recall(scores: DataFrame, keys: Sequence[str] = MODEL, target: float = TARGET_RECALL) -> DataFrame:
    """Best precision among thresholds whose recall reaches ``target``."""
    tp, fp = _at_or_above()
    reached = stats.ratio(tp, F.col("pos_total")) >= target
    return ranked_histogram(scores, keys).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(reached, F.try_divide(tp, tp + fp))), F.lit(0.0)).alias("precision_at_recall")
    )


def grid_value(step: Column) -> Column:
    """Threshold grid from 1 to 0; the small binary error of each step is part of it."""
    value = F.lit(1.0) + step * F.lit(-1.0 / GRID_STEPS)
    return F.when(step >= GRID_STEPS, F.lit(0.0)).otherwise(value)


def first_grid_step(score: Column) -> Column:
    """First step of the descending grid that ``score`` reaches; above GRID_STEPS if none."""
    guess = F.ceil((F.lit(1.0) - score) * GRID_STEPS)
    guess = F.least(F.greatest(guess, F.lit(1)), F.lit(GRID_STEPS))
    return (
        F.when(score >= grid_value(guess - 1), guess - 1)
        .when(score >= grid_value(guess), guess)
        .otherwise(guess + 1)
    )


def threshold_on_grid(scores: DataFrame, keys: Sequence[str] = MODEL, target: float = TARGET_RECALL) -> DataFrame:
    """Largest grid threshold whose recall reaches ``target``; 0 if there is none.

    Positives are counted per grid step, so the ordered window has at most
    1,002 rows per key.
    """
    step = first_grid_step(F.col("score").cast("double"))
    label = F.col("label").cast("long")
    steps = scores.groupBy(*keys, step.alias("_step")).agg(F.sum(label).alias("pos"))
    running = F.sum("pos").over(W.partitionBy(*keys).orderBy("_step"))
    total = F.sum("pos").over(W.partitionBy(*keys))
    reached = steps.select(*keys, "_step", (stats.ratio(running, total) >= target).alias("_ok"))
    first = F.min(F.when(F.col("_ok") & (F.col("_step") <= GRID_STEPS), F.col("_step")))
    return reached.groupBy(*keys).agg(F.coalesce(grid_value(first), F.lit(0.0)).alias("threshold"))


# ── confusion and operating-point metrics ───────────────────────────────────


def with_threshold(scores: DataFrame, thresholds: DataFrame, on: Sequence[str] = MODEL) -> DataFrame:
    """Attach the per-model threshold and ``predicted`` (score >= threshold).

    ``thresholds`` has one row per model.
    """
    joined = join_parameters(scores, thresholds.select(*on, "threshold"), on)
    return joined.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))


def outcome(predicted: Column, label: Column) -> Column:
    """TP, FP, FN or TN."""
    return (
        F.when((predicted == 1) & (label == 1), "TP")
        .when((predicted == 1) & (label == 0), "FP")
        .when((predicted == 0) & (label == 1), "FN")
        .otherwise("TN")
    )


def confusion(decided: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    cell = outcome(F.col("predicted"), F.col("label"))
    return decided.groupBy(*keys).agg(
        *[F.count(F.when(cell == c, 1)).alias(c.lower()) for c in ("TP", "FP", "TN", "FN")]
    )


def operating_metrics(decided: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Confusion counts with sensitivity, specificity, precision, F1 and alert rate."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion(decided, keys).select(
        *keys, "tp", "fp", "tn", "fn",
        stats.ratio(tp, tp + fn).alias("sensitivity"),
        stats.ratio(tn, tn + fp).alias("specificity"),
        stats.ratio(tp, tp + fp).alias("precision"),
        stats.f1_score(tp, fp, fn).alias("f1"),
        stats.ratio(tp + fp, tp + fp + tn + fn).alias("alert_rate"),
    )


def clinical_utility(metrics: DataFrame, eps: bool = False) -> DataFrame:
    """LR+, LR-, diagnostic odds ratio and workup reduction.

    ``eps`` selects the variant that shifts each denominator instead of
    reporting infinities.
    """
    form = stats.likelihood_ratios_eps if eps else stats.likelihood_ratios
    pos, neg, odds = form(F.col("sensitivity"), F.col("specificity"))
    return (
        metrics.withColumn("lr_positive", pos)
        .withColumn("lr_negative", neg)
        .withColumn("diagnostic_odds_ratio", odds)
        .withColumn("workup_reduction", 1 - F.col("alert_rate"))
    )


def at_prevalences(metrics: DataFrame, prevalences: Sequence[float] = PREVALENCES, eps: float = 0.0) -> DataFrame:
    """One row per metric row and deployment prevalence with PPV, NPV, NNS, NNE."""
    rows = metrics.withColumn("prevalence", F.explode(F.array(*[F.lit(float(p)) for p in prevalences])))
    sens, spec, prev = F.col("sensitivity"), F.col("specificity"), F.col("prevalence")
    value = stats.ppv(sens, spec, prev, eps)
    return (
        rows.withColumn("ppv", value)
        .withColumn("npv", F.coalesce(stats.npv(sens, spec, prev, eps), F.lit(0.0)))
        .withColumn("nns", stats.number_needed(F.coalesce(F.col("ppv"), F.lit(0.0))))
        .withColumn("nne", stats.number_needed(sens - (1 - spec)))
    )


def pu_metrics(metrics: DataFrame, prior: Column) -> DataFrame:
    """Positive-unlabelled corrections next to the raw metrics."""
    corrected = stats.pu_corrected(
        F.col("auprc"), F.col("auroc"), F.col("sensitivity"), F.col("specificity"), F.col("precision"), prior
    )
    return metrics.select("*", prior.alias("prior"), *[c.alias(n) for n, c in corrected.items()])


def full_metrics(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Rank and operating metrics side by side."""
    decided = with_threshold(scores, thresholds)
    return (
        rank_metrics(scores, keys)
        .join(operating_metrics(decided, keys), list(keys))
        .join(thresholds.select("model", "threshold"), "model")
    )


# ── rank test and distributions ─────────────────────────────────────────────


def mann_whitney(scores: DataFrame, keys: Sequence[str] = MODEL, p_value: bool = True) -> DataFrame:
    """U of label 1 over label 0, AUC = U/(n1*n2), tie-corrected z and one-sided p."""
    t = (F.col("pos") + F.col("neg")).cast("double")
    sums = ranked_histogram(scores, keys).groupBy(*keys).agg(
        F.max("pos_total").alias("n1"),
        F.max("neg_total").alias("n2"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = sums.select(
        *keys, "n1", "n2", "u",
        F.try_divide(F.col("u"), n1 * n2).alias("auc"),
        F.try_divide(F.col("u") - n1 * n2 / 2.0 - 0.5, spread).alias("z"),
    )
    return out.withColumn("p_value", stats.normal_upper_tail(F.col("z"))) if p_value else out


def score_distribution(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, median, quartiles and share at or above the threshold per key."""
    basic = decided.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.sum("predicted").alias("n_above"),
        F.avg("predicted").alias("frac_above"),
    )
    levels = {"q25": 0.25, "median_score": 0.5, "q75": 0.75}
    return basic.join(percentiles(decided, keys, "score", levels), list(keys))


def score_density(scores: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """Histogram density over equal bins of [0, 1]; the last bin is closed."""
    score = F.col("score").cast("double")
    bin_no = F.least(F.width_bucket(score, F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins).cast("long"))
    counts = scores.where(score.between(0.0, 1.0)).groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return counts.select(*keys, "bin", "n", (F.col("n") * float(bins) / total).alias("density"))


# ── training risks ──────────────────────────────────────────────────────────


def pu_risk(logits: DataFrame, prior: Column, propensity: str | None = None, keys: Sequence[str] = MODEL) -> DataFrame:
    """Non-negative PU risk of ``logit`` per key.

    ``propensity`` weights positives by 1/e, scaled to mean 1. With one class
    missing the plain cross-entropy is returned.
    """
    z, label = F.col("logit"), F.col("label")
    loss_up, loss_down = stats.softplus(-z), stats.softplus(z)
    pos, unl = label == 1, label == 0
    weight = F.lit(1.0) / F.col(propensity) if propensity else F.lit(1.0)

    def mean_pos(loss: Column) -> Column:
        return F.try_divide(F.sum(F.when(pos, loss * weight)), F.sum(F.when(pos, weight)))

    sums = logits.groupBy(*keys).agg(
        mean_pos(loss_up).alias("positive_risk"),
        mean_pos(loss_down).alias("positive_as_negative"),
        F.avg(F.when(unl, loss_down)).alias("unlabeled_risk"),
        F.avg(F.when(pos, loss_up).otherwise(loss_down)).alias("cross_entropy"),
        F.avg(label.cast("double")).alias("labelled_fraction"),
    )
    risk = prior * F.col("positive_risk") + F.greatest(
        F.col("unlabeled_risk") - prior * F.col("positive_as_negative"), F.lit(0.0)
    )
    complete = F.col("positive_risk").isNotNull() & F.col("unlabeled_risk").isNotNull()
    return sums.withColumn("pu_risk", F.when(complete, risk).otherwise(F.col("cross_entropy")))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (2 * n_k) per class and the labelled fraction."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = F.sum("n_class").over(W.partitionBy(F.lit(1)))  # one row per class
    return counts.select(
        label, "n_class",
        (everything / (2.0 * F.col("n_class"))).alias("class_weight"),
        (F.col("n_class") / everything).alias("class_fraction"),
    )


# ── experiment tables ───────────────────────────────────────────────────────


def ablation_table(metrics: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per condition with the AUPRC difference to the baseline condition."""
    one = F.max(F.when(F.col("condition") == baseline, F.col("auprc")))
    base = one.over(W.partitionBy(*(keys or [F.lit(1)])))  # one row per condition
    return metrics.withColumn("auprc_delta", F.col("auprc") - base)


def temporal_comparison(cells: DataFrame) -> DataFrame:
    """Deltas between (model, test split) cells of a small metric table.

    ``cells`` has trained_on and tested_on in {random, temporal}.
    """

    def cell(trained: str, tested: str, metric: str) -> Column:
        here = (F.col("trained_on") == trained) & (F.col("tested_on") == tested)
        return F.max(F.when(here, F.col(metric)))

    return cells.agg(
        (cell("temporal", "temporal", "auprc") - cell("random", "temporal", "auprc")).alias("delta_auprc"),
        (cell("temporal", "temporal", "auroc") - cell("random", "temporal", "auroc")).alias("delta_auroc"),
        (cell("random", "random", "auprc") - cell("random", "temporal", "auprc")).alias("generalization_penalty"),
    )


def leaderboard(runs: DataFrame, metric: str, tie: str) -> DataFrame:
    """Runs ranked by ``metric`` (best first) and the winner flagged; one row per run."""
    order = W.partitionBy(F.lit(1)).orderBy(F.col(metric).desc(), F.col(tie))
    return runs.withColumn("place", F.row_number().over(order)).withColumn(
        "is_best", (F.col("place") == 1).cast("int")
    )


def coefficient_ranking(coefficients: DataFrame) -> DataFrame:
    """(feature, coefficient) ranked by absolute value; one row per feature."""
    order = W.partitionBy(F.lit(1)).orderBy(F.abs("coefficient").desc(), F.col("feature"))
    return coefficients.withColumn("place", F.row_number().over(order))
