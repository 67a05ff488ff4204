"""Decision curves: net benefit over a threshold grid at deployment prevalences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import stats
from cohortlens.operators.evaluation import MODEL, histogram
from cohortlens.operators.prefix import join_parameters

# 79 thresholds 0.010, 0.015, ..., 0.400 and two prevalences.
N_THRESHOLDS = 79
DEPLOYMENTS = {"2pct": 0.02, "5pct": 0.05}


def threshold_value(i: Column) -> Column:
    return (i * 50 + 100) / F.lit(10000.0)


def thresholds_reached(prob: Column) -> Column:
    """How many grid thresholds are at or below ``prob`` (0 to 79)."""
    guess = F.floor((prob * 10000.0 - 100.0) / 50.0)
    guess = F.least(F.greatest(guess, F.lit(-1)), F.lit(N_THRESHOLDS - 1))
    fixed = (
        F.when(prob >= threshold_value(guess + 1), guess + 1)
        .when(prob >= threshold_value(guess), guess)
        .otherwise(guess - 1)
    )
    return F.least(F.greatest(fixed + 1, F.lit(0)), F.lit(N_THRESHOLDS)).cast("int")


def decision_curve(scores: DataFrame, keys: Sequence[str] = MODEL, deployments: dict[str, float] = DEPLOYMENTS) -> DataFrame:
    """Net benefit of the model and of treating all, per key, deployment and threshold.

    Scores shrink to the histogram, the histogram to at most 80 steps, and a
    window over those steps sums the hits at or above each threshold.
    """
    hist = histogram(scores, keys)
    totals = hist.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    study = F.col("_p") / (F.col("_p") + F.col("_n"))
    deployed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(p)).alias("p")) for t, p in deployments.items()])
    shifted = (
        join_parameters(hist, totals, keys)
        .withColumn("_d", F.explode(deployed))
        .withColumn("_prob", stats.prevalence_shift(F.col("score"), study, F.col("_d.p")))
    )
    steps = shifted.groupBy(*keys, F.col("_d.t").alias("deployment"), thresholds_reached(F.col("_prob")).alias("_k")).agg(
        F.sum("pos").alias("_tp"), F.sum("neg").alias("_fp")
    )
    frame = (
        totals.withColumn("deployment", F.explode(F.array(*[F.lit(t) for t in deployments])))
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(N_THRESHOLDS))))
    )
    upward = W.partitionBy(*keys, "deployment").orderBy(F.col("_k").desc())
    reached = frame.join(steps, [*keys, "deployment", "_k"], "left").select(
        *keys, "deployment", "_k", "_p", "_n",
        F.sum(F.coalesce("_tp", F.lit(0))).over(upward).alias("_tp"),
        F.sum(F.coalesce("_fp", F.lit(0))).over(upward).alias("_fp"),
    )
    threshold = threshold_value(F.col("_k") - 1)
    odds = F.col("threshold") / (1 - F.col("threshold"))
    rows = F.col("_p") + F.col("_n")
    return reached.withColumn("threshold", threshold).select(
        *keys, "deployment", "threshold",
        (F.col("_tp") / rows - F.col("_fp") / rows * odds).alias("net_benefit_model"),
        (study - (1 - study) * odds).alias("net_benefit_treatall"),
    )


def wide_curve(curve: DataFrame, keys: Sequence[str] = MODEL, deployments: dict[str, float] = DEPLOYMENTS) -> DataFrame:
    """One row per threshold with suffixed columns for every deployment."""
    columns = []
    for tag in deployments:
        for name in ("net_benefit_model", "net_benefit_treatall"):
            columns.append(F.max(F.when(F.col("deployment") == tag, F.col(name))).alias(f"{name}_{tag}"))
    return curve.groupBy(*keys, "threshold").agg(*columns)


def _shown(name: str) -> Column:
    """Curves are compared at the six decimals they are reported with."""
    return F.round(F.col(name), 6)


def dominance_ranges(curve: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Contiguous threshold ranges in which the model beats treating all."""
    group = [*keys, "deployment"]
    order = W.partitionBy(*group).orderBy("threshold")
    better = _shown("net_benefit_model") > _shown("net_benefit_treatall")
    marked = curve.select(*group, "threshold", better.alias("_b"), F.row_number().over(order).alias("_i"))
    island = F.col("_i") - F.row_number().over(order)
    return (
        marked.where("_b")
        .withColumn("_island", island)
        .groupBy(*group, "_island")
        .agg(F.min("threshold").alias("range_start"), F.max("threshold").alias("range_end"))
        .drop("_island")
    )


def peak_benefit(curve: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Largest net benefit and its first threshold."""
    place = F.struct(_shown("net_benefit_model"), -F.col("threshold"))
    return curve.groupBy(*keys, "deployment").agg(
        F.max(_shown("net_benefit_model")).alias("peak_net_benefit"),
        F.max_by("threshold", place).alias("peak_threshold"),
    )
