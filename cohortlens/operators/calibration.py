"""Reliability bins, calibration error, Platt scaling and the PU correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import stats
from cohortlens.functions.demographics import clip
from cohortlens.operators import newton
from cohortlens.operators.evaluation import MODEL, ranked_histogram
from cohortlens.operators.newton import Fitted
from cohortlens.operators.prefix import join_parameters

N_BINS = 10


def equal_width_bin(score: Column, bins: int = N_BINS) -> Column:
    """Zero-based bin whose edges are multiples of 1/bins; the last bin is closed.

    The quotient is corrected against the edges themselves, because an edge
    such as 3 * 0.1 is not the decimal 0.3.
    """
    step = 1.0 / bins
    guess = F.floor(score * bins)

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(1.0)).otherwise(i * F.lit(step))

    fixed = F.when(score < edge(guess), guess - 1).when(score >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.when(score.between(0.0, 1.0), F.least(fixed, F.lit(bins - 1)))


def equal_width_bins(scores: DataFrame, keys: Sequence[str] = MODEL, bins: int = N_BINS) -> DataFrame:
    """n, mean score and observed rate per bin; empty bins stay with nulls.

    One aggregate: each key row is expanded to all its bins afterwards.
    """
    bin_no = equal_width_bin(F.col("score").cast("double"), bins)
    filled = (
        scores.withColumn("_bin", bin_no)
        .groupBy(*keys, "_bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("score").alias("mean_predicted"),
            F.avg(F.col("label").cast("double")).alias("observed_rate"),
        )
    )
    frame = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lows = F.col("bin") / float(bins)
    return (
        frame.join(filled.withColumnRenamed("_bin", "bin"), [*keys, "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("bin_label", F.format_string("%.1f-%.1f", lows, lows + 1.0 / bins))
    )


def equal_frequency_bins(scores: DataFrame, keys: Sequence[str] = MODEL, bins: int = N_BINS) -> DataFrame:
    """Bins of floor(n/bins) rows in score order; the last bin takes the remainder.

    Rows with equal scores are ordered by label, so a histogram cell covers a
    known rank interval and is shared out between the bins it overlaps. No row
    is ranked on its own.
    """
    below = F.col("pos_below") + F.col("neg_below")
    total = F.col("pos_total") + F.col("neg_total")
    part = F.explode(
        F.array(
            F.struct(F.lit(0).alias("y"), below.alias("a"), (below + F.col("neg")).alias("b")),
            F.struct(
                F.lit(1).alias("y"),
                (below + F.col("neg")).alias("a"),
                (below + F.col("neg") + F.col("pos")).alias("b"),
            ),
        )
    )
    cells = ranked_histogram(scores, keys).select(*keys, "score", total.alias("total"), part.alias("p"))
    cells = cells.select(*keys, "score", "total", "p.*").where("b > a")
    size = F.floor(F.col("total") / bins)

    def bin_of(rank: Column) -> Column:
        return F.when(size > 0, F.least(F.floor(rank / size), F.lit(bins - 1))).otherwise(bins - 1)

    spread = cells.withColumn("i", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("b") - 1))))
    upper = F.when(F.col("i") == bins - 1, F.col("total")).otherwise((F.col("i") + 1) * size)
    inside = F.least(F.col("b"), upper) - F.greatest(F.col("a"), F.col("i") * size)
    binned = (
        spread.withColumn("c", inside)
        .groupBy(*keys, (F.col("i") + 1).alias("bin"))
        .agg(
            F.sum("c").alias("n"),
            (F.sum(F.col("c") * F.col("score")) / F.sum("c")).alias("mean_predicted"),
            (F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("observed_fraction"),
        )
    )
    low, high = stats.wilson(F.col("observed_fraction"), F.col("n"))
    return binned.withColumn("ci_lower", low).withColumn("ci_upper", high)


def expected_calibration_error(bins: DataFrame, keys: Sequence[str] = MODEL, digits: int | None = 4) -> DataFrame:
    """Weighted absolute gap over bins; bin means are rounded first when ``digits`` is set."""
    def shown(name: str) -> Column:
        return F.col(name) if digits is None else F.round(F.col(name), digits)

    gap = F.abs(shown("mean_predicted") - shown("observed_fraction"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def fit_platt(validation: DataFrame, key: str | None = "model") -> list[Fitted]:
    """Platt scaling on (score, label): one-feature logistic regression with C = 1, all models in the same passes."""
    return newton.fit_logistic(validation, ["score"], key=key)


def apply_platt(models: Sequence[Fitted], scores: DataFrame, key: str = "model") -> DataFrame:
    """Add ``calibrated``, the probability under the row's own model."""
    return newton.apply_by_key(scores, models, key, "calibrated")


def labelled_probability(validation: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """c = mean raw validation score of the labelled positives."""
    return validation.where("label = 1").groupBy(*keys).agg(F.avg("score").alias("c"))


def elkan_noto(calibrated: DataFrame, c: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Add ``corrected`` = calibrated / c, clipped to [0, 1]; ``c`` has one row per key."""
    joined = join_parameters(calibrated, c.select(*keys, "c"), keys)
    return joined.withColumn("corrected", clip(F.col("calibrated") / F.col("c"), 0.0, 1.0)).drop("c")
