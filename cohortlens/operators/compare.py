"""Aligned comparison of several models on the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import stats
from cohortlens.operators.evaluation import MODEL, clean_scores, operating_metrics, ranked_histogram
from cohortlens.operators.prefix import hash_ranks, join_parameters, key_of, prefix_sums

ROW_KEY = ["subject_id", "hadm_id"]


def align_scores(grain: DataFrame, scores: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Scores of every model on every row of ``grain``; missing and NaN become 0.

    The row key is composite: joining on the subject alone would repeat scores
    for subjects with several rows. One row per (key, model) comes out.
    """
    wide = wide_scores(scores, models, key)
    parts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"s_{m}").alias("score")) for m in models])
    return (
        grain.join(wide, list(key), "left")
        .withColumn("_m", F.explode(parts))
        .select(*grain.columns, "_m.model", F.nanvl(F.coalesce("_m.score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    )


def alignment_report(grain: DataFrame, scores: DataFrame, key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Per model: scored rows, duplicate keys, keys on the grain, stray keys."""
    per_key = scores.groupBy("model", *key).agg(F.count(F.lit(1)).alias("n"))
    marked = per_key.join(grain.select(*key).distinct().withColumn("_g", F.lit(1)), list(key), "left")
    return marked.groupBy("model").agg(
        F.sum("n").alias("scored_rows"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"),
        F.count("_g").alias("matched_keys"),
        F.count(F.when(F.col("_g").isNull(), 1)).alias("stray_keys"),
    )


def require_aligned(grain: DataFrame, scores: DataFrame, key: Sequence[str] = ROW_KEY) -> None:
    """Raise on duplicate or stray score keys (runs a job)."""
    bad = alignment_report(grain, scores, key).where("duplicate_keys > 0 OR stray_keys > 0").take(3)
    if bad:
        raise ValueError("misaligned scores: " + ", ".join(str(r.asDict()) for r in bad))


def lookup_complete(grain: DataFrame, scores: DataFrame, key: str = "subject_id") -> DataFrame:
    """One row: grain rows, rows with a score, and whether none is missing."""
    joined = grain.select(key).join(scores.select(key, "score"), key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("score").alias("n_scored"),
        F.coalesce(F.bool_and(F.col("score").isNotNull()), F.lit(False)).cast("int").alias("complete"),
    )


def lookup_scores(grain: DataFrame, scores: DataFrame, key: str = "subject_id") -> DataFrame:
    """Subject-keyed lookup, all or nothing: any missing score voids them all."""
    missing = grain.select(key).join(scores.where("score IS NOT NULL").select(key), key, "left_anti").limit(1)
    void = missing.agg(F.count(F.lit(1)).alias("_void"))
    joined = grain.join(scores.select(key, "score"), key, "left")
    # ``void`` is a single row, read as a scalar.
    return joined.withColumn("score", F.when(void.select("_void").scalar() == 0, F.col("score")))


def wide_scores(scores: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY) -> DataFrame:
    """One row per key with a column ``s_<model>`` per declared model."""
    return scores.groupBy(*key).agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"s_{m}") for m in models]
    )


def _pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(models, 2))


def wide_decisions(decided: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Label, score and decision of every model side by side; missing scores are 0."""
    columns = [F.max("label").alias("label")]
    for m in models:
        here = F.col("model") == m
        columns.append(F.coalesce(F.max(F.when(here, F.col("score"))), F.lit(0.0)).alias(f"s_{m}"))
        columns.append(F.coalesce(F.max(F.when(here, F.col("predicted"))), F.lit(0)).alias(f"d_{m}"))
    return decided.groupBy(*key).agg(*columns)


def pair_tests(decided: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY, p_value: bool = True) -> DataFrame:
    """McNemar, agreement, kappa and score correlation for all model pairs.

    Models sit side by side in one row per key, so the pairs are expressions
    of a single aggregate and no self join is needed.
    """
    wide = wide_decisions(decided, models, key)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for a, b in _pairs(models):
        da, db, y = F.col(f"d_{a}"), F.col(f"d_{b}"), F.col("label")
        tag = f"{a}__{b}"
        aggregates += [
            F.count(F.when((da == y) & (db != y), 1)).alias(f"b_{tag}"),
            F.count(F.when((da != y) & (db == y), 1)).alias(f"c_{tag}"),
            F.count(F.when(da == db, 1)).alias(f"e_{tag}"),
            # ``corr`` fails on a constant column when ANSI mode is on.
            F.try_divide(
                F.covar_pop(f"s_{a}", f"s_{b}"), F.stddev_pop(f"s_{a}") * F.stddev_pop(f"s_{b}")
            ).alias(f"r_{tag}"),
        ]
    aggregates += [F.sum(f"d_{m}").alias(f"pos_{m}") for m in models]
    sums = wide.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"),
                F.lit(b).alias("model_b"),
                F.col(f"b_{a}__{b}").alias("b_only_a_correct"),
                F.col(f"c_{a}__{b}").alias("c_only_b_correct"),
                F.col(f"e_{a}__{b}").alias("equal"),
                F.col(f"r_{a}__{b}").alias("pearson_r"),
                F.col(f"pos_{a}").alias("pos_a"),
                F.col(f"pos_{b}").alias("pos_b"),
            )
            for a, b in _pairs(models)
        ]
    )
    pairs = sums.select("n", F.explode(rows).alias("p")).select("n", "p.*")
    b, c, n = F.col("b_only_a_correct"), F.col("c_only_b_correct"), F.col("n").cast("double")
    chi2 = F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2.0)), (b + c).cast("double"))
    observed = F.col("equal") / n
    chance = (F.col("pos_a") * F.col("pos_b") + (n - F.col("pos_a")) * (n - F.col("pos_b"))) / (n * n)
    out = pairs.select(
        "model_a", "model_b", "b_only_a_correct", "c_only_b_correct",
        F.coalesce(chi2, F.lit(0.0)).alias("chi2"),
        (observed * 100).alias("agreement_pct"),
        F.try_divide(observed - chance, 1 - chance).alias("cohens_kappa"),
        "pearson_r",
    )
    if not p_value:
        return out
    p = F.when(b + c > 0, stats.chi2_1df_upper_tail(F.col("chi2"))).otherwise(1.0)
    return out.withColumn("mcnemar_p", p)


def top_share(scores: DataFrame, keys: Sequence[str] = MODEL, key: Sequence[str] = ROW_KEY, parts: int = 5, seed: int = 42) -> DataFrame:
    """The highest floor(n/parts) rows per model (at least one).

    The histogram gives the boundary score and how many of its rows still fit;
    only those tied rows are ordered, by the hash of their key.
    """
    n = F.col("_n_below") + F.col("_n")
    hist = scores.groupBy(*keys, F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("_n"))
    cells = prefix_sums(hist, keys, "score", ["_n"])
    wanted = F.greatest(F.floor(F.col("_n_total") / parts), F.lit(1))
    above = F.col("_n_total") - n
    boundary = cells.where((above < wanted) & (wanted <= above + F.col("_n"))).select(
        *keys, F.col("score").alias("_edge"), (wanted - above).alias("_room"), wanted.alias("top_size")
    )
    placed = join_parameters(scores, boundary, keys)
    sure = placed.where(F.col("score") > F.col("_edge"))
    tied = hash_ranks(placed.where(F.col("score") == F.col("_edge")), keys, key, seed).where("hash_rank <= _room")
    columns = [*scores.columns, "top_size"]
    return sure.select(*columns).unionByName(tied.select(*columns))


def top_overlap(scores: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY, parts: int = 5) -> DataFrame:
    """Shared part of the top rows for all model pairs: fraction and Jaccard."""
    top = top_share(scores, MODEL, key, parts)
    wide = top.groupBy(*key).agg(
        *[F.max((F.col("model") == m).cast("int")).alias(f"t_{m}") for m in models]
    )
    sums = wide.agg(
        *[F.sum(f"t_{m}").alias(f"k_{m}") for m in models],
        *[F.sum(F.col(f"t_{a}") * F.col(f"t_{b}")).alias(f"both_{a}__{b}") for a, b in _pairs(models)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"),
                F.lit(b).alias("model_b"),
                F.col(f"k_{a}").alias("top_size"),
                (F.col(f"both_{a}__{b}") / F.col(f"k_{a}")).alias("overlap_fraction"),
                (
                    F.col(f"both_{a}__{b}")
                    / (F.col(f"k_{a}") + F.col(f"k_{b}") - F.col(f"both_{a}__{b}"))
                ).alias("overlap_jaccard"),
            )
            for a, b in _pairs(models)
        ]
    )
    return sums.select(F.explode(rows).alias("p")).select("p.*")


def rank_normalised(scores: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Add ``rank_pct``: average rank of the score divided by n, per model."""
    n = F.col("pos") + F.col("neg")
    below, total = F.col("pos_below") + F.col("neg_below"), F.col("pos_total") + F.col("neg_total")
    pct = (below + (n + 1) / 2.0) / total
    place = key_of([*keys, "score"])
    ranks = ranked_histogram(scores, keys).select(place.alias("_place"), pct.alias("rank_pct"))
    return clean_scores(scores).withColumn("_place", place).join(ranks, "_place").drop("_place")


def rank_ensembles(scores: DataFrame, models: Sequence[str], key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Max and mean of the rank-normalised scores as two further models."""
    ranked = rank_normalised(scores)
    wide = ranked.groupBy(*key).agg(
        F.max("label").alias("label"),
        *[F.max(F.when(F.col("model") == m, F.col("rank_pct"))).alias(f"p_{m}") for m in models],
    )
    columns = [F.col(f"p_{m}") for m in models]
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    both = F.array(
        F.struct(F.lit("ensemble_max").alias("model"), F.greatest(*columns).alias("score")),
        F.struct(F.lit("ensemble_mean").alias("model"), (total / float(len(models))).alias("score")),
    )
    return wide.withColumn("_e", F.explode(both)).select("_e.model", *key, "label", "_e.score")


def beats_best(metrics: DataFrame, ensembles: Sequence[str] = ("ensemble_max", "ensemble_mean")) -> DataFrame:
    """Flag ensembles whose AUPRC exceeds the best single model (one row per model)."""
    single = F.when(~F.col("model").isin(list(ensembles)), F.col("auprc"))
    best = F.max(single).over(W.partitionBy(F.lit(1)))
    return metrics.withColumn("best_individual", best).withColumn(
        "beats_best", (F.col("model").isin(list(ensembles)) & (F.col("auprc") > best)).cast("int")
    )


def subgroup_nns(decided: DataFrame, keys: Sequence[str], prevalences: Sequence[float] = (0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """Number needed to screen per key and prevalence, one column per prevalence.

    Single-class subgroups are left out.
    """
    metrics = operating_metrics(decided, keys).where("tp + fn > 0 AND fp + tn > 0")
    nns = [
        stats.number_needed(stats.ppv(F.col("sensitivity"), F.col("specificity"), F.lit(p), stats.EPS)).alias(
            f"nns_{int(p * 100)}pct"
        )
        for p in prevalences
    ]
    return metrics.select(
        *keys,
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("n_pos"),
        "sensitivity", "specificity", *nns,
    )
