"""Subgroup metrics, fairness tables and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import demographics, stats
from cohortlens.operators.cohort import first_rows
from cohortlens.operators.draws import CHUNK, MODULUS, MULTIPLIER, block_terms, block_totals, poisson_limits  # noqa: F401 (the SQL check reads them here)
from cohortlens.operators.evaluation import clean_scores, rank_metrics
from cohortlens.operators.prefix import hash_key, key_of, prefix_sums
from cohortlens.session import materialise

# Grouping name and its column.
GROUPINGS = {
    "sex": "gender",
    "age_group": "age_group",
    "race": "race_cat",
    "race_binary": "race_binary",
    "emergency": "is_emergency",
}
SUBGROUP = ["model", "group", "value"]
N_BOOTSTRAP = 1000
SEED = 42
RELIABLE_WIDTH = 0.15


def attach_demographics(rows: DataFrame, admissions: DataFrame) -> DataFrame:
    """Demographics of each subject's earliest admission among the evaluated ones.

    Ties on time take the smallest hadm_id; subjects without one get defaults.
    """
    used = admissions.join(rows.select("hadm_id").distinct(), "hadm_id", "left_semi")
    columns = ["gender", "race", "age_at_admission", "admission_type"]
    first = first_rows(used, "subject_id", "admittime", "hadm_id", columns)
    profile = first.select(
        "subject_id",
        F.coalesce("gender", F.lit("Unknown")).alias("gender"),
        demographics.race_category(F.col("race")).alias("race_cat"),
        demographics.age_bucket(F.col("age_at_admission")).alias("age_group"),
        demographics.is_emergency(F.col("admission_type")).alias("is_emergency"),
    )
    joined = rows.join(profile, "subject_id", "left")
    defaults = {"gender": "Unknown", "race_cat": "Other/Unknown", "age_group": "Other"}
    return (
        joined.fillna(defaults)
        .withColumn("is_emergency", F.coalesce("is_emergency", F.lit(False)))
        .withColumn("race_binary", demographics.binary_race(F.col("race_cat")))
    )


def by_subgroup(rows: DataFrame, groupings: dict[str, str] = GROUPINGS) -> DataFrame:
    """Each row once per grouping, as (group, value): all groupings in one pass."""
    parts = F.array(
        *[F.struct(F.lit(g).alias("group"), F.col(c).cast("string").alias("value")) for g, c in groupings.items()]
    )
    kept = [c for c in rows.columns if c not in groupings.values()]
    return rows.withColumn("_g", F.explode(parts)).select(*kept, "_g.group", "_g.value")


def subgroup_metrics(rows: DataFrame, groupings: dict[str, str] = GROUPINGS) -> DataFrame:
    """AUPRC and AUROC per subgroup; null where only one class is present."""
    return rank_metrics(by_subgroup(rows, groupings), SUBGROUP)


def fairness_table(decided: DataFrame, groupings: dict[str, str] = GROUPINGS, keys: Sequence[str] = SUBGROUP) -> DataFrame:
    """Calibration in the large with Wilson interval, recall and AUPRC per subgroup.

    Figures are null for single-class subgroups.
    """
    grouped = by_subgroup(decided, groupings)
    label = F.col("label").cast("double")
    tp = F.count(F.when((F.col("predicted") == 1) & (F.col("label") == 1), 1))
    pos = F.count(F.when(F.col("label") == 1, 1))
    basic = grouped.groupBy(*keys).agg(
        (F.avg("score") - F.avg(label)).alias("_cal"),
        F.avg(label).alias("_obs"),
        stats.ratio(tp, pos).alias("_recall"),
    )
    table = rank_metrics(grouped, keys).join(basic, list(keys))
    mixed = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    low, high = stats.wilson(F.col("_obs"), F.col("n"))
    return table.select(
        *keys, "n", "n_pos",
        F.when(mixed, F.col("_cal")).alias("calibration_in_large"),
        F.when(mixed, low).alias("cal_ci_lo"),
        F.when(mixed, high).alias("cal_ci_hi"),
        F.when(mixed, F.col("_recall")).alias("recall_at_threshold"),
        "auprc",
    )


def equal_opportunity(table: DataFrame, keys: Sequence[str] = ("model", "group")) -> DataFrame:
    """Recall gap between the best and worst value of each grouping (two or more values)."""
    recall = F.col("recall_at_threshold")
    gaps = table.groupBy(*keys).agg(
        F.count(recall).alias("n_values"), (F.max(recall) - F.min(recall)).alias("eo_diff")
    )
    return gaps.where("n_values >= 2")


# ── bootstrap ───────────────────────────────────────────────────────────────


#: Rows of a block of neighbouring scores; a score that more rows share is a block of its own.
BLOCK_ROWS = 8192


def _blocks(scores: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(_key, score, _b, _pieces, _hot) per distinct score and (_key, _order, _hot, _b) per block.

    Blocks ascend within a key by ``_order``. A score that is a block of its own
    is hot and counted in pieces of about ``BLOCK_ROWS`` rows. Scores without
    any label are left out.
    """
    hist = clean_scores(scores).groupBy(*keys, "score").agg(F.count("label").alias("_labelled"), F.count(F.lit(1)).alias("_rows"))
    hist = hist.where("_labelled > 0").drop("_labelled").withColumn("_hot", (F.col("_rows") > BLOCK_ROWS).cast("long"))
    order = F.col("_hot_below") * 2**40 + F.col("_hot") * 2**39 + F.floor(F.col("_rows_below") / BLOCK_ROWS)
    pieces = F.when(F.col("_hot") == 1, F.ceil(F.col("_rows") / BLOCK_ROWS)).otherwise(1)
    cells = prefix_sums(hist, keys, "score", ["_rows", "_hot"])
    cells = cells.select(key_of(keys).alias("_key"), "score", pieces.alias("_pieces"), F.col("_hot") == 1, order.alias("_order"))
    cells = materialise(cells.toDF("_key", "score", "_pieces", "_hot", "_order"), "cells")
    blocks = cells.select("_key", "_order", "_hot").distinct().withColumn("_b", F.monotonically_increasing_id())
    blocks = materialise(blocks, "blocks")
    return cells.join(blocks.drop("_hot"), ["_key", "_order"]).drop("_order"), blocks


def bootstrap_auprc(
    scores: DataFrame, keys: Sequence[str] = SUBGROUP, replicates: int = N_BOOTSTRAP, seed: int = SEED, row: Sequence[str] = ("hadm_id",)
) -> DataFrame:
    """Percentile interval of AUPRC per key from Poisson bootstrap replicates.

    Each row is taken Poisson(1) times; ``row`` tells the rows of a key apart.
    Replicates with one class are skipped; the interval ends are order
    statistics of the rest. Scores are cut into blocks. A first pass keeps block
    totals, whose running sums say what lies above each block; the second
    repeats the same draws and adds the running sums inside the block. Scores
    that many rows share need no second pass and are counted in pieces, so no
    task holds more than two blocks' rows at a time. Both passes move each row
    once, to its block, and draw there: what is written grows with the rows,
    not with the draws. Tables that grow with the scores are never broadcast.
    """
    keys, chunks, spark = list(keys), -(-replicates // CHUNK), scores.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells, blocks = _blocks(scores, keys)
    start = F.conv(F.substring(hash_key([*keys, *row], seed), 1, 8), 16, 10).cast("long") % (MODULUS - 1) + 1
    positive = F.coalesce(F.col("label") == 1, F.lit(False))
    rows = clean_scores(scores).select(key_of(keys).alias("_key"), "score", positive.alias("_y"), start.alias("_x"))
    rows = rows.join(cells.hint("merge"), ["_key", "score"])
    # Any piece will do, as totals are added up; stored, so both passes see the same.
    piece = F.monotonically_increasing_id() % F.col("_pieces")
    rows = materialise(rows.select("_b", piece.alias("_piece"), "_hot", "score", "_y", "_x"), "rows")

    names = [f"{n}{j}" for j in range(CHUNK) for n in ("_p", "_a")]
    schema = "_b bigint, _chunk bigint, "
    drawn = rows.select("_b", "_piece", "_y", "_x").repartition(tasks, "_b", "_piece").groupBy("_b", "_piece")
    totals = drawn.applyInArrow(block_totals(chunks), schema + ", ".join(f"{c} bigint" for c in names))
    totals = totals.groupBy("_b", "_chunk").agg(*[F.sum(c).alias(c) for c in names]).join(blocks, "_b")
    totals = materialise(totals, "totals")
    higher = W.partitionBy("_key", "_chunk").orderBy(F.desc("_order")).rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("*", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}a") for c in names])
    ahead = materialise(ahead, "ahead")

    inside = rows.where("NOT _hot").select("_b", "score", "_y", "_x").repartition(tasks, "_b").groupBy("_b")
    above = ahead.where("NOT _hot").select("_b", "_chunk", *[f"{c}a" for c in names]).repartition(tasks, "_b").groupBy("_b")
    terms = inside.cogroup(above).applyInArrow(block_terms(chunks), schema + ", ".join(f"_s{j} double" for j in range(CHUNK)))

    def term(j: int) -> Column:
        """Positives drawn at a hot score times the precision there."""
        p, seen = F.col(f"_p{j}"), F.col(f"_a{j}a") + F.col(f"_a{j}")
        return F.when(p > 0, p * (F.col(f"_p{j}a") + p) / seen).otherwise(0.0)

    own = ahead.where("_hot").select("_b", "_chunk", *[term(j).alias(f"_s{j}") for j in range(CHUNK)])
    whole = totals.join(terms.unionByName(own).hint("merge"), ["_b", "_chunk"])

    def replicate(j: int) -> Column:
        p, n = F.sum(f"_p{j}"), F.sum(f"_a{j}") - F.sum(f"_p{j}")
        return F.when((p > 0) & (n > 0) & (F.col("_chunk") * CHUNK + j < replicates), F.sum(f"_s{j}") / p)

    each = whole.groupBy("_key", "_chunk").agg(F.array(*[replicate(j) for j in range(CHUNK)]).alias("_v"))
    values = F.sort_array(F.filter(F.flatten(F.collect_list("_v")), lambda v: v.isNotNull()))  # ``replicates`` values per key
    bounds = each.groupBy("_key").agg(values.alias("_v"))
    size = F.size("_v")

    def place(share: float) -> Column:
        return F.get(F.col("_v"), F.floor(size * F.lit(share)).cast("int"))

    return bounds.where(size > 0).select(
        *[F.col(f"_key.{k}") for k in keys], size.cast("long").alias("n_valid"), place(0.025).alias("auprc_ci_lo"), place(0.975).alias("auprc_ci_hi")
    )


def with_intervals(table: DataFrame, intervals: DataFrame, keys: Sequence[str] = SUBGROUP) -> DataFrame:
    """Fairness table with interval, width and the reliability flag."""
    width = F.col("auprc_ci_hi") - F.col("auprc_ci_lo")
    joined = table.join(intervals.drop("n_valid"), list(keys), "left")
    return joined.withColumn("auprc_ci_width", width).withColumn(
        "auprc_reliable", F.coalesce(width < RELIABLE_WIDTH, F.lit(False))
    )

