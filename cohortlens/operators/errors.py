"""Error profiles of false positives and false negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import demographics
from cohortlens.functions import text as tx
from cohortlens.operators.evaluation import outcome
from cohortlens.operators.prefix import key_of, percentiles

# Names of the profiled groups.
FALSE_POSITIVE, FALSE_NEGATIVE, OVERALL = "false_positive", "false_negative", "overall_test"
SHORT_NOTE = 500


def with_outcome(decided: DataFrame) -> DataFrame:
    return decided.withColumn("outcome", outcome(F.col("predicted"), F.col("label")))


def by_error_group(decided: DataFrame) -> DataFrame:
    """Every row under "overall", and errors once more under their own group."""
    cell = outcome(F.col("predicted"), F.col("label"))
    own = F.when(cell == "FP", FALSE_POSITIVE).when(cell == "FN", FALSE_NEGATIVE)
    groups = F.filter(F.array(F.lit(OVERALL), own), lambda g: g.isNotNull())
    return decided.withColumn("error_group", F.explode(groups))


def note_facts(notes: DataFrame, text: str = "note_text", key: Sequence[str] = ("hadm_id",), terms: dict[str, str] = tx.CLINICAL_TERMS, substrings: Sequence[str] = tx.TRAUMA_SUBSTRINGS) -> DataFrame:
    """note_length, note_terms (0/1 per term, in their order) and note_trauma per note.

    Joined with the decisions of all models: no text is read or moved once per model.
    """
    return tx.with_term_flags(notes, text, terms, "_flags").select(
        *key,
        F.length(text).cast("double").alias("note_length"),
        F.map_values("_flags").alias("note_terms"),
        tx.contains_any(F.col(text), substrings).cast("double").alias("note_trauma"),
    )


def _attach(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table of one row per key; missing keys are equal."""
    values = [c for c in table.columns if c not in keys]
    wanted = table.select(key_of(keys).alias("_key"), *values)
    return rows.withColumn("_key", key_of(keys)).join(wanted, "_key", "left").drop("_key")


def error_profile(decided: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Means, medians and demographic shares per key and error group.

    ``decided`` carries demographics and ``note_length``. All groups come from one pass.
    """
    rows = by_error_group(decided)
    by = [*keys, "error_group"]

    def share(condition: Column, name: str) -> Column:
        return (F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100).alias(name)

    basic = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg("note_length").alias("mean_length"),
        share(F.col("gender") == "F", "pct_female"),
        share(F.col("gender") == "M", "pct_male"),
        *[share(F.col("age_group") == a, f"pct_age_{a}") for a in demographics.AGE_BUCKETS],
        *[share(F.col("race_cat") == r, f"pct_race_{r}") for r in demographics.RACE_LABELS_SHORT.values()],
        share(F.col("is_emergency"), "pct_emergency"),
    )
    long = rows.select(*by, F.col("score").cast("double").alias("score"), F.col("note_length").alias("length"))
    long = long.unpivot(by, ["score", "length"], "measure", "x")
    medians = percentiles(long, [*by, "measure"], "x", {"median": 0.5})
    wide = medians.groupBy(*by).agg(
        F.max(F.when(F.col("measure") == "score", F.col("median"))).alias("median_score"),
        F.max(F.when(F.col("measure") == "length", F.col("median"))).alias("median_length"),
    )
    return _attach(basic, wide, by)


def term_rates(decided: DataFrame, terms: Sequence[str] = tuple(tx.CLINICAL_TERMS), keys: Sequence[str] = ("model",)) -> DataFrame:
    """Presence rate of each term of ``note_terms`` in FP, FN and all rows per key, with ratios to all."""
    flags = decided.select(*keys, outcome(F.col("predicted"), F.col("label")).alias("outcome"), F.col("note_terms").alias("_t"))
    # One row per term is formed after the flags are summed per outcome.
    per_outcome = flags.groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_t")[i]).alias(f"h_{i}") for i in range(len(terms))]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"h_{i}").alias("hits")) for i, t in enumerate(terms)])
    long = per_outcome.select(*keys, "outcome", "n", F.explode(rows).alias("r")).select(*keys, "outcome", "n", "r.*")

    def rate(condition: Column) -> Column:
        hits, size = F.sum(F.when(condition, F.col("hits"))), F.sum(F.when(condition, F.col("n")))
        return F.coalesce(F.try_divide(hits, size), F.lit(0.0))

    rates = long.groupBy(*keys, "term").agg(
        rate(F.col("outcome") == "FP").alias("fp_rate"),
        rate(F.col("outcome") == "FN").alias("fn_rate"),
        rate(F.lit(True)).alias("overall_rate"),
    )

    def over(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(name), F.col("overall_rate")), F.lit(0.0))

    return rates.withColumn("fp_over_overall", over("fp_rate")).withColumn("fn_over_overall", over("fn_rate"))


def top_terms(rates: DataFrame, n: int = 10, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The n terms with the largest ratio for FP and for FN per key (term name breaks ties)."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"{s}_over_overall").alias("ratio")) for s in ("fp", "fn")]
    )
    long = rates.withColumn("_s", F.explode(sides)).select(*keys, "_s.side", "term", "_s.ratio")
    # One row per term; nine decimals, as equal ratios of other counts differ in the last bit.
    order = W.partitionBy(*keys, "side").orderBy(F.round("ratio", 9).desc(), "term")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def criterion_signal(scored: DataFrame, criteria: Sequence[str] = tx.CRITERIA) -> DataFrame:
    """Mean score per criterion in positives and negatives, and their ratio."""
    label = F.col("label")
    score = F.col("score_by_criterion")
    sums = scored.agg(
        *[F.avg(F.when(label == 1, score[c])).alias(f"p_{c}") for c in criteria],
        *[F.avg(F.when(label == 0, score[c])).alias(f"n_{c}") for c in criteria],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("criterion"), F.col(f"p_{c}").alias("pos_mean"), F.col(f"n_{c}").alias("neg_mean"))
            for c in criteria
        ]
    )
    long = sums.select(F.explode(rows).alias("r")).select("r.*")
    return long.withColumn(
        "ratio", F.when(F.col("neg_mean") > 0, F.col("pos_mean") / F.col("neg_mean")).otherwise(F.lit(float("inf")))
    )


def false_negative_sparsity(decided: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """False negatives per key whose note is shorter than the key's first quartile, and than 500 characters.

    The rows shrink to a histogram of lengths before the quartile is joined.
    """
    length, missed = F.col("note_length"), F.coalesce(outcome(F.col("predicted"), F.col("label")) == "FN", F.lit(False))
    quartile = percentiles(decided, keys, "note_length", {"_q1": 0.25})
    hist = decided.groupBy(*keys, "note_length").agg(F.sum(missed.cast("long")).alias("_n"))

    def size(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    counted = _attach(hist, quartile, keys).groupBy(*keys).agg(
        F.sum("_n").alias("n_fn"),
        size(length < F.col("_q1")).alias("n_below_q1"),
        size(length < SHORT_NOTE).alias("n_short"),
    )
    return counted.select(
        "*",
        F.coalesce(F.try_divide("n_below_q1", "n_fn"), F.lit(0.0)).alias("share_below_q1"),
        F.coalesce(F.try_divide("n_short", "n_fn"), F.lit(0.0)).alias("share_short"),
    )


def trauma_term_share(decided: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Share of notes with ``note_trauma`` per key and error group."""
    return by_error_group(decided).groupBy(*keys, "error_group").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("note_trauma") * 100).alias("pct_with_term")
    )


def formatted_records(sample: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One text block per sampled row: a header of fields, then the note."""
    line = "-" * 70
    fields = ["subject_id", "hadm_id", "score", "label", "gender", "age_group", "race_cat"]
    head = [F.concat(F.lit(f"  {f + ':':<16}"), F.coalesce(F.col(f).cast("string"), F.lit("Unknown"))) for f in fields]
    size = F.concat(F.lit(f"  {'note_length:':<16}"), F.length("note_text").cast("string"), F.lit(" chars"))
    return sample.select(*keys, F.concat_ws("\n", F.lit(line), *head, size, F.lit(line), F.lit(""), "note_text", F.lit("")).alias("value"))
