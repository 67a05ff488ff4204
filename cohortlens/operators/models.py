"""Linear models: selection, propensity, attribution, text features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.demographics import clip
from cohortlens.operators import newton, terms
from cohortlens.operators.evaluation import rank_metrics
from cohortlens.operators.newton import Fitted
from cohortlens.operators.prefix import hash_ranks, join_parameters
from cohortlens.session import materialise

# Inverse penalties to try, and the propensity range.
C_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
PROPENSITY_RANGE = (0.05, 0.95)
MISSING_PROPENSITY = 0.5


def balanced(rows: DataFrame) -> DataFrame:
    """Add ``weight`` = n / (2 * n_k) of the row's class."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("p")
    )
    share = counts.select(F.try_divide(F.col("p"), F.col("n")).alias("s")).scalar()
    return rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def score(model: Fitted, rows: DataFrame) -> DataFrame:
    """Add ``score``, the positive-class probability, and ``logit``: two columns over the features."""
    return rows.withColumn("logit", model.logit()).withColumn("score", model.probability())


def sweep_c(train: DataFrame, validation: DataFrame, columns: Sequence[str], grid: Sequence[float] = C_GRID):
    """Fit one balanced model per C; return the best by AUPRC and the score table.

    All penalties take their Newton steps together, so a step is one pass over
    ``train``. The validation rows are scored by all models in one pass, on the
    linear score: probabilities close to 0 or 1 would tie.
    """
    models = newton.fit_logistic(balanced(train), columns, grid, weight="weight")
    each = F.explode(F.array(*[F.struct(F.lit(m.c).alias("c"), m.logit().alias("score")) for m in models]))
    scored = validation.select("label", each.alias("m")).select("m.c", "label", "m.score")
    results = materialise(rank_metrics(scored, ["c"]).select("c", "n", "n_pos", "auprc", "auroc"), "sweep")
    best = min(results.collect(), key=lambda r: (r.auprc is None, -(r.auprc or 0.0), r.c))  # one row per C
    return next(m for m in models if m.c == best.c), results


def propensities(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clipped P(coded | features) per subject."""
    (model,) = newton.fit_logistic(features, columns)
    return features.select("subject_id", clip(model.probability(), *PROPENSITY_RANGE).alias("propensity"))


def attach_propensity(rows: DataFrame, estimated: DataFrame) -> DataFrame:
    """Propensity per row; subjects without one get the default."""
    return rows.join(estimated, "subject_id", "left").fillna(MISSING_PROPENSITY, ["propensity"])


def linear_attribution(rows: DataFrame, table: DataFrame, columns: Sequence[str], key: Sequence[str] = ("subject_id",)) -> DataFrame:
    """coefficient * value per row and feature: the attribution of a linear score.

    ``table`` is (feature, coefficient), one row per feature.
    """
    cast = rows.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = cast.unpivot(list(key), [f"`{c}`" for c in columns], "feature", "x")
    return join_parameters(long, table, ["feature"]).select(
        *key, "feature", (F.col("coefficient") * F.col("x")).alias("value")
    )


# ── text features ───────────────────────────────────────────────────────────


def text_words(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _words): each note's words of two or more characters, lower case; a missing text has no list."""
    return notes.select(key, F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w{2,}"), 0).alias("_words"))


def _kind(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def text_counts(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): each note's words of two or more characters and adjacent pairs, counted, lower case.

    A note is counted in its own row, so no text or token is shuffled. A
    missing text has no list.
    """
    words = text_words(notes, key, text)
    return words.mapInArrow(terms.counted(key), f"{_kind(words, key)}, terms array<struct<term: string, tf: int>>")


def vocabulary(counts: DataFrame, key: str, max_features: int) -> DataFrame:
    """(term, df, idx) of the terms with the highest total count; ties go by the hash of the term.

    ``counts`` holds the terms of ``text_counts`` or the words of ``text_words``.
    The histogram of counts gives the count at the boundary and how many of its
    terms still fit; only those are ranked, in even slices of their hashes. No
    task sorts the terms.
    """
    column, count = ("terms", terms.totals) if "terms" in counts.columns else ("_words", terms.word_totals)
    parts = counts.select(column).mapInArrow(count, "term string, cf bigint, df bigint")
    totals = materialise(parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), "terms")
    hist = totals.groupBy("cf").agg(F.count(F.lit(1)).alias("n"))
    # Different counts are at most the root of twice the tokens: a window over them is small for any corpus.
    upto = F.sum("n").over(W.orderBy(F.desc("cf")))
    edge = hist.select("cf", upto.alias("upto"), (F.lit(max_features) - upto + F.col("n")).alias("room")).where(F.col("upto") >= max_features)
    edge = edge.agg(F.max(F.struct("cf", "room")).alias("e")).select("e.*").first()
    kept = totals.where(F.col("cf") > (edge.cf or 0)).select("term", "df")
    if edge.cf is not None:
        tied = hash_ranks(totals.where(F.col("cf") == edge.cf), [], ["term"]).where(F.col("hash_rank") <= edge.room)
        kept = kept.unionByName(tied.select("term", "df"))
    place = F.row_number().over(W.orderBy("term"))  # at most ``max_features`` rows
    return materialise(kept.select("term", "df", (place - 1).alias("idx")), "vocabulary")


def _texts_of_key(words: DataFrame, key: str) -> DataFrame:
    """(key, texts): per row of ``words``, the words of each row of its key; a row without a key has none."""
    none = F.array().cast("array<array<string>>")
    own = words.select(key, F.when(F.col(key).isNotNull() & F.col("_words").isNotNull(), F.array("_words")).otherwise(none).alias("texts"))
    again = words.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    again = materialise(again, "repeated")
    if again.isEmpty():
        return own
    together = own.join(again, key, "left_semi").groupBy(key).agg(F.flatten(F.collect_list("texts")).alias("_all"))
    return own.join(together, key, "left").select(key, F.coalesce("_all", "texts").alias("texts"))


def text_vectors(notes: DataFrame, key: str, text: str, max_features: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Sparse unit vectors (key, idx, val) of the notes, and the vocabulary (term, df, idx).

    tf = 1 + ln(count), idf = 1 + ln((1 + n) / (1 + df)). A note without a term of
    the vocabulary has an empty vector. ``key`` is unique. The vocabulary, at most
    ``max_features`` rows, goes to every task, so no term of a note is shuffled.
    """
    found = materialise(text_words(notes, key, text), "words")
    words = vocabulary(found, key, max_features)
    n = float(found.count())
    known = words.select("term", "df", "idx").toArrow().sort_by("idx")
    idf = 1 + np.log((1 + n) / (1 + known["df"].to_numpy()))
    weigh = terms.weighted(key, known["term"].combine_chunks(), idf)
    return _texts_of_key(found, key).mapInArrow(weigh, f"{_kind(found, key)}, idx array<int>, val array<double>"), words


def tfidf(notes: DataFrame, key: str, text: str, max_features: int = 50_000) -> DataFrame:
    """(key, term, weight): sublinear tf, smoothed idf, unit length per note."""
    vectors, words = text_vectors(notes, key, text, max_features)
    long = vectors.select(key, F.explode(F.arrays_zip("idx", "val")).alias("e")).select(key, "e.idx", F.col("e.val").alias("weight"))
    return join_parameters(long, words.select("idx", "term"), ["idx"]).select(key, "term", "weight")


def vector_attribution(vectors: DataFrame, key: str, words: DataFrame, table: DataFrame) -> DataFrame:
    """(key, term, value): coefficient * value of each term of sparse text vectors.

    ``table`` is (term, coefficient), one row per term; terms without a coefficient are left out.
    """
    named = words.select("term", "idx").join(table.select("term", "coefficient"), "term").select("idx", "term", "coefficient")
    long = vectors.select(key, F.explode(F.arrays_zip("idx", "val")).alias("e")).select(key, "e.idx", "e.val")
    # A vocabulary is bounded: its join spreads it, and the entries stay where they are.
    return join_parameters(long, F.broadcast(named), ["idx"]).select(key, "term", (F.col("coefficient") * F.col("val")).alias("value"))


def term_odds(rows: DataFrame) -> DataFrame:
    """Smoothed log odds of each term between the classes, from rows (label, term, present)."""
    label, present = F.col("label"), F.col("present")
    share = lambda k, n: F.log((F.sum(k) + 1) / (F.sum(n) + F.lit(2.0)))
    odds = share(present * label, label) - share(present * (1 - label), 1 - label)
    return rows.groupBy("term").agg(odds.alias("log_odds"))


def term_scores(rows: DataFrame, odds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the log odds of the terms present, per key."""
    joined = join_parameters(rows, odds, ["term"])
    return joined.groupBy(*keys).agg(F.sum(F.col("present") * F.col("log_odds")).alias("score"))
