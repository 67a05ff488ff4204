"""Aggregation of token-level attributions by section and by term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cohortlens.functions import text as tx
from cohortlens.operators import spans
from cohortlens.operators.prefix import join_parameters, percentiles

UNKNOWN = "unknown"
_OPEN = r"[\p{L}'\-]$"


def section_of(tokens: DataFrame, notes: DataFrame, note: str = "hadm_id") -> DataFrame:
    """Add ``section``: the first span that contains the token, else "unknown".

    A note carries its few spans as one array, so the range match is a filter
    on that array after one equi-join and a token never meets other spans.
    ``notes`` has one row per note with a ``spans`` column.
    """
    inside = F.filter(
        F.col("spans"),
        lambda s: (F.col("tok_start") >= s["span_start"]) & (F.col("tok_end") <= s["span_end"]),
    )
    name = F.get(inside, F.lit(0))["name"]
    return tokens.join(notes.select(note, "spans"), note, "left").withColumn(
        "section", F.coalesce(name, F.lit(UNKNOWN))
    ).drop("spans")


def by_section(tokens: DataFrame) -> DataFrame:
    """Total absolute attribution, share, token count and mean per section."""
    sums = tokens.groupBy("section").agg(
        F.sum(F.abs("value")).alias("total_attribution"), F.count(F.lit(1)).alias("n_tokens")
    )
    everything = F.sum("total_attribution").over(W.partitionBy(F.lit(1)))  # one row per section
    return sums.select(
        "section", "total_attribution",
        F.coalesce(F.try_divide(F.col("total_attribution") * 100, everything), F.lit(0.0)).alias("pct_of_total"),
        "n_tokens",
        (F.col("total_attribution") / F.col("n_tokens")).alias("mean_per_token"),
    )


def whole_words(tokens: DataFrame, note: str = "hadm_id") -> DataFrame:
    """Merge adjacent sub-spans of one word and add up their values.

    A sub-span continues the word when it starts where the previous one ended
    and the previous character is a letter, "-" or "'". Words keep two or more
    characters, all of them letters, "-" or "'". The pieces of a note are sorted,
    then merged in one pass. ``tokens`` has a row per piece, which are brought
    together by note, or a row per note with an array per column, in which the
    pieces stay.
    """
    arrays = isinstance(tokens.schema["token"].dataType, ArrayType)
    many = (lambda kind: f"array<{kind}>") if arrays else (lambda kind: kind)
    is_open = F.transform("token", lambda t: t.rlike(_OPEN)) if arrays else F.col("token").rlike(_OPEN)
    pieces = tokens.select(
        note, F.col("tok_start").cast(many("bigint")).alias("tok_start"), F.col("tok_end").cast(many("bigint")).alias("tok_end"),
        "token", F.col("value").cast(many("double")).alias("value"), is_open.alias("_open"),
    )
    if not arrays:
        pieces = pieces.repartition(note).sortWithinPartitions(note, "tok_start", "token")
    kind = tokens.schema[note].dataType.simpleString()
    merged = pieces.mapInArrow(spans.merged(note, arrays), f"`{note}` {kind}, word string, value double, word_start bigint")
    return merged.withColumn("word", F.lower("word")).where(F.col("word").rlike(r"^[\p{L}'\-]{2,}$"))


def by_term(words: DataFrame, term: str = "word", min_count: int = 3) -> DataFrame:
    """Mean, population standard deviation, count and total per frequent term."""
    return words.groupBy(term).agg(
        F.avg("value").alias("mean_attribution"),
        F.stddev_pop("value").alias("std_attribution"),
        F.count(F.lit(1)).alias("n_occurrences"),
        F.sum("value").alias("total_attribution"),
    ).where(F.col("n_occurrences") >= min_count)


def top_by_mean(terms: DataFrame, term: str = "word", k: int = 50) -> DataFrame:
    """The k terms with the largest mean; the limit is the report."""
    return terms.orderBy(F.col("mean_attribution").desc(), term).limit(k)


def top_decile(rows: DataFrame, score: str = "score", level: float = 0.9, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Rows at or above the exact percentile of their score within their key."""
    cut = percentiles(rows, list(keys), score, {"_cut": level})
    return join_parameters(rows, cut, list(keys)).where(F.col(score) >= F.col("_cut")).drop("_cut")


def windows(notes: DataFrame, text: str, length: int, stride: int, key: Sequence[str] = ("hadm_id",)) -> DataFrame:
    """One row per overlapping window of a note."""
    tokens = notes.select(*key, tx.evaluated_once(tx.words(F.col(text))).alias("_tokens"))
    parts = tx.token_windows(F.col("_tokens"), length, stride)
    return tokens.select(*key, F.explode(parts).alias("w")).select(*key, "w.*")


def pooled(scored: DataFrame, key: Sequence[str] = ("hadm_id",)) -> DataFrame:
    """Max and mean window score per note, and the first window with the best score."""
    best = F.max_by("window_no", F.struct("score", -F.col("window_no")))
    return scored.groupBy(*key).agg(
        F.max("score").alias("max_pool"),
        F.avg("score").alias("mean_pool"),
        F.count(F.lit(1)).alias("n_windows"),
        best.alias("best_window"),
    )


def score_windows(parts: DataFrame, scorer, text: str = "window_text", batch_rows: int = 512) -> DataFrame:
    """Apply a pluggable ``scorer(list[str]) -> list[float]`` in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", score double"

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                piece = batch.iloc[start : start + batch_rows]
                yield piece.assign(score=[float(v) for v in scorer(piece[text].tolist())])

    return parts.mapInPandas(run, schema)
