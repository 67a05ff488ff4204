"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Text statistics are counted in the row. For each language and source the
minimum covariance determinant is estimated: starting from all rows and from two
hashed halves, concentration steps keep the three quarters of the rows that lie
nearest and estimate centre and scatter from them; of the three ends the
smallest determinant counts. A row is rejected if its Mahalanobis distance
exceeds a chi-square quantile.

Transformed statistics are whole numbers (4096ths), so the sums behind the
estimates do not depend on the order of the rows. The nearest three quarters are
found by a histogram of log distances, so no group is sorted or gathered.
A fixed least spread is added to each statistic's variance: where nearly all rows
agree, or a group is small, little differences do not make a row an outlier.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, ready

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
UNIT = 4096
_PLACE = 26  # low bits of a composite that hold a window's place
_FILES = 4  # of an estimate


@dataclass(frozen=True)
class Rules:
    """Base limits, the share of rows in the core, its steps, the tail to reject, and the least spreads."""

    least_words: int = 50
    most_repeats_percent: int = 50
    core: float = 0.75
    steps: int = 4
    tail: float = 1e-5
    spreads: tuple[float, ...] = (1.0, 0.1, 0.4, 0.5, 0.8)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.columns
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    n = F.size("_words")
    # A window is the hash of its three words; a composite is the hash's upper bits and the window's place.
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    out = out.withColumn("_hash", F.coalesce(windows, F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_hash")) < F.size("_hash")
    upper = F.lit(-1 << _PLACE)
    lower = F.lit((1 << _PLACE) - 1)
    composite = F.transform("_hash", lambda x, i: x.bitwiseAND(upper).bitwiseOR(i.cast("long")))
    out = out.withColumn("_sorted", F.when(again, F.sort_array(composite)).otherwise(F.array().cast("array<bigint>")))

    def beside(array: str, of) -> Column:
        def near(x: Column, i: Column) -> Column:
            before = (i > 0) & (of(F.get(array, i - 1)) == of(x))
            return F.coalesce(before, F.lit(False)) | F.coalesce(of(F.get(array, i + 1)) == of(x), F.lit(False))

        return F.filter(array, near)

    # Equal upper bits beside each other: every repeated window, and rarely others; full hashes then decide.
    out = out.withColumn("_near", beside("_sorted", lambda x: x.bitwiseAND(upper)))
    place = lambda x: x.bitwiseAND(lower).cast("int")
    full = F.sort_array(F.transform("_near", lambda x: F.struct(F.get("_hash", place(x)).alias("h"), place(x).alias("p"))))
    out = out.withColumn("_full", full)
    out = out.withColumn("_twice", beside("_full", lambda x: x["h"]))
    out = out.withColumn("_at", F.sort_array(F.transform("_twice", lambda x: x["p"])))
    covered = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))))
    repeats = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    """Log length, log word length, and log percentages of symbols, repeated lines and repeated words."""
    rate = lambda part, whole: F.log1p(F.lit(100.0) * F.col(part) / F.col(whole))
    raw = [
        F.log(F.col("n_words").cast("double")),
        F.log(F.col("word_chars") / F.col("n_words")),
        rate("n_symbols", "word_chars"),
        rate("n_dup_lines", "n_words"),
        rate("n_repeat_words", "n_words"),
    ]
    return [F.round(x * UNIT).cast("long") for x in raw]


def _cdf(x: float, k: int) -> float:
    """Chi-square distribution function with k degrees of freedom (cube-root approximation)."""
    return NormalDist().cdf(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / (2 / (9 * k)) ** 0.5)


def _quantile(p: float, k: int) -> float:
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def _estimates(sums: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """Centre, Cholesky factor of the scatter and its log determinant from sums per key."""
    p = len(rules.spreads)
    shrink = rules.core / _cdf(_quantile(rules.core, p), p + 2)  # a normal core's scatter is too small by this
    out = sums
    for i in range(p):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(p):
        for j in range(i + 1):
            least = F.lit((rules.spreads[i] * UNIT) ** 2 if i == j else 0.0)
            moment = (F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"m{j}")) * F.lit(shrink)
            rest = moment / F.col("n") + least
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    logdet = sum((F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0))
    names = [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    return out.select(*keys, *names, logdet.alias("logdet"))


def _with_distance(rows: DataFrame, p: int) -> DataFrame:
    """Adds the squared Mahalanobis distance d2 by forward substitution."""
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0)))


_HALF = 20  # products are summed in two parts, so that no number of rows makes a sum too long for 64 bits


def _sums(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Count, sums and sums of products per key; the sums are exact before they become doubles."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    parts = [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)]
    for i, j in pairs:
        product = F.col(f"x{i}") * F.col(f"x{j}")
        parts.append(F.sum(F.shiftright(product, _HALF)).alias(f"high{i}{j}"))
        parts.append(F.sum(product.bitwiseAND(F.lit((1 << _HALF) - 1))).alias(f"low{i}{j}"))
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    whole = [(wide(f"high{i}{j}") * F.lit(1 << _HALF) + wide(f"low{i}{j}")).cast("double").alias(f"s{i}{j}") for i, j in pairs]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(*keys, "n", *[f"s{i}" for i in range(p)], *whole)


def _stored(table: DataFrame, name: str) -> DataFrame:
    """A table of a row per key, in a few files: its size on disk then shows that it is small, and few tasks write."""
    return materialise(table.repartition(_FILES), name)


def judge(docs: DataFrame, rules: Rules | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): statistics, base_failed, distance, kept.

    A null or empty text has no words and fails the base limits; such rows take no
    part in the estimates. A null language or source is a value of its own.
    Repeated rows and rows without doc_id are judged like others. Columns named in
    ``carried`` come along row by row; others are not read. No rows give no rows.
    """
    rules = rules or Rules()
    ready(docs.sparkSession)
    p = len(rules.spreads)
    rows = with_statistics(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", *carried)).drop("text")
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeats_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumns({f"x{i}": F.when(~F.col("base_failed"), x) for i, x in enumerate(_features())})
    # The group's key is free of nulls: a length before each value keeps values and nulls apart.
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    rows = rows.withColumn("grp", F.concat(part(F.col("lang")), part(F.col("source")))).drop("lang", "source")
    rows = materialise(rows, "statistics")

    xs = [f"x{i}" for i in range(p)]
    sound = rows.where("not base_failed").select("grp", *xs, F.xxhash64("doc_id", *xs).alias("spot"))
    starts = F.array(F.lit(0), F.lit(1), F.lit(2))
    sound = sound.withColumn("start", F.explode(starts)).select("grp", "start", "spot", *xs)
    keys = ["grp", "start"]
    core = sound.where("start = 0 or (shiftrightunsigned(spot, start) & 1) = 0")
    fit = _stored(_estimates(_sums(core, keys, p), keys, rules), "fit-0")
    names = [c for c in fit.columns if c not in (*keys, "logdet")]
    cell = F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * 64).cast("int")
    all_cells = W.partitionBy(*keys)
    for step in range(1, rules.steps + 1):
        near = _with_distance(sound.join(fit, keys), p).withColumn("cell", cell)
        counts = near.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("k"))
        below = counts.withColumn("upto", F.sum("k").over(all_cells.orderBy("cell"))).withColumn("size", F.sum("k").over(all_cells))
        edge = below.where(F.col("upto") >= F.col("size") * F.lit(rules.core)).groupBy(*keys).agg(F.min("cell").alias("edge"))
        # The edge goes to the rows with the fit, which is small, so no row moves to its group.
        edged = _stored(fit.join(edge, keys), f"edge-{step}")
        core = _with_distance(sound.join(edged, keys), p).withColumn("cell", cell).where("cell <= edge")
        fit = _stored(_estimates(_sums(core, keys, p), keys, rules), f"fit-{step}")
    best = fit.groupBy("grp").agg(F.min(F.struct("logdet", "start", *names)).alias("b")).select("grp", *[F.col(f"b.{c}") for c in names])
    far = _with_distance(rows.join(best, "grp", "left"), p)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.lit(_quantile(1 - rules.tail, p)), F.lit(False))
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"),
        *carried,
    )
