"""Mixes sources to target weights and orders the mix by a time-varying curriculum.

Targets: sources share a total by weight, none above twice its own size; what is
over is shared again. A source takes each document a whole number of times:
full passes, then documents in hash order while they fit into what is missing,
in a few rounds of which each lines up those that fit into the last gap, then the
one document that brings the gap nearest to nothing.

Positions: a source's weight over training time t in [0, 1] is piecewise linear.
Its integral is the source's cumulative demand. A document copy whose middle lies
at share u of its source's taken words stands at the t where that demand reaches
u, in closed form within a piece. Sorting by position gives the training order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, ready, row_key, running_totals

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights in the order of the sources' names, repeating, and each weight's schedule as (t, weight) knots."""

    weights: tuple[float, ...] = (5, 2, 1)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (1.0, 0.5)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    )
    share: float = 1.5
    most: float = 2.0
    seed: int = 17
    rounds: int = 4


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Adds rank and target to one row per source (source, source_size).

    Sources are lined up in one task, 40 bytes each: a source is a collection or
    a site, of which a task holds tens of millions.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), F.pmod(F.col("rank"), F.lit(len(mix.weights))) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(named) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(mix.most))
    # Sources meet their cap in the order of cap / weight as the common level rises.
    rising = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    ahead, behind = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(mix.share)
    level = (total - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind)
    leveled = ranked.withColumn("own", level).withColumn("free", F.col("cap") / F.col("weight") > F.col("own"))
    # Past the first free source the running level falls below the common one.
    level = F.max(F.when(F.col("free"), F.col("own"))).over(W.partitionBy())
    target = F.when(F.col("free"), F.col("weight") * level).otherwise(F.col("cap"))
    return leveled.select("source", "source_size", "rank", target.alias("target"))


def _pieces(schedule: tuple[tuple[float, float], ...]) -> Column:
    """The schedule's pieces with the share of demand before each: t0, length, w0, slope, before, area (shares of the whole)."""
    cuts = list(zip(schedule[:-1], schedule[1:], strict=True))
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in cuts]
    whole, before, out = sum(areas), 0.0, []
    for (a, b), area in zip(cuts, areas, strict=True):
        piece = {"t0": a[0], "w0": a[1] / whole, "slope": (b[1] - a[1]) / (b[0] - a[0]) / whole, "before": before, "end": before + area / whole}
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in piece.items()]))
        before += area / whole
    return F.array(*out)


def _position(u: Column, pieces: Column) -> Column:
    """The time at which a piecewise linear schedule's demand reaches the share u."""
    piece = F.coalesce(F.filter(pieces, lambda p: u <= p["end"])[0], F.element_at(pieces, -1))
    need = F.greatest(u - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * need, F.lit(0.0)))
    # need = w0 x + slope x^2 / 2, solved without cancellation; a level piece is the case slope = 0.
    return piece["t0"] + F.when(need > 0, 2 * need / (piece["w0"] + root)).otherwise(0.0)


def row_hash() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def plan_mix(docs: DataFrame, mix: Mix | None = None, carried: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target, copies, taken, positions.

    size is the number of words, 0 for a null text; a null source is a source of
    its own, the last. positions has one training time per copy, ascending.
    ``mark`` is a hash of the row, equal for equal rows. Rows of one doc_id are
    documents of their own. Other columns are not read, but for what ``carried``
    (name: expression over ``docs``) adds to the plan. Depends on the rows only,
    not on how they are spread. No rows give no rows.
    """
    mix = mix or Mix()
    ready(docs.sparkSession)
    facts = docs.select(
        F.col("doc_id").cast("long"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash().alias("mark"),
        *[c.alias(name) for name, c in (carried or {}).items()],
    )
    facts = materialise(facts.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(facts.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes).withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size"))
    targets = materialise(targets.withColumnRenamed("source", "name"), "targets")
    # Documents beyond the full passes, in hash order: each round lines up those that fit into the gap by themselves.
    spot = F.xxhash64(F.lit(mix.seed), "mark")
    gaps = targets.where("source_size > 0").select("name", F.col("extra").alias("gap"), F.lit(0).cast("long").alias("filled"))
    rest, chosen = facts.where("size > 0"), None
    for turn in range(mix.rounds):
        fitting = rest.join(gaps, F.col("source").eqNullSafe(F.col("name"))).where("size <= gap")
        if turn < mix.rounds - 1:
            lined = running_totals(fitting, ["source"], spot, ["row"], "size")
            took = lined.where("before + size <= gap").select("row", "name", "size", (F.col("filled") + F.col("before")).alias("ahead"))
        else:  # the one document that leaves least of the gap
            last = fitting.groupBy("name").agg(F.max(F.struct("size", "mark", "row", "filled")).alias("top"))
            took = last.select("top.row", "name", "top.size", F.col("top.filled").alias("ahead"))
        took = materialise(took, f"took-{turn}")
        chosen = took if chosen is None else chosen.union(took)
        sums = took.groupBy("name").agg(F.sum("size").alias("more")).withColumnRenamed("name", "n1")
        gaps = gaps.join(sums, F.col("name").eqNullSafe(F.col("n1")), "left")
        more = F.coalesce(F.col("more"), F.lit(0))
        gaps = materialise(gaps.select("name", (F.col("gap") - more).alias("gap"), (F.col("filled") + more).alias("filled")), f"gaps-{turn}")
        rest = rest.join(took.select("row"), "row", "left_anti")
    # A document over the gap may still leave it nearer to nothing.
    over = rest.join(gaps, F.col("source").eqNullSafe(F.col("name"))).where("size > gap and size < 2 * gap")
    over = over.groupBy("name").agg(F.min(F.struct("size", "mark", "row", "filled")).alias("top"))
    chosen = chosen.union(over.select("top.row", "name", "top.size", F.col("top.filled").alias("ahead"))).select(F.col("row").alias("r"), "ahead")
    lined = running_totals(facts, ["source"], spot, ["row"], "size").drop("total")
    planned = lined.join(targets, F.col("source").eqNullSafe(F.col("name"))).join(chosen, F.col("row") == F.col("r"), "left")
    planned = planned.withColumn("copies", (F.col("passes") + F.col("ahead").isNotNull().cast("long")).cast("long"))
    planned = materialise(planned, "planned")  # read twice below
    whole = planned.groupBy("name").agg(F.sum(F.col("copies") * F.col("size")).alias("source_taken")).withColumnRenamed("name", "n2")
    planned = planned.join(whole, F.col("source").eqNullSafe(F.col("n2")))

    pieces = F.element_at(F.array(*[_pieces(s) for s in mix.schedules]), F.pmod(F.col("rank"), F.lit(len(mix.schedules))) + 1)

    def time(copy: Column) -> Column:
        ahead = F.when(copy == F.col("passes"), F.col("ahead")).otherwise(F.col("before"))
        middle = copy * F.col("source_size") + ahead + F.col("size") / 2
        return _position(middle / F.greatest(F.col("source_taken"), F.lit(1)), F.col("pieces"))

    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), time)).otherwise(F.array().cast("array<double>"))
    planned = planned.withColumn("pieces", pieces)
    return planned.select(
        "doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), times.alias("positions"), *(carried or {})
    )


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position.

    All columns of ``docs`` stay, whatever their names. Texts are shuffled twice:
    to the plan by a hash of the whole row, each different row once, and to their
    place. Repeated rows are taken as often as the plan takes each of them. No
    rows give no rows.
    """
    a, b = row_key(docs)
    plan = plan_mix(docs, mix, {"_a": a, "_b": b}).where("copies > 0")
    plan = materialise(plan.select("_a", "_b", F.explode("positions").alias("_at"), F.col("mark").alias("_mark")), "plan")
    rows = docs.select(F.struct("*").alias("_doc"), a.alias("_x"), b.alias("_y")).dropDuplicates(["_x", "_y"])
    taken = rows.join(plan, (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b"))).select("_doc", "_at", "_mark")
    return taken.repartitionByRange("_at", "_mark").sortWithinPartitions("_at", "_mark").select("_doc.*")
