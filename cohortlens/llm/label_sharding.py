"""Shards of equal bytes that keep linked documents together.

Balanced label propagation: linked documents start at hashed shards. In a round
every group without a place votes with its bytes per shard and wishes for the
shard where it has most among those with room for the whole group. A shard admits
groups, large ones first, up to its room (the mean of all bytes less what it has
admitted); nothing else stands in the way, as documents without a place hold
none. Rounds end when no group is left that fits into a shard: the first in a
shard's order is always admitted, and a shard that refuses a group has less room
than that. Groups that fit nowhere whole are fewer than the shards; they are cut
over as few shards as the room allows. Then unlinked documents fill the shards up
to the mean, large sizes first.

Groups are hyperedges, aggregated per shard; pairs of documents are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, ready, running_totals
from cohortlens.operators.prefix import hash_ranks

#: Groups above this share of the mean go before all others.
LARGE = 1 / 64


def _lookup(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at.cast("int") + 1)


def _loads(state: DataFrame, shards: int, size: str = "size") -> list[float]:
    """Bytes per shard: as many numbers as there are shards."""
    out = [0.0] * shards
    for row in state.groupBy("shard").agg(F.sum(size).alias("n")).collect():
        out[row["shard"]] = float(row["n"])
    return out


def _wish(room: list[float]) -> Column:
    """The shard with room for the group where most of its bytes are; else, and among equals, by hash in proportion to the room."""
    rooms = F.array(*[F.lit(float(x)) for x in room])

    def rank(x: Column, shard: Column) -> Column:
        even = (F.pmod(F.xxhash64("gid", shard), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        votes = F.coalesce(F.try_element_at("votes", shard), F.lit(0))
        return F.struct((x >= F.col("bytes")).alias("open"), votes.alias("n"), (x / -F.log(even)).alias("tie"), shard.alias("to"))

    best = F.array_max(F.transform(rooms, rank))
    return F.when(best["open"], best["to"])


def propagate(groups: DataFrame, room: list[float], least: float) -> tuple[DataFrame | None, DataFrame]:
    """Rounds over the ``groups`` (gid, size, bytes, votes): (gid, shard, bytes) of those admitted, and the others.

    Groups above ``least`` bytes go first. ``room`` is lowered by what is admitted; none of the others fits into it.
    """
    placed, turn = None, 0
    # Large groups first: the upper bits are 64 less the number of binary digits, so slices keep that order.
    digits = F.shiftleft((F.lit(64) - F.length(F.bin("bytes"))).cast("long"), 46)
    spot = digits.bitwiseOR(F.xxhash64("gid").bitwiseAND(F.lit((1 << 46) - 1)))
    for bound in (least, 0.0):
        while True:
            wish = groups.where(F.col("bytes") > F.lit(bound)).withColumn("shard", _wish(room)).where("shard is not null")
            wish = running_totals(wish.select("gid", "bytes", "shard"), ["shard"], spot, ["gid"], "bytes")
            admitted = wish.where(F.col("before") + F.col("bytes") <= _lookup(room, F.col("shard"))).select("gid", "shard", "bytes")
            admitted = materialise(admitted, f"admitted-{turn}")
            loads = _loads(admitted, len(room), "bytes")
            if not any(loads):
                break
            room[:] = [x - n for x, n in zip(room, loads, strict=True)]
            placed = admitted if placed is None else placed.union(admitted)
            groups = materialise(groups.join(admitted.select("gid"), "gid", "left_anti"), f"groups-{turn}")
            turn += 1
    return placed, groups


def _cut(groups: list[Row], room: list[float]) -> list[tuple[int, int, int, int]]:
    """Pieces (gid, shard, first byte, end) of groups over few shards, in whole documents; lowers ``room``.

    A rest goes where it fits most closely, else the shard with most room is
    filled. What fits nowhere, not even one document, gets no piece.
    """
    pieces = []
    for g in sorted(groups, key=lambda g: (-g["bytes"], g["gid"])):
        at = 0
        while at < g["bytes"]:
            left = g["bytes"] - at
            fits = [s for s, x in enumerate(room) if x >= left]
            shard = min(fits, key=room.__getitem__) if fits else max(range(len(room)), key=room.__getitem__)
            take = left if fits else int(room[shard] // g["size"]) * g["size"]
            if take <= 0:
                break
            pieces.append((g["gid"], shard, at, at + take))
            room[shard] -= take
            at += take
    return pieces


def _fill(pool: DataFrame, free: list[float]) -> DataFrame:
    """Deals the pool (row, size) over the shards in proportion to their free bytes."""
    room = [max(0.0, x) for x in free]
    if not sum(room):
        room = [1.0] * len(free)
    ends, at = [], 0.0
    for x in room:
        at += x / sum(room)
        ends.append(at)
    lined = running_totals(pool, [], F.xxhash64(F.lit(3), "row"), ["row"], "size")
    middle = (F.col("before") + F.col("size") / 2) / F.col("total")
    shard = sum(((middle >= F.lit(x)).cast("int") for x in ends[:-1]), F.lit(0))
    return lined.select("row", "size", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 8; a null text counts as empty. Links:
    equal texts. Rows of one doc_id, or with none, are documents of their own.
    Slots of a shard run from 0 without a gap. Other columns are not read. No
    rows give no rows.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("mark"),
    )
    facts = materialise(facts.withColumn("row", F.monotonically_increasing_id()), "facts")
    total = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = total / shards
    same = ["mark", "text_crc32", "size"]
    groups = facts.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("gid")).where("n > 1").drop("n")
    linked = materialise(facts.join(groups, same).select("row", "size", "gid"), "linked")
    votes = linked.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    votes = votes.groupBy("gid", "size", "shard").agg(F.sum("size").alias("n"))
    votes = votes.groupBy("gid", "size").agg(F.sum("n").alias("bytes"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"))
    votes = materialise(votes, "votes")

    # Both collects hold fewer rows than there are shards: each row is more than the mean, or than any room left.
    room = [capacity] * shards
    above = F.col("bytes") > F.lit(capacity)
    pieces = _cut(votes.where(above).select("gid", "size", "bytes").collect(), room)
    whole, left = propagate(votes.where(~above), room, capacity * LARGE)
    pieces += _cut(left.select("gid", "size", "bytes").collect(), room)
    stay = facts.where(F.lit(False)).select("row", "size", F.lit(0).alias("shard"))
    if whole is not None:
        stay = stay.union(linked.join(whole.select("gid", "shard"), "gid").select("row", "size", "shard"))
    if pieces:
        parts = F.broadcast(docs.sparkSession.createDataFrame(pieces, "g long, shard int, start long, end long"))
        cut = linked.join(parts.select("g").distinct(), F.col("gid") == F.col("g"), "left_semi")
        cut = running_totals(cut, ["gid"], F.xxhash64("row"), ["row"], "size")
        inside = (F.col("gid") == F.col("g")) & (F.col("before") >= F.col("start")) & (F.col("before") < F.col("end"))
        stay = stay.union(cut.join(parts, inside).select("row", "size", "shard"))
    stay = materialise(stay, "placed")
    loose = facts.select("row", "size").join(stay.select("row"), "row", "left_anti")
    loose = materialise(loose, "loose")
    done = stay
    bounds = [float("inf"), capacity / 64, capacity / 2048, -1.0]
    for high, low in zip(bounds[:-1], bounds[1:], strict=True):
        pool = loose.where((F.col("size") <= F.lit(high)) & (F.col("size") > F.lit(low)))
        free = [capacity - x for x in _loads(done, shards)]
        done = done.union(materialise(_fill(pool, free), "filled"))
    placed = facts.join(done.select("row", "shard"), "row")
    ranked = hash_ranks(placed, ["shard"], ["row"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("hash_rank") - 1).alias("slot"))
