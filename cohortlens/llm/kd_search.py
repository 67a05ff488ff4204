"""Exact top-k by inner product with KD-trees per shard.

The upper median cuts of one KD-tree, fitted on a bounded sample, deal all rows to
regions; a region of many rows is cut further by hash, so shards are bounded. A
task builds its shard's tree: median splits along the widest side, tight boxes. A
query walks the tree best first: a box's bound is the largest inner product any
point in it could have, and the walk ends when no box reaches the query's kth score.

Queries search their own shard first. Then each query's kth score is held against
the boxes of all shards, in blocks of queries and boxes; the query visits the
shard with the highest bound, and with the better kth score those others whose
bound still reaches it. Shards that no query reaches are not moved again.

Of equal vectors no more can be found than the k + 1 smallest ids (one may be the
query itself), so only these are candidates, however often a vector is repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, groups, materialise, ready

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 16_384, 128, 4_096
#: Rows of the sample that the upper cuts are fitted on; components of a sample, of a block of queries and of a block of boxes.
SAMPLE_ROWS, SAMPLE_VALUES, ASK_VALUES, BOX_VALUES = 16_384, 1 << 22, 1 << 22, 1 << 18
ROWS_PER_CUT = 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _largest(points: np.ndarray) -> int:
    """The largest absolute component, 1 at least."""
    return max(1, int(points.max(initial=0)), -int(points.min(initial=0)))


def _in_64_bits(numbers: np.ndarray) -> np.ndarray:
    """Python integers beyond 64 bits as the nearest 64-bit number; other arrays as they are."""
    return np.minimum(np.maximum(numbers, _LEAST), _MOST) if numbers.dtype == object else numbers


class Tree:
    """Points (integers), their rows and ids, as leaves of a KD-tree with a box per node.

    ``reach`` is the largest absolute component of the queries that will come.
    Sums that float64 holds exactly use it, those beyond 62 bits go through Python integers.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS, reach: int = 1) -> None:
        size = points.shape[1] * _largest(points) * max(reach, _largest(points))
        self.exact = np.float64 if size < 1 << 52 else np.int64 if size < 1 << 62 else object
        low, high, self.children, self.spans = [], [], [], []
        order, stack = np.arange(len(points)), [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = points[order[a:b]]
            lo, hi = part.min(0), part.max(0)
            node = len(low)
            low.append(lo)
            high.append(hi)
            self.children.append([-1, -1])
            self.spans.append((a, b))
            if parent >= 0:
                self.children[parent][side] = node
            if b - a > leaf:
                middle = (b - a) // 2
                cut = np.argpartition(part[:, int(np.argmax(hi.astype(float) - lo))], middle)
                order[a:b] = order[a:b][cut]
                stack += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.low, self.high = np.array(low).astype(self.exact), np.array(high).astype(self.exact)
        self.points, self.rows, self.ids = points[order].astype(self.exact), rows[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        queries = queries.astype(self.exact)
        return _in_64_bits(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """Up to k pairs (score, id), best first, ties to the smaller id, scores at least ``least``; not row ``own``."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            scores = _in_64_bits(self.points[a:b] @ query)
            hits = np.flatnonzero((scores >= least) & (self.rows[a:b] != own))
            if len(hits):
                best += zip(scores[hits].astype(np.int64).tolist(), self.ids[a:b][hits].tolist(), strict=True)
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


class Cuts:
    """The upper levels of a KD-tree: 2 ** depth regions. All points that equal a cut go to its lower side."""

    def __init__(self, sample: np.ndarray, regions: int) -> None:
        most = max(1, min(regions, len(sample) // ROWS_PER_CUT))
        self.depth = most.bit_length() - 1
        n = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(n, np.int64), np.full(n, _MOST)
        parts = {0: sample}
        for node in range(n):
            part = parts.pop(node)
            if len(part) > 1:
                axis = int(np.argmax(part.max(0).astype(float) - part.min(0)))
                side = part[:, axis]
                # The lower middle, or the next value below where the upper side would be empty.
                cut = np.partition(side, (len(side) - 1) // 2)[(len(side) - 1) // 2]
                if cut == side.max() and (side < cut).any():
                    cut = side[side < cut].max()
                self.axis[node], self.cut[node] = axis, cut
            above = part[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~above], part[above]

    def regions(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _deal(cuts: dict[int, Cuts]):
    """Adds each row's region; vectors of a length that the sample lacks have one region."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            region = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in cuts:
                    region[at] = cuts[dim].regions(_matrix(batch.column("v").take(pa.array(at)), len(at)))
            yield batch.append_column("region", pa.array(region))

    return work


_FOUND = "row long, query_id long, vec_id long, score long, dim int, shard long, low array<long>, high array<long>"


def _answer(k: int):
    """Searches each unit's candidates for its queries; candidates sort before queries.

    The last row of a unit has no query but the candidates' box.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["dim", "shard", "block"]):
            asks = unit["asks"].to_numpy(zero_copy_only=False).astype(bool)
            if asks.all():
                continue
            v, rows, ids = _matrix(unit["v"], unit.num_rows), unit["row"].to_numpy(), unit["vec_id"].to_numpy()
            least, out = unit["least"].to_numpy(zero_copy_only=False), []
            if asks.any():
                tree = Tree(v[~asks], rows[~asks], ids[~asks], reach=_largest(v[asks]))
                if tree.exact is not np.float64:  # the kth score came as a double, perhaps rounded up
                    least = np.nextafter(least, -np.inf)
                queries = v[asks].astype(tree.exact)
                bounds = tree.bounds(queries)
                for q, b, row, name, low in zip(queries, bounds, rows[asks], ids[asks], least[asks], strict=True):
                    out += [(row, name, i, s) for s, i in tree.search(q, b, row, k, low)]
            n = len(out)
            columns = [pa.array([*c, None], pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)]
            columns += [unit["dim"].combine_chunks().take(pa.array([0] * (n + 1))), unit["shard"].combine_chunks().take(pa.array([0] * (n + 1)))]
            box = [v[~asks].min(0).tolist(), v[~asks].max(0).tolist()]
            columns += [pa.array([*[None] * n, x], pa.list_(pa.int64())) for x in box]
            yield pa.RecordBatch.from_arrays(columns, names)

    return work


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which shards' boxes reach which queries' kth scores; boxes sort before queries. A query's own shard is left out."""
    for unit in groups(batches, ["dim", "box_block", "ask_block"]):
        asks = unit["asks"].to_numpy(zero_copy_only=False).astype(bool)
        if asks.all() or not asks.any():
            continue
        low, high = _matrix(unit["v"].filter(pa.array(~asks)), int((~asks).sum())), _matrix(unit["high"].filter(pa.array(~asks)), int((~asks).sum()))
        queries, rows, least = _matrix(unit["v"].filter(pa.array(asks)), int(asks.sum())), unit["row"].to_numpy(zero_copy_only=False)[asks], unit["least"].to_numpy(zero_copy_only=False)[asks]
        shards = unit["shard"].to_numpy()
        own, shards = shards[asks], shards[~asks]
        # In doubles, with room for their rounding, whatever the size of the components.
        low, high, queries = low.astype(float), high.astype(float), queries.astype(float)
        room = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(0) * (queries.shape[1] + 4) * 2.0**-51
        for a in range(0, len(queries), 512):
            part = slice(a, a + 512)
            bounds = np.maximum(queries[part], 0) @ high.T + np.minimum(queries[part], 0) @ low.T + room[part, None]
            q, s = np.nonzero((bounds >= least[part, None]) & (shards[None, :] != own[part, None]))
            columns = [pa.array(rows[part][q].astype(np.int64)), pa.array(np.full(len(q), unit["dim"][0].as_py(), np.int32)), pa.array(shards[s]), pa.array(bounds[q, s])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "dim", "shard", "bound"])


def _regions(base: DataFrame, n: int, widest: int, shard_rows: int) -> DataFrame:
    """``base`` with column region by the cuts of a sample: the rows with the smallest hashes, at most ``SAMPLE_ROWS``."""
    cuts: dict[int, Cuts] = {}
    if n > shard_rows:
        rows = min(SAMPLE_ROWS, max(ROWS_PER_CUT, SAMPLE_VALUES // widest))
        sample = base.select("dim", "v", "spot").orderBy("spot").limit(rows).collect()
        by_dim: dict[int, list[list[int]]] = {}
        for r in sample:
            by_dim.setdefault(r.dim, []).append(r.v)
        cuts = {d: Cuts(np.array(v, np.int64), math.ceil(n * len(v) / len(sample) / shard_rows)) for d, v in by_dim.items()}
    return arrow_map(base, _deal(cuts), "row long, vec_id long, v array<long>, is_query boolean, dim int, spot long, region long")


_UNIT = ["dim", "shard", "block"]


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Answers of units (dim, shard, block) of candidates (row, vec_id, v) and queries (with least)."""
    names = [*_UNIT, "asks", "row", "vec_id", "v", "least"]
    both = candidates.withColumn("asks", F.lit(0)).withColumn("least", F.lit(float("-inf"))).select(*names)
    both = both.unionByName(queries.withColumn("asks", F.lit(1)).select(*names))
    return arrow_map(both.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "asks"), _answer(k), _FOUND)


def _visit(visits: DataFrame, candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Answers of the shards that ``visits`` (row, dim, shard) names, many visits of a shard in blocks."""
    load = visits.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    asked = visits.join(load, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    asked = asked.select("row", *_UNIT).join(queries.select("row", "vec_id", "v", "least"), "row")
    there = candidates.join(load, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _search(there, asked, k)


def _with_least(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``queries`` with their kth score of ``found``, or minus infinity; a query has at most k answers of each shard there."""
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)
    kth = found.where("row is not null").groupBy(F.col("row").alias("r")).agg(best.alias("best"))
    kth = kth.select("r", F.when(F.size("best") == k, F.get("best", F.lit(k - 1))).cast("double").alias("kth"))
    joined = queries.drop("least").join(kth, F.col("row") == F.col("r"), "left")
    return joined.withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("r", "kth")


def top_inner_products(vectors: DataFrame, asks: Column, k: int, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row of ``vectors`` (vec_id, embedding) with ``asks``.

    Components become floor(scale * x). Components and scores beyond 64 bits count
    as the nearest 64-bit number. Rows whose vector is null, empty or holds a null
    or non-finite component take no part; nor do rows without vec_id. Vectors of
    different lengths are never compared. Rows of one vec_id are vectors of their
    own. Other columns are not read. No rows give no rows.
    """
    ready(vectors.sparkSession)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    base = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    base = base.select(F.col("vec_id").cast("long"), whole.alias("v"), F.coalesce(asks, F.lit(False)).alias("is_query"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "is_query", F.size("v").alias("dim"))
    base = materialise(base.withColumn("spot", F.xxhash64("row")), "vectors")
    number = F.count(F.lit(1))
    n, n_queries, widest = base.agg(number, F.count_if("is_query"), F.coalesce(F.max("dim"), F.lit(1))).first()

    dealt = _regions(base, n, widest, shard_rows)
    pieces = dealt.groupBy("dim", "region").agg(F.ceil(number / shard_rows).alias("pieces"))
    shard = F.shiftleft("region", 32) + F.pmod("spot", F.col("pieces"))
    placed = materialise(dealt.join(pieces, ["dim", "region"]).select("dim", shard.alias("shard"), "row", "vec_id", "v", "is_query"), "placed")
    # Spark keeps the first rows of each vector before it moves them, so a repeated one fills no task.
    same = W.partitionBy("dim", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("vec_id", "row")
    candidates = placed.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).select("dim", "shard", "row", "vec_id", "v")
    candidates = materialise(candidates, "candidates")
    queries = placed.where("is_query").drop("is_query")

    block, low = F.lit(0).cast("long"), F.lit(float("-inf"))
    home = _search(candidates.withColumn("block", block), queries.withColumn("block", block).withColumn("least", low), k)
    home = materialise(home, "home")
    boxes = home.where("row is null").select("dim", "shard", F.col("low").alias("v"), "high")
    queries = materialise(_with_least(queries, home, k), "queries")

    per_box, per_ask = max(1, BOX_VALUES // widest), max(1, ASK_VALUES // widest)
    box_blocks, ask_blocks = max(1, math.ceil(boxes.count() / per_box)), max(1, math.ceil(n_queries / per_ask))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    boxes = boxes.withColumn("box_block", F.pmod(F.xxhash64("shard"), F.lit(box_blocks)).cast("int")).withColumn("ask_block", every(ask_blocks))
    boxes = boxes.select("dim", "box_block", "ask_block", F.lit(0).alias("asks"), F.lit(-1).cast("long").alias("row"), "shard", "v", "high", low.alias("least"))
    asking = queries.withColumn("ask_block", F.pmod(F.xxhash64("row"), F.lit(ask_blocks)).cast("int")).withColumn("box_block", every(box_blocks))
    asking = asking.select("dim", "box_block", "ask_block", F.lit(1).alias("asks"), "row", "shard", "v", F.lit(None).cast("array<long>").alias("high"), "least")
    unit = ["dim", "box_block", "ask_block"]
    both = boxes.unionByName(asking).repartition(*unit).sortWithinPartitions(*unit, "asks")
    visits = materialise(arrow_map(both, _reach, "row long, dim int, shard long, bound double"), "visits")

    nearest = visits.groupBy("row").agg(F.max(F.struct("bound", "dim", "shard")).alias("top")).select("row", "top.dim", "top.shard")
    near = materialise(_visit(nearest, candidates, queries, k), "near")
    queries = _with_least(queries, home.union(near), k)
    rest = visits.join(nearest, ["row", "dim", "shard"], "left_anti").join(queries.select("row", "least"), "row").where("bound >= least")
    away = _visit(materialise(rest.select("row", "dim", "shard"), "rest"), candidates, queries, k)

    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = home.union(near).union(away).where("row is not null")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
