"""Near-duplicate groups by HyperMinHash sketches, checked on full shingle sets.

A document's distinct word shingles are hashed to 64 bits. The hash space is
cut into equal buckets; for the smallest hash of each bucket a 16-bit register
keeps the count of leading zeros and the ten bits after them. Registers, four
to a 64-bit band, serve as band keys and as a Jaccard estimator whose expected
chance collisions are taken off.

1. Documents with equal shingle sets are one class; classes are compared.
2. Empty registers borrow from others in a fixed order before they are banded, so
   that a band's key has the bits of four registers in short texts too. Sets of up
   to ``SHORT`` shingles are keyed by shingles instead: of each set the smallest
   hashes, as many as two linked sets cannot both lack. Sets that such a set may
   be linked with have both kinds of key.
3. Each key's bucket links its classes to its smallest one if the estimate
   allows. Buckets in which some class fails that are compared in full, in
   tiles, so that no pair of a bucket is missed whatever its size.
4. Classes linked so far form families. Each family's full sets are compared
   in tiles of bounded size; only links that hold on the full sets stay, and a
   tile gives a spanning forest of them, never all its pairs.
5. Components of the links give the groups.

A pair at the threshold itself escapes all bands with probability 3e-7 and the
estimate with 3e-7; both fall fast above it. Pairs with a set of up to ``SHORT``
shingles escape no key, and the estimate only where several of a few shingles
share one register.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, groups, materialise, ready
from cohortlens.llm.components import Forest, components
from cohortlens.llm.shingles import shingle_sets, slices, utf8

BUCKETS, BAND, MANTISSA = 160, 4, 10
BANDS = BUCKETS // BAND
#: Sets of so many shingles are keyed by shingles.
SHORT = 32
#: Text that is sketched at a time, shingles in a tile of full sets, registers in a tile of sketches.
SLICE_BYTES, TILE_SHINGLES, TILE_CLASSES = 2 << 20, 1_500_000, 4096


@dataclass(frozen=True)
class Rule:
    """Shingle width, least Jaccard in hundredths, and how many deviations below it an estimate may lie.

    Shingles of a short set that share a register count once: its estimates may lie twice as far below.
    """

    width: int = 5
    percent: int = 75
    deviations: float = 5.0

    def least_estimate(self, n: np.ndarray) -> np.ndarray:
        """The least estimate of pairs whose smaller set has ``n`` shingles."""
        j = self.percent / 100
        far = self.deviations * (j * (1 - j) / BUCKETS) ** 0.5
        return np.where(np.asarray(n) <= SHORT, j - 2 * far, j - far)

    @property
    def most_keyed(self) -> int:
        """The largest set that can be linked with a short one."""
        return 100 * SHORT // self.percent

    def prefix(self, n: int) -> int:
        """How many smallest shingles of n hold a shared one, whatever set it is linked with; n itself shares percent of n or more."""
        return n + (-self.percent * n // 100) + 1


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (one row of 16-bit numbers per set, 0: empty bucket) of ascending hash sets."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    spread = (hashes >> np.uint64(32)) * np.uint64(BUCKETS)
    at = np.repeat(np.arange(len(sets)) * BUCKETS, [len(s) for s in sets]) + (spread >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    inside = (spread[first] << np.uint64(32)) | (hashes[first] & np.uint64(0xFFFFFFFF))
    zeros = np.minimum(53 - np.frexp((inside >> np.uint64(11)).astype(np.float64))[1], 53).astype(np.uint64)
    after = (inside << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[at[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | after
    return out


def _borrowing() -> np.ndarray:
    """For each register the order in which it borrows from the others: a shuffle that is the same everywhere."""
    order = np.random.Generator(np.random.PCG64(1)).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)
    return order[order != np.arange(BUCKETS)[:, None]].reshape(BUCKETS, BUCKETS - 1)


def filled(sketch: np.ndarray) -> np.ndarray:
    """Registers with each empty one replaced by the first that is in use in its own order; sets without a shingle stay empty.

    Two sets then agree in any register with their Jaccard similarity as probability, however small they are.
    """
    out, order = sketch.copy(), _borrowing()
    some = sketch.any(1)
    for step in range(BUCKETS - 1):
        row, column = np.nonzero((out == 0) & some[:, None])
        if not len(row):
            break
        out[row, column] = sketch[row, order[column, step]]
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers in which two unrelated sets of n and m members agree by chance.

    Both bucket minima fall into one register cell; the chance is the integral
    of the two densities times the cell's width, zero-count by zero-count.
    """
    n, m = np.asarray(n, float), np.asarray(m, float)
    power = np.maximum(n + m - 1, 1)
    total = np.zeros(np.broadcast(n, m).shape)
    for zeros in range(40):
        high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)
        mass = (1 - low / BUCKETS) ** power - (1 - high / BUCKETS) ** power
        total += low / 2**MANTISSA * mass
    return total * n * m / power


def estimate(one: np.ndarray, n: int, rest: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of a sketch of n members and each row of ``rest``."""
    same = ((rest == one) & (one != 0)).sum(1)
    used = ((rest != 0) | (one != 0)).sum(1)
    return (same - expected_collisions(n, m)) / np.maximum(used, 1)


def _sketch(rule: Rule):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for a, b in slices(starts, SLICE_BYTES):
                sets = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], rule.width)
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                bands = registers(sets).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                flat = pa.array(bands.reshape(-1))
                short = [s[: rule.prefix(len(s))] if len(s) <= rule.most_keyed else s[:0] for s in sets]
                ends = np.cumsum([0, *map(len, short)], dtype=np.int32)
                prefix = np.concatenate([*short, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n),
                        pa.array(names[:, 0]),
                        pa.array(names[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), flat),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix)),
                    ],
                    ["doc_id", "n", "h1", "h2", "bands", "prefix"],
                )

    return work


def _sketches(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BUCKETS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket keys (band, code) of each class: its filled bands, or band ``BANDS`` and the shingles of its prefix."""
    for batch in batches:
        cid, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
        prefix = batch.column("prefix")
        banded = np.flatnonzero(n > SHORT)
        codes = filled(_sketches(batch.column("bands").take(pa.array(banded)))).view(np.int64).reshape(-1)
        shingles = prefix.flatten().to_numpy(zero_copy_only=False)
        counts = prefix.value_lengths().to_numpy(zero_copy_only=False)
        ids = np.concatenate([np.repeat(cid[banded], BANDS), np.repeat(cid, counts)])
        band = np.concatenate([np.tile(np.arange(BANDS), len(banded)), np.full(len(shingles), BANDS)])
        columns = [pa.array(ids), pa.array(band.astype(np.int32)), pa.array(np.concatenate([codes, shingles]))]
        yield pa.RecordBatch.from_arrays(columns, ["cid", "band", "code"])


def _star_estimates(rule: Rule):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sketches(batch.column("x")), _sketches(batch.column("y"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            same = ((x == y) & (x != 0)).sum(1)
            used = ((x != 0) | (y != 0)).sum(1)
            near = (same - expected_collisions(n, m)) / np.maximum(used, 1) >= rule.least_estimate(np.minimum(n, m))
            near &= 100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "near"])

    return work


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _candidates(i: int, labels: np.ndarray, sketch: np.ndarray, n: np.ndarray, used: np.ndarray, rule: Rule) -> np.ndarray:
    """Later members not yet joined to member i whose sizes and estimates allow a link; used: registers in use."""
    rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
    rest = rest[100 * np.minimum(n[rest], n[i]) >= rule.percent * np.maximum(n[rest], n[i])]
    if not len(rest):
        return rest
    # Without the union of registers in use and chance collisions the estimate is only higher.
    own = np.flatnonzero(sketch[i])
    same = (sketch[rest][:, own] == sketch[i, own]).sum(1)
    least = rule.least_estimate(np.minimum(n[rest], n[i]))
    likely = same >= least * np.maximum(used[rest], used[i])
    rest, least = rest[likely], least[likely]
    return rest[estimate(sketch[i], n[i], sketch[rest], n[rest]) >= least] if len(rest) else rest


def _join(labels: np.ndarray, i: int, hits: np.ndarray, ids: np.ndarray, found: list[tuple[int, int]]) -> None:
    for j in hits.tolist():
        if labels[j] != labels[i]:
            labels[labels == labels[j]] = labels[i]
            found.append((int(ids[i]), int(ids[j])))


def _compare_buckets(rule: Rule):
    """A spanning forest of the pairs of a tile of a bucket that the sketches allow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["band", "code", "t", "u"]):
            ids, n, sketch = unit["cid"].to_numpy(), unit["n"].to_numpy(), _sketches(unit["bands"])
            labels, found, used = np.arange(len(ids)), [], (sketch != 0).sum(1)
            for i in range(len(ids) - 1):
                _join(labels, i, _candidates(i, labels, sketch, n, used, rule), ids, found)
            yield _edges(found)

    return work


def _verify(rule: Rule):
    """A spanning forest of the links of a tile of a family that hold on the full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["fam", "t", "u"]):
            data, starts = utf8(unit["text"])
            sets: list[np.ndarray] = []
            for a, b in slices(starts, SLICE_BYTES):
                sets += shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], rule.width)
            # Rows of a repeated doc_id with another text are other classes.
            h1 = unit["h1"].to_numpy()
            names = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] for s in sets]
            own = [k for k in range(len(sets)) if names[k] == h1[k]]
            ids, sets = unit["cid"].to_numpy()[own], [sets[k] for k in own]
            n = np.array([len(s) for s in sets], np.int64)
            sketch = registers(sets)
            _, codes = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
            begin = np.cumsum(n) - n
            mark = np.zeros(len(codes) + 1, bool)
            labels, found, used = np.arange(len(ids)), [], (sketch != 0).sum(1)
            for i in range(len(ids) - 1):
                rest = _candidates(i, labels, sketch, n, used, rule)
                if not len(rest):
                    continue
                mark[codes[begin[i] : begin[i] + n[i]]] = True
                sizes = n[rest]
                stops = np.cumsum(sizes)
                places = np.repeat(begin[rest] - (stops - sizes), sizes) + np.arange(stops[-1])
                shared = np.add.reduceat(mark[codes[places]].astype(np.int64), stops - sizes)
                mark[codes[begin[i] : begin[i] + n[i]]] = False
                _join(labels, i, rest[100 * shared >= rule.percent * (n[i] + sizes - shared)], ids, found)
            yield _edges(found)

    return work


def _tile_pairs(df: DataFrame, tiles: str) -> DataFrame:
    """Each row once for every pair (t <= u) of tiles that holds its own tile."""
    df = df.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col(tiles)))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1)))
    return df.withColumn("t", F.least("tile", "other")).withColumn("u", F.greatest("tile", "other"))


_SKETCH = "doc_id long, n long, h1 long, h2 long, bands array<long>, prefix array<long>"


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    A null, empty or blank text has no shingle and is linked with nothing.
    Rows that share a doc_id are one document: their groups are one group. Rows
    without doc_id join the group of equal shingle sets; they name no group, and
    a set that only such rows have is linked with no other. component_id is then
    the smallest doc_id of the group, or null; kept compares null-safely. Other
    columns of ``docs`` are not read. No rows give no rows.
    """
    rule = rule or Rule()
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialise(arrow_map(docs, _sketch(rule), _SKETCH), "sketches")
    classes = sketches.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    codes = arrow_map(classes.select("cid", "n", "bands", "prefix"), _keys, "cid long, band int, code long")
    # Counted before they are joined back: a bucket that very many classes share is split by adaptive execution.
    sizes = codes.groupBy("band", "code").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("a")).where("size > 1")
    members = materialise(codes.withColumnRenamed("cid", "b").join(sizes, ["band", "code"]).select("band", "code", "b", "size", "a"), "buckets")

    one = classes.select(F.col("cid").alias("a"), "n", F.col("bands").alias("x"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bands").alias("y"))
    pairs = members.where("a <> b").select("a", "b").distinct().join(one, "a").join(two, "b")
    stars = materialise(arrow_map(pairs.select("a", "b", "n", "m", "x", "y"), _star_estimates(rule), "a long, b long, near boolean"), "stars")

    failed = members.where("a <> b and size > 2").join(stars.where("not near"), ["a", "b"]).select("band", "code").distinct()
    left = members.join(failed, ["band", "code"]).select("band", "code", F.col("b").alias("cid"), F.ceil(F.col("size") / TILE_CLASSES).alias("tiles"))
    left = _tile_pairs(left, "tiles").join(classes.select("cid", "n", "bands"), "cid")
    unit = ["band", "code", "t", "u"]
    left = left.select(*unit, "cid", "n", "bands").repartition(*unit).sortWithinPartitions(*unit)
    more = arrow_map(left, _compare_buckets(rule), "a long, b long")
    near = components(stars.where("near").select("a", "b").union(more), "families")

    family = near.union(near.select("root", "root").distinct()).toDF("cid", "fam").join(classes.select("cid", "n", "rep", "h1"), "cid")
    tiles = family.groupBy("fam").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("tiles")).withColumnRenamed("fam", "f")
    family = _tile_pairs(family.join(tiles, F.col("fam") == F.col("f")), "tiles").select("fam", "t", "u", "cid", "h1", "rep")
    unit = ["fam", "t", "u"]
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    family = family.join(texts, F.col("rep") == F.col("doc_id")).select(*unit, "cid", "h1", "text")
    links = arrow_map(family.repartition(*unit).sortWithinPartitions(*unit), _verify(rule), "a long, b long")

    named = sketches.where("n > 0").join(classes.select("h1", "h2", "n", "cid"), ["h1", "h2", "n"]).select("doc_id", "n", "cid")
    again = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z"))
    again = again.where("a <> z").join(named.select("doc_id", F.col("cid").alias("b")), "doc_id").where("a <> b").select("a", "b")
    final = components(links.union(again), "groups")

    placed = classes.select("cid", "rep").join(final.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "r")
    placed = placed.join(least, F.col("root") == F.col("r")).select("cid", "least")
    out = named.join(placed, "cid").select("doc_id", "n", F.col("least").alias("component_id"))
    out = out.union(sketches.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
