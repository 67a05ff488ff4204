"""Product quantisation whose nearest codebook entries come from memoised grid cells.

Each part of a vector falls into a coarse grid cell. The first part to fall into a
cell settles which entries can be nearest anywhere in the cell's box: those whose
least distance to the box is not above the smallest greatest distance of any entry.
The rest are dominated. The cell keeps its candidates, and only those are compared
exactly, ties to the lower index. Tasks hold a bounded number of cells per part and
start a part's memory anew beyond it.

Training is integer arithmetic throughout: a round assigns every part, sums per
entry inside tasks and then in Spark, and replaces an entry by the floor of its mean.
What reaches the driver is the codebook, parts * entries rows whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, materialise, ready

#: Cells along the codebook's extent in each dimension, and cells that a task keeps per part.
CELLS_PER_SIDE, MEMO_CELLS = 8, 1 << 14
#: Components up to this size give squared distances that 64 bits hold; beyond it Python integers take over.
FAST = 1 << 26
#: Scaled components from here on do not fit a long.
LIMIT = float(1 << 62)


class Grid:
    """The entries of one part (entries x dimensions, integers) with the candidates of the cells seen so far."""

    def __init__(self, entries: np.ndarray, cells_per_side: int = CELLS_PER_SIDE, memo: int = MEMO_CELLS) -> None:
        self.entries, self.memo = entries, memo
        extent = int((entries.max(0) - entries.min(0)).max()) if entries.size else 0
        self.side = max(1, extent // cells_per_side)
        self._clear()

    def _clear(self) -> None:
        self.cells: dict[bytes, int] = {}
        self.starts, self.candidates = [0], [np.zeros(0, np.int64)]
        self._flat = None

    def _settle(self, cells: np.ndarray) -> None:
        """Keeps the entries that are not dominated across each cell's box (corners included)."""
        for a in range(0, len(cells), 1024):
            low = cells[a : a + 1024, None, :] * self.side
            high = low + (self.side - 1)
            below, above = low - self.entries, self.entries - high
            outside = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least, most = (outside * outside).sum(2), (far * far).sum(2)
            alive = least <= most.min(1, keepdims=True)
            self.candidates.append(np.nonzero(alive)[1])
            self.starts += (self.starts[-1] + np.cumsum(alive.sum(1))).tolist()
        self._flat = None

    def _rows(self, cells: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(cells).view(f"V{cells.shape[1] * cells.itemsize}").ravel()
        some, place, back = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in some]
        new = [i for i, k in enumerate(names) if k not in self.cells]
        if len(self.cells) + len(new) > self.memo:
            self._clear()
            new = range(len(names))
        for i in new:
            self.cells[names[i]] = len(self.cells)
        if len(new):
            self._settle(cells[place[list(new)]])
        return np.array([self.cells[k] for k in names], np.int64)[back]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, ties to the lower index, and the squared distance."""
        if points.dtype == object:  # beyond 64 bits: every entry, in Python integers
            gaps = points[:, None, :] - self.entries.astype(object)
            squared = (gaps * gaps).sum(2)
            best = np.array([min(range(len(row)), key=row.__getitem__) for row in squared], np.int64)
            return best, squared[np.arange(len(points)), best]
        rows = self._rows(points // self.side)
        if self._flat is None:
            self.candidates = [np.concatenate(self.candidates)]
            self._flat = self.candidates[0], np.array(self.starts)
        candidates, starts = self._flat
        sizes = starts[rows + 1] - starts[rows]
        ahead = np.cumsum(sizes) - sizes
        tried = candidates[np.repeat(starts[rows] - ahead, sizes) + np.arange(int(sizes.sum()))]
        gaps = np.repeat(points, sizes, axis=0) - self.entries[tried]
        squared = (gaps * gaps).sum(1)
        least = np.minimum.reduceat(squared, ahead)
        # Candidates of a cell ascend, so the first that is as near has the lowest index.
        ties = np.flatnonzero(squared == np.repeat(least, sizes))
        return tried[ties[np.searchsorted(ties, ahead)]], least


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    """Integers (rows, parts, dimensions): 64-bit where squared distances fit, else Python's."""
    whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)
    return whole if max(int(whole.max(initial=0)), -int(whole.min(initial=0))) <= FAST else whole.astype(object)


def _grids(codebook: list) -> list[Grid]:
    arrays = [np.array(part, dtype=object) for part in codebook]
    small = all(a.size == 0 or max(abs(int(x)) for x in a.ravel()) <= FAST for a in arrays)
    return [Grid(a.astype(np.int64) if small else a) for a in arrays]


def _assign(grids: list[Grid], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if any(g.entries.dtype == object for g in grids):
        v = v.astype(object)
    pairs = [g.nearest(np.ascontiguousarray(v[:, p, :])) for p, g in enumerate(grids)]
    return np.stack([c for c, _ in pairs], 1), np.stack([d for _, d in pairs], 1)


def _sums(codebook: list):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, side = len(codebook), len(codebook[0]), len(codebook[0][0])
        grids, total, n = _grids(codebook), np.zeros((parts, entries, side), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            v = _vectors(batch.column("v"), parts)
            codes, _ = _assign(grids, v)
            small = v.dtype != object  # a batch's sums of these fit 64 bits
            for p in range(parts):
                here = np.zeros((entries, side), np.int64 if small else object)
                np.add.at(here, codes[:, p], v[:, p, :])
                total[p] += here.astype(object)  # Python integers do not overflow
                n[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(n > 0)
        rows = {
            "part": pa.array(used[:, 0], pa.int32()),
            "entry": pa.array(used[:, 1], pa.int32()),
            "n": pa.array(n[n > 0], pa.int64()),
            "sums": pa.array([[str(x) for x in total[p, e]] for p, e in used], pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_pydict(rows)

    return work


def _codes(codebook: list):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, parts = _grids(codebook), len(codebook)
        for batch in batches:
            codes, squared = _assign(grids, _vectors(batch.column("v"), parts))
            error = [x if x < 1 << 63 else None for x in map(int, squared.astype(object).sum(1))]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "error"])

    return work


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v = floor(scale * embedding) as longs, of the rows whose vector can take part.

    Left out: vectors that are null or empty, and those that hold a null or
    non-finite component or one whose scaled value does not fit a long.
    """
    scaled = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(LIMIT)))
    return vectors.where((F.size("embedding") > 0) & sound).select(
        F.col("vec_id").cast("long"), "label", F.transform("embedding", lambda x: scaled(x).cast("long")).alias("v")
    )


def train_codebook(base: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list:
    """Nested lists codebook[part][entry][dimension] of integers, from ``base`` (vec_id, v).

    Entries start as the parts of the rows with the smallest vec_id (rows without
    one last, ties by the vector); with fewer rows there are fewer entries. An
    entry that no part chose stays as it is. No rows: an empty list.
    """
    first = base.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # at most ``entries`` rows
    if not first:
        return []
    if len(first[0].v) % parts:
        raise ValueError(f"vectors of {len(first[0].v)} components cannot be cut into {parts} equal parts")
    side = len(first[0].v) // parts
    codebook = [[list(r.v[p * side : (p + 1) * side]) for r in first] for p in range(parts)]
    for _ in range(rounds):
        sums = arrow_map(base.select("v"), _sums(codebook), "part int, entry int, n long, sums array<string>")
        each = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(side)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # at most parts * entries rows
            codebook[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(side)]
    return codebook


def grid_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebook they refer to.

    One row per vector that takes part (see ``whole_vectors``): vec_id, label,
    codes (index per part), error (squared distances summed over parts; null if
    it does not fit a long). Vectors of another length than that of the smallest
    vec_id take no part. Rows of one vec_id are vectors of their own, a null
    vec_id or label stays. Other columns are not read. No rows give no rows and
    an empty codebook.
    """
    ready(vectors.sparkSession)
    base = materialise(whole_vectors(vectors, scale), "vectors")
    length = base.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v"))).first()[0]
    base = base.where(F.size("v") == F.lit(length or 0))
    codebook = train_codebook(base, parts, entries, rounds)
    kind = dict(base.dtypes)["label"]
    schema = f"vec_id long, label {kind}, codes array<int>, error long"
    if not codebook:
        return base.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), codebook
    return arrow_map(base, _codes(codebook), schema), codebook


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over rows of equal label, nulls together (null if it does not fit a long).

    Sums are one row per label; rows of a label that holds a large share of all stay spread out.
    """
    coded = materialise(coded, "codes")
    sums = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    sums = sums.withColumnRenamed("label", "name")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("name"))).drop("name")
