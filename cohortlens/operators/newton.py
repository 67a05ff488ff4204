"""Logistic regression paths by Newton steps that share one pass over the rows.

The rows are stored once as blocks of plain numbers, and a step reads the blocks once.
Tasks turn each block into the gradient and the Gram
matrix of every open model (each key at each penalty) and emit one array per model;
Spark adds the arrays, and what reaches the driver is one (d + 1) x (d + 2) system per
model, however many rows there are. A step that raises a model's loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.prefix import join_parameters
from cohortlens.session import materialise

INTERCEPT = "(intercept)"
MAX_STEPS, TOLERANCE = 60, 1e-7
#: Rows of a block.
BLOCK_ROWS = 4096
KINDS = {str: "string", int: "bigint", float: "double"}


def summed(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sums of arrays ``v`` of one length per ``slot``; the caller bounds slots and length.

    Tasks add their arrays one at a time, so memory does not grow with the number of partials.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, v in zip(batch.column("slot").to_pylist(), batch.column("v"), strict=True):
                v = v.values.to_numpy()
                total[slot] = total[slot] + v if slot in total else v
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(total), pa.int32()), "v": pa.array(list(total.values()), pa.list_(pa.float64()))})

    rows = partials.repartition("slot").mapInArrow(add, "slot int, v array<double>").collect()
    return {r.slot: np.array(r.v) for r in rows}


def numbers(block: pa.BinaryScalar, kind: type) -> np.ndarray:
    """The numbers of a block's column."""
    return np.frombuffer(block.as_buffer(), kind)


def stored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of rows, written once over as many tasks as shuffles have: every step of a fit reads them."""
    return materialise(blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "blocks")


@dataclass(frozen=True)
class Fitted:
    """Coefficients of one model: ``key`` names it, ``c`` is its inverse penalty."""

    key: object
    c: float
    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float

    def logit(self) -> Column:
        """The linear score as a column over the feature columns."""
        terms = [F.col(f"`{f}`").cast("double") * float(b) for f, b in zip(self.features, self.coefficients, strict=True)]
        return sum(terms, F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return F.lit(1.0) / (1.0 + F.exp(-self.logit()))


def _packed(width: int):
    """Rows (k, x, y, w) as blocks of one key each; rows without a key are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x_all = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y_all, w_all = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            coded = batch.column("k").dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code, key in enumerate(coded.dictionary.to_pylist()):
                here = np.flatnonzero(codes == code)
                for a in range(0, len(here), BLOCK_ROWS):
                    rows = here[a : a + BLOCK_ROWS]
                    block = {n: pa.array([v[rows].astype(np.float64).tobytes()], pa.binary()) for n, v in (("x", x_all), ("y", y_all), ("w", w_all))}
                    yield pa.RecordBatch.from_pydict({"k": pa.array([key], coded.dictionary.type), **block})

    return work


def _partials(state: dict, width: int):
    """One array per open model: loss, gradient, Gram matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, *block in zip(batch.column("k").to_pylist(), *[batch.column(c) for c in "xyw"], strict=True):
                if key not in state:
                    continue
                x, y, w = (numbers(b, np.float64) for b in block)
                x = x.reshape(-1, width)
                for slot, beta in state[key]:
                    z = x @ beta
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    loss = (w * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z)).sum()
                    gram = x.T @ ((w * p * (1 - p))[:, None] * x)
                    v = np.concatenate([[loss], x.T @ (w * (p - y)), gram.ravel()])
                    total[slot] = total[slot] + v if slot in total else v
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(total), pa.int32()), "v": pa.array(list(total.values()), pa.list_(pa.float64()))})

    return work


def fit_logistic(
    rows: DataFrame, features: Sequence[str], grid: Sequence[float] = (1.0,), label: str = "label", weight: str | None = None, key: str | None = None
) -> list[Fitted]:
    """Minimises C * sum(weight * log-loss) + |coefficients|^2 / 2 for each value of ``key`` and each C of ``grid``.

    Features and label must not be null. ``key`` has few values (models). The
    intercept is not penalised.
    """
    width = len(features) + 1
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features], F.lit(1.0))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = rows.select(F.col(key).alias("k") if key else F.lit("").alias("k"), x.alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    kind = table.schema["k"].dataType.simpleString()
    blocks = stored_blocks(table.mapInArrow(_packed(width), f"k {kind}, x binary, y binary, w binary"))
    names = sorted(r.k for r in blocks.select("k").where("k IS NOT NULL").distinct().collect()) if key else [""]
    models = [(k, float(c)) for k in names for c in grid]
    ridge = np.append(np.ones(width - 1), 0.0)
    beta = {i: np.zeros(width) for i in range(len(models))}
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    still = set(beta)
    for _ in range(MAX_STEPS):
        if not still:
            break
        state: dict = {}
        for i in still:
            state.setdefault(models[i][0], []).append((i, beta[i]))
        sums = summed(blocks.mapInArrow(_partials(state, width), "slot int, v array<double>"))
        for i in list(still):
            if i not in sums:  # a key without rows
                still.discard(i)
                continue
            c, b, v = models[i][1], beta[i], sums[i]
            loss = c * v[0] + 0.5 * (ridge * b * b).sum()
            if i in best and loss > best[i][0] + 1e-9 * abs(best[i][0]):
                shorter = best[i][2] / 2
                best[i] = (best[i][0], best[i][1], shorter)
                beta[i] = best[i][1] - shorter
                if np.abs(shorter).max() < TOLERANCE:
                    beta[i] = best[i][1]
                    still.discard(i)
                continue
            gradient = c * v[1 : 1 + width] + ridge * b
            gram = c * v[1 + width :].reshape(width, width) + np.diag(ridge)
            step = np.linalg.lstsq(gram, gradient, rcond=None)[0] if not gram[-1, -1] > 0 else np.linalg.solve(gram, gradient)
            best[i] = (loss, b, step)
            beta[i] = b - step
            if np.abs(step).max() < TOLERANCE * max(1.0, np.abs(b).max()):
                still.discard(i)
    return [Fitted(k if key else None, c, tuple(features), beta[i][:-1], float(beta[i][-1])) for i, (k, c) in enumerate(models)]


# ── models as tables ────────────────────────────────────────────────────────


def coefficient_table(spark: SparkSession, models: Sequence[Fitted], intercept: bool = True) -> DataFrame:
    """(model, c, feature, coefficient), the intercept under a name of its own."""
    rows = [
        (m.key, m.c, f, float(b))
        for m in models
        for f, b in [*zip(m.features, m.coefficients, strict=True), *([(INTERCEPT, m.intercept)] if intercept else [])]
    ]
    kind = KINDS.get(type(models[0].key), "string")
    return spark.createDataFrame(rows, f"model {kind}, c double, feature string, coefficient double")


def save_models(spark: SparkSession, models: Sequence[Fitted], path: str) -> None:
    coefficient_table(spark, models).write.parquet(path)


def load_models(spark: SparkSession, path: str) -> list[Fitted]:
    """Stored models; a model is as many rows as it has features, so this reads a bounded table."""
    by: dict = {}
    for r in spark.read.parquet(path).collect():
        by.setdefault((r.model, r.c), {})[r.feature] = r.coefficient
    out = []
    for (k, c), values in sorted(by.items(), key=lambda e: (str(e[0][0]), e[0][1])):
        bias = values.pop(INTERCEPT)
        out.append(Fitted(k, c, tuple(values), np.array(list(values.values())), bias))
    return out


def apply_by_key(rows: DataFrame, models: Sequence[Fitted], key: str, output: str) -> DataFrame:
    """Adds ``output``, the probability under the model of the row's ``key``; rows of other keys are left out."""
    features = models[0].features
    table = rows.sparkSession.createDataFrame(
        [(m.key, *map(float, m.coefficients), m.intercept) for m in models],
        f"`{key}` {KINDS.get(type(models[0].key), 'string')}, " + ", ".join(f"_b{i} double" for i in range(len(features) + 1)),
    )
    joined = join_parameters(rows, table, [key])
    logit = sum((F.col(f"`{f}`").cast("double") * F.col(f"_b{i}") for i, f in enumerate(features)), F.col(f"_b{len(features)}"))
    return joined.withColumn(output, F.lit(1.0) / (1.0 + F.exp(-logit))).drop(*[f"_b{i}" for i in range(len(features) + 1)])
