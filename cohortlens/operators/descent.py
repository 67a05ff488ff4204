"""Linear models over sparse or dense rows by full-batch descent, with partial gradients per task.

Rows are (y, w, idx, val): label, weight, and the vector as places and values; a null
``idx`` is a dense vector. The rows are stored once as blocks of plain numbers, and each
evaluation reads the blocks once. A task adds up its part of the losses and gradients and
emits them in blocks of places; Spark adds the blocks.
The driver holds vectors of the model's length only, never rows. Steps are accepted
only if they lower the objective, so every path falls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.newton import numbers, stored_blocks, summed

BLOCK = 1 << 14
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Linear:
    """A fitted vector with its intercept, and the objective after each accepted step."""

    coefficients: np.ndarray
    intercept: float
    path: tuple[float, ...]


# ── rows ────────────────────────────────────────────────────────────────────


def dense_rows(rows: DataFrame, features: Sequence[str], label: str = "label", weight: Column | None = None, carried: Sequence[str] = ()) -> DataFrame:
    val = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return rows.select(*carried, F.col(label).cast("double").alias("y"), w.alias("w"), F.lit(None).cast("array<int>").alias("idx"), val.alias("val"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every entry."""
    val, idx = batch.column("val"), batch.column("idx")
    sizes = np.diff(val.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), sizes)
    value = val.flatten().to_numpy(zero_copy_only=False)
    if idx.null_count:
        place = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    else:
        place = idx.flatten().to_numpy(zero_copy_only=False)
    return row, place, value


def _packed(entries: int):
    """Blocks of rows with at most ``entries`` entries (a longer row is a block of its own)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, dense = batch.column("y").to_numpy(), batch.column("w").to_numpy(), batch.column("idx").null_count > 0
            _, place, value = _matrix(batch)
            ends = np.diff(batch.column("val").offsets.to_numpy()).cumsum()
            a = 0
            while a < batch.num_rows:
                first = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, first + entries, "right")))
                part = slice(first, ends[b - 1])
                block = {
                    "y": y[a:b], "w": w[a:b], "sizes": np.diff(ends[a:b], prepend=first).astype(np.int64),
                    "idx": None if dense else place[part].astype(np.int32), "val": value[part].astype(np.float64),
                }
                yield pa.RecordBatch.from_pydict({k: pa.array([None if v is None else v.tobytes()], pa.binary()) for k, v in block.items()})
                a = b

    return work


def blocks_of(rows: DataFrame, entries: int = BLOCK) -> DataFrame:
    """The rows as stored blocks of numbers (y, w, sizes, idx, val), spread over the tasks."""
    return stored_blocks(rows.select("y", "w", "idx", "val").mapInArrow(_packed(entries), "y binary, w binary, sizes binary, idx binary, val binary"))


def _evaluation(beta: np.ndarray, n_sums: int, n_gradients: int, residuals: Callable):
    """Adds ``residuals(y, w, z) -> (sums, [row weights per gradient])`` over a task's blocks."""
    width = len(beta)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gradients = np.zeros(n_sums), np.zeros((n_gradients, width))
        for batch in batches:
            for block in zip(*[batch.column(c) for c in ("y", "w", "sizes", "idx", "val")], strict=True):
                y, w, value = (numbers(block[i], np.float64) for i in (0, 1, 4))
                dense = not block[3].is_valid and len(value) == len(y) * (width - 1)
                if dense:
                    x = value.reshape(len(y), width - 1)
                    z = x @ beta[:-1] + beta[-1]
                else:
                    sizes = numbers(block[2], np.int64)
                    row = np.repeat(np.arange(len(y)), sizes)
                    place = numbers(block[3], np.int32) if block[3].is_valid else np.arange(len(value)) - np.repeat(sizes.cumsum() - sizes, sizes)
                    z = np.bincount(row, value * beta[place], len(y)) + beta[-1]
                more, weights = residuals(y, w, z)
                sums += more
                for k, r in enumerate(weights):
                    if dense:
                        gradients[k, :-1] += r @ x
                    else:
                        gradients[k] += np.bincount(place, value * r[row], width)
                    gradients[k, -1] += r.sum()
        whole = np.concatenate([sums, gradients.ravel()])
        parts = [whole[a : a + BLOCK] for a in range(0, len(whole), BLOCK)]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(len(parts)), pa.int32()), "v": pa.array(parts, pa.list_(pa.float64()))})

    return work


def _evaluate(blocks: DataFrame, beta: np.ndarray, n_sums: int, n_gradients: int, residuals: Callable) -> tuple[np.ndarray, np.ndarray]:
    parts = summed(blocks.mapInArrow(_evaluation(beta, n_sums, n_gradients, residuals), "slot int, v array<double>"))
    if not parts:
        return np.zeros(n_sums), np.zeros((n_gradients, len(beta)))
    whole = np.concatenate([parts[k] for k in sorted(parts)])
    return whole[:n_sums], whole[n_sums:].reshape(n_gradients, -1)


# ── objectives ──────────────────────────────────────────────────────────────


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def logistic_residuals(y, w, z):
    return np.array([(w * (_softplus(z) - y * z)).sum()]), [w * (_sigmoid(z) - y)]


def pu_residuals(y, w, z):
    """Sums and gradients of the three risks apart: positives as positive, positives as negative, unlabelled as negative."""
    pos = y == 1
    wp, u = np.where(pos, w, 0.0), np.where(pos, 0.0, 1.0)
    up, down, p = _softplus(-z), _softplus(z), _sigmoid(z)
    sums = np.array([wp.sum(), u.sum(), (wp * up).sum(), (wp * down).sum(), (u * down).sum(), pos.sum(), np.where(pos, up, down).sum()])
    return sums, [wp * (p - 1), wp * p, u * p, np.where(pos, p - 1, p)]


def logistic_objective(rows: DataFrame, c: float) -> Objective:
    """C * sum(weight * log-loss) + |coefficients|^2 / 2; the intercept is not penalised."""
    blocks = blocks_of(rows)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray]:
        sums, gradients = _evaluate(blocks, beta, 1, 1, logistic_residuals)
        ridge = np.append(beta[:-1], 0.0)
        return c * sums[0] + 0.5 * (ridge @ ridge), c * gradients[0] + ridge

    return at


def pu_objective(rows: DataFrame, prior: float, penalty: float) -> Objective:
    """prior * P(+) + max(0, U(-) - prior * P(-)) + penalty * |coefficients|^2 / 2 with weighted means over positives.

    The second part counts, with its gradient, only while it is above 0: that is
    known once all tasks' parts are added up. With one class missing the
    objective is plain cross-entropy.
    """
    blocks = blocks_of(rows)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray]:
        (wp, nu, up, down, unl, n_pos, plain), (g_up, g_down, g_unl, g_plain) = _evaluate(blocks, beta, 7, 4, pu_residuals)
        ridge = np.append(beta[:-1], 0.0)
        value, gradient = 0.5 * penalty * (ridge @ ridge), penalty * ridge
        if not wp or not nu:
            n = max(n_pos + nu, 1.0)
            return value + plain / n, gradient + g_plain / n
        rest = unl / nu - prior * down / wp
        value, gradient = value + prior * up / wp, gradient + prior * g_up / wp
        return (value + rest, gradient + g_unl / nu - prior * g_down / wp) if rest > 0 else (value, gradient)

    return at


# ── descent ─────────────────────────────────────────────────────────────────


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient, turned by the curvature of past steps (limited-memory quasi-Newton); none: steepest descent."""
    q, alphas = gradient.copy(), []
    for s, y in reversed(past):
        alphas.append((s @ q) / (s @ y))
        q -= alphas[-1] * y
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(alphas), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def minimise(objective: Objective, width: int, steps: int, memory: int = 0, tolerance: float = 1e-6, first: float = 1.0) -> Linear:
    """Descent from 0 with halved steps until the objective falls enough; stops early where it no longer does."""
    beta = np.zeros(width + 1)
    value, gradient = objective(beta)
    path, past, length = [value], [], first
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < tolerance:
            break
        way = _direction(gradient, past)
        slope = gradient @ way
        if slope >= 0:
            past, way = [], -gradient
            slope = gradient @ way
        size = 1.0 if past else length / max(1.0, float(np.sqrt(-slope))) if memory else length
        for _ in range(30):
            there = beta + size * way
            found, turned = objective(there)
            if found <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if memory and (turned - gradient) @ (there - beta) > 1e-12:
            past = [*past, (there - beta, turned - gradient)][-memory:]
        length = length if memory else 2 * size
        if value - found < 1e-12 * max(1.0, abs(value)):
            beta, value, gradient = there, found, turned
            path.append(value)
            break
        beta, value, gradient = there, found, turned
        path.append(value)
    return Linear(beta[:-1], float(beta[-1]), tuple(path))


def fit_sparse_logistic(rows: DataFrame, width: int, c: float = 1.0, steps: int = 60) -> Linear:
    return minimise(logistic_objective(rows, c), width, steps, memory=8, tolerance=1e-4)


def fit_pu(rows: DataFrame, width: int, prior: float, steps: int = 40, penalty: float = 1e-3) -> Linear:
    """Steepest descent on the non-negative PU risk; ``w`` of positives is 1 / propensity."""
    return minimise(pu_objective(rows, prior, penalty), width, steps)


def with_logit(rows: DataFrame, model: Linear, output: str = "logit") -> DataFrame:
    """Adds the linear score; the model goes to the tasks with them (one double per feature)."""
    beta, intercept = model.coefficients, model.intercept

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, place, value = _matrix(batch)
                z = np.bincount(row, value * beta[place], batch.num_rows) + intercept
                yield batch.append_column(output, pa.array(z))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {output} double"
    return rows.mapInArrow(work, schema)
