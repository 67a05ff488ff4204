"""Poisson counts of bootstrap replicates for a block of rows, as whole-number arrays.

A row's uniforms are a Lehmer sequence (modulus 2^31 - 1, multiplier 48271) from
its start; replicate r takes the uniform after r + 1 steps, so any replicate is
drawn without those before it, and drawing it again gives the same count.
Blocks come as Arrow tables and go as a row per ``CHUNK`` replicates; the counts
themselves exist for one block and some replicates at a time.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have this package installed: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULUS, MULTIPLIER = 2**31 - 1, 48271
#: Replicates that share a row, each in columns of its own.
CHUNK = 8
#: Counts drawn at a time.
COUNTS = 1 << 16


def poisson_limits() -> list[int]:
    """Largest uniform of each count 0, 1, ... of a Poisson variable of mean 1."""
    out, share, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 13):
        share += term
        out.append(math.floor(MODULUS * share))
        term /= k
    return out


def poisson_counts(start: np.ndarray, replicates: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Some replicates and their counts (replicate x row), which the next step overwrites.

    All arrays are made once: fresh memory would cost more than the arithmetic.
    """
    n, limits = len(start), poisson_limits()
    most = min(replicates, max(1, COUNTS // n))
    jumps = np.array([pow(MULTIPLIER, r + 1, MODULUS) for r in range(replicates)], np.uint64)[:, None]
    x = start.astype(np.uint64)
    product, high = np.empty((most, n), np.uint64), np.empty((most, n), np.uint64)
    uniform, lower = np.empty((most, n), np.uint32), np.empty((most, n), np.uint32)
    above, counts = np.empty((most, n), bool), np.empty((most, n), np.uint8)
    for first in range(0, replicates, most):
        part = slice(first, min(first + most, replicates))
        p, h, u, v, a, c = (z[: part.stop - first] for z in (product, high, uniform, lower, above, counts))
        # 2^31 is 1 by the modulus: both halves add up to the product, or to that and the modulus once more.
        np.multiply(x, jumps[part], out=p)
        np.right_shift(p, np.uint64(31), out=h)
        np.bitwise_and(p, np.uint64(MODULUS), out=p)
        np.add(p, h, out=p)
        np.copyto(u, p, casting="unsafe")
        np.subtract(u, np.uint32(MODULUS), out=v)  # wraps to a large number if it is below
        np.minimum(u, v, out=u)
        c[:] = 0
        for limit in limits:
            np.greater(u, np.uint32(limit), out=a)
            if not a.any():
                break
            np.add(c, a.view(np.uint8), out=c)
        yield part, c


def in_chunks(block: int, **columns: np.ndarray) -> pa.Table:
    """A row per ``CHUNK`` replicates of a block, with a column per name and place in the chunk."""
    wide = {n: v.reshape(-1, CHUNK) for n, v in columns.items()}
    chunks = len(next(iter(wide.values())))
    out = {"_b": np.full(chunks, block, np.int64), "_chunk": np.arange(chunks, dtype=np.int64)}
    return pa.table(out | {f"{n}{j}": np.ascontiguousarray(v[:, j]) for j in range(CHUNK) for n, v in wide.items()})


def block_totals(chunks: int) -> Callable[[pa.Table], pa.Table]:
    """Rows (_b, _y, _x) of one block to the positives (_p) and all rows (_a) drawn in each replicate."""
    replicates = chunks * CHUNK

    def work(rows: pa.Table) -> pa.Table:
        y = rows["_y"].to_numpy()
        start, n_pos = rows["_x"].to_numpy()[np.argsort(~y, kind="stable")], int(y.sum())  # positives come first
        p, a = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        for part, counts in poisson_counts(start, replicates):
            p[part] = counts[:, :n_pos].sum(axis=1, dtype=np.int64)
            a[part] = p[part] + counts[:, n_pos:].sum(axis=1, dtype=np.int64)
        return in_chunks(rows["_b"][0].as_py(), _p=p, _a=a)

    return work


def block_terms(chunks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (_b, score, _y, _x) of one block and what is ahead of it (_p<j>a, _a<j>a by _chunk) to the sum, per
    replicate, of the positives drawn at each score times the precision there (_s)."""
    replicates = chunks * CHUNK

    def work(rows: pa.Table, ahead: pa.Table) -> pa.Table:
        order = np.argsort(-rows["score"].to_numpy(), kind="stable")
        score, y, start = (rows[c].to_numpy()[order] for c in ("score", "_y", "_x"))
        sums = np.zeros(replicates)
        # Rows of one score are peers: precision is taken at the last of them, if any is positive.
        positive, seen = np.flatnonzero(y), np.cumsum(y)
        last = np.flatnonzero(np.append(score[1:] != score[:-1], True))
        last = last[np.diff(seen[last], prepend=0) > 0]
        if len(last):
            by_chunk = np.argsort(ahead["_chunk"].to_numpy())
            p_ahead, a_ahead = (
                np.stack([ahead[f"{n}{j}a"].to_numpy()[by_chunk] for j in range(CHUNK)], axis=1).reshape(-1, 1) for n in ("_p", "_a")
            )
            for part, counts in poisson_counts(start, replicates):
                p = np.take(np.cumsum(np.take(counts, positive, axis=1), axis=1, dtype=np.int32), seen[last] - 1, axis=1)
                a = np.take(np.cumsum(counts, axis=1, dtype=np.int32), last, axis=1)
                here = np.diff(p, axis=1, prepend=0)
                sums[part] = (here * ((p + p_ahead[part]) / np.maximum(a + a_ahead[part], 1))).sum(axis=1)
        return in_chunks(rows["_b"][0].as_py(), _s=sums)

    return work
