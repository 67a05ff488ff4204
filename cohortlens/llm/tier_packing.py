"""Packs documents into sequences of several lengths, long windows first.

A document is cut into full long windows; what remains is routed to the
shortest tier (a power of two) that takes it whole. Tiers are packed from the
longest to the shortest: a window starts with the longest piece left, its gap
takes whole pieces of shorter tiers, longest first, and a last gap takes the
front of the shortest piece that is longer than it. So every window is exactly
full, but for the last one of a block of about four million tokens. A block's
sequences are dealt in turn to step groups, longest tier first: all steps of a
block get the same number of each tier's sequences, give or take one.

Blocks are runs of a task's rows, so nothing is shuffled and a task holds one
block of ids at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, ready
from cohortlens.llm.shingles import slices, utf8
from cohortlens.llm.tokens import shared_encoder, with_end

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS, STEP_TOKENS, SLICE_BYTES = 4_000_000, 65_536, 4 << 20

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_id long, ids binary"
)


def plan_block(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of a block: (tier, pieces), a piece being (document, start, length); sizes are at least 1."""
    longest = tiers[-1]
    windows = [(longest, [(d, at, longest)]) for d, n in enumerate(sizes) for at in range(0, n - longest + 1, longest)]
    # (length, document, start), ascending: the pool of pieces that have no place yet.
    pool = sorted((n % longest, d, n - n % longest) for d, n in enumerate(sizes) if n % longest)
    while pool:
        length, d, at = pool.pop()
        tier = tiers[bisect_left(tiers, length)]
        pieces, gap = [(d, at, length)], tier - length
        while gap and pool:
            k = bisect_right(pool, (gap, len(sizes), 0)) - 1
            if k >= 0:
                length, d, at = pool.pop(k)
            else:
                whole, d, at = pool.pop(0)
                length = gap
                rest = (whole - gap, d, at + gap)
                pool.insert(bisect_left(pool, rest), rest)
            pieces.append((d, at, length))
            gap -= length
        windows.append((tier if not gap else longest, pieces))
    return windows


def _pack(tokenizer: str, end_id: int, tiers: tuple[int, ...], block_tokens: int, step_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[pa.Array] = []
        count = done = steps_done = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal done, steps_done
            ids = np.concatenate([h[0] for h in held]).astype("<u4")
            sizes = np.concatenate([np.diff(h[1]) for h in held])
            starts = np.cumsum(sizes) - sizes
            windows = sorted(plan_block(sizes.tolist(), tiers), key=lambda w: -w[0])
            steps = max(1, round(len(ids) / step_tokens))
            rows = [
                (d, at, length, done + k, tiers_of, steps_done + k % steps)
                for k, (tiers_of, pieces) in enumerate(windows)
                for d, at, length in pieces
            ]
            table = np.array(rows, np.int64)
            doc, at, length, sequence, tier, step = table.T
            ends = np.cumsum(length)
            first = np.ones(len(doc), bool)
            first[1:] = sequence[1:] != sequence[:-1]
            opening = (ends - length)[first]
            offset = ends - length - np.repeat(opening, np.diff(np.concatenate([np.flatnonzero(first), [len(doc)]])))
            doc_ids = pa.concat_arrays(names).take(pa.array(doc))
            raw = memoryview(ids).cast("B")
            begin = (starts[doc] + at) * 4
            for i in range(0, len(doc), 4096):
                s = np.s_[i : i + 4096]
                blobs = [bytes(raw[b : b + 4 * n]) for b, n in zip(begin[s].tolist(), length[s].tolist(), strict=True)]
                columns = [at[s], length[s], sizes[doc[s]], base + sequence[s], offset[s], tier[s], base + step[s]]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(i, 4096), *map(pa.array, columns), pa.array(blobs, pa.binary())],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
            done += len(windows)
            steps_done += steps

        for batch in batches:
            _, starts = utf8(batch.column("text"))
            for a, b in slices(starts, SLICE_BYTES):
                held.append(with_end(*encoder.encode(batch.column("text").slice(a, b - a)), end_id))
                names.append(batch.column("doc_id").slice(a, b - a))
                count += len(held[-1][0])
                if count >= block_tokens:
                    yield from close()
                    held, names, count = [], [], 0
        if held:
            yield from close()

    return work


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a packed sequence of ``docs`` (doc_id, text).

    doc_id, start and length in its document, doc_tokens (with the end id),
    sequence_id, offset there, tier (the sequence's length, the longest tier for
    one that needs padding), step_id, and ids (little-endian 32-bit). A null or
    empty text is the end id alone. Rows with a null or repeated doc_id are
    documents of their own. Other columns are not read. No rows give no rows.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return arrow_map(docs, _pack(tokenizer, end_id, tiers, block_tokens, step_tokens), SCHEMA)
