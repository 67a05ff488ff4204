"""Periodic runs of words, found by a sparse match-length table over lags (diagonals).

A run of period q is a maximal stretch in which words q apart are equal. On the
diagonal of lag q every word of the run but the first q matches, so a diagonal
whose match length ends at (exponent - 1) * q or more is a run. A word that occurs
often would open a diagonal for each of its earlier occurrences. Lags are therefore
taken in classes a..b with 2 * b - 1 <= g = (exponent - 1) * a, and an earlier
occurrence counts for a lag of the class only if it ends g equal words; then

* every run of a period in the class holds such an occurrence at each word where g
  words of the run have gone by, and it is the nearest one: a nearer one would give
  those g words two periods, and by the periodicity lemma the run a smaller one;
* an occurrence whose lag is not the smallest period of its g words is not the
  nearest, so runs are never reported again at multiples of their period.

So a word opens or continues at most one diagonal per class, and there are about
log(n) classes. An occurrence at the same lag as at the word before it adds one to
that diagonal's match length; where the chain ends, the run is emitted. Equal g
words are found by doubling ranks, and what occurs once is left out at every step,
so later classes of ordinary text are nearly empty. Time is n log n per class for
any text, one word repeated without end included.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, ready
from cohortlens.llm.shingles import slices, utf8

#: Bytes of text whose words are compared at a time; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def _pairs(left: np.ndarray, right: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i at which left[i] and right[i + offset] both occur again, and one number per pair; -1 marks what occurs once."""
    n = len(left)
    if offset >= n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.flatnonzero((left[: n - offset] >= 0) & (right[offset:] >= 0))
    return places, left[places] * n + right[places + offset]


def _ranks(left: np.ndarray, offset: int) -> np.ndarray:
    """Numbers of the stretches twice as long; -1 for those that occur once."""
    out = np.full(len(left), -1, np.int64)
    places, keys = _pairs(left, left, offset)
    if len(places):
        _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[number] > 1
        out[places[again]] = number[again]
    return out


def _occurrences(places: np.ndarray, keys: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose nearest earlier occurrence lies low..high back, and that lag, by lag and place."""
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    lag = places[1:] - places[:-1]
    hit = (keys[1:] == keys[:-1]) & (lag >= low) & (lag <= high)
    at, lag = places[1:][hit], lag[hit]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def find_runs(words: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``words`` (numbers below len(words), equal for equal words), by start, then period."""
    n, found = len(words), []
    rank = np.where(np.bincount(words, minlength=1)[words] > 1, words, -1).astype(np.int64)
    width, low = 1, 1
    while exponent * low <= n:
        gram, high = (exponent - 1) * low, ((exponent - 1) * low + 1) // 2
        while 2 * width <= gram:
            rank = _ranks(rank, width)
            width *= 2
        places, keys = _pairs(rank, rank, gram - width)
        if not len(places):
            break
        at, lag = _occurrences(places, keys, low, high)
        if len(at):
            # The table of match lengths: one more than at the word before if that continued the same lag.
            opens = np.flatnonzero(np.r_[True, (np.diff(lag) != 0) | (np.diff(at) != 1)])
            matched = np.diff(np.r_[opens, len(at)]) + gram - 1
            period = lag[opens]
            length = matched + period
            enough = length >= np.maximum(least, exponent * period)
            found.append(np.stack([at[opens] - period, length, period], 1)[enough])
        low = high + 1
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _work(least: int, exponent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for a, b in slices(starts, SLICE_BYTES):
                texts, numbers, ends = [], [], [0]
                for i in range(a, b):
                    texts.append(data[starts[i] : starts[i + 1]].tobytes().split())  # bytes.split() parts at exactly space and 09..0D
                    # A word's number is the place of its first occurrence, so texts share no number.
                    first = map({}.setdefault, texts[-1], count(ends[-1]))
                    numbers.append(np.fromiter(first, np.int64, len(texts[-1])))
                    ends.append(ends[-1] + len(texts[-1]))
                runs = find_runs(np.concatenate(numbers), least, exponent)
                change = np.zeros(ends[-1] + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                offsets = np.searchsorted(runs[:, 0], ends)
                runs[:, 0] -= np.repeat(ends[:-1], np.diff(offsets))
                collapsed = []
                for ws, x, y in zip(texts, ends[:-1], ends[1:], strict=True):
                    here = kept[x:y]
                    collapsed.append(b" ".join(ws if here.all() else compress(ws, here.tolist())))
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)),
                        pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], ["start", "length", "period"]),
                    ),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return work


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period), collapsed.

    Words are maximal runs of characters other than space and U+0009..U+000D,
    numbered from 0. A run has at least ``least`` words and ``exponent`` (4 or
    more) times its smallest period; runs stand by start, then period. collapsed
    is the words joined by one space, without those that a run holds after its
    first period. Whole texts are read in one task each, of any length. A null or
    empty text has no words, no runs and an empty collapsed text. Rows of one
    doc_id and repeated rows give rows of their own, a null doc_id stays null.
    Other columns are not read. No rows give no rows.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    ready(docs.sparkSession)
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _work(least, exponent), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail written into the texts of every tenth doc_id, by crc32 of its decimal digits.

    With g = crc32 / 10 and n words, words from g % n on repeat with period
    1 + (n - g % n) / (3 + g % 8), rounded down. Other texts, and those without
    a word or a doc_id, stay as they are.
    """
    mark = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    ws = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    g, n = F.floor(mark / 10), F.size(ws)
    head = (g % n).cast("int")
    period = (1 + F.floor((n - head) / (3 + g % 8))).cast("int")
    times = F.ceil((n - head) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(ws, head + 1, period), times))
    planted = F.array_join(F.slice(F.concat(F.slice(ws, F.lit(1), head), tail), F.lit(1), n), " ")
    return docs.withColumn("text", F.when((mark % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(F.col("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text, from ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("b.s")).alias("start"),
        F.col("b.l").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.l div -b.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
