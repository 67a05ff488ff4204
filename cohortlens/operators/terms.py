"""Words and adjacent pairs of notes, counted and weighted in Arrow batches.

A batch is cut into slices of bounded size, whose words become numbers: pairs
are numbers as well, so counting sorts numbers instead of texts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words or terms that a task holds as numbers at a time; one note is never cut.
SLICE = 1 << 21

TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


def _sizes(lists: pa.Array) -> np.ndarray:
    """Entries of each list; of a list of lists, those of the inner ones. A missing list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if not pa.types.is_list(lists.type.value_type):
        return sizes
    ends = np.concatenate([[0], np.cumsum(_sizes(lists.flatten()))])
    last = np.cumsum(sizes)
    return ends[last] - ends[last - sizes]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose lists in ``column`` hold about ``SLICE`` entries together."""
    for batch in batches:
        if batch.num_rows:
            cuts = np.flatnonzero(np.diff(np.cumsum(_sizes(batch.column(column)), dtype=np.int64) // SLICE)) + 1
            ends = [*cuts.tolist(), batch.num_rows]
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                yield batch.slice(a, b - a)


def _rows(lists: pa.Array) -> np.ndarray:
    """The row of each list entry."""
    return np.repeat(np.arange(len(lists), dtype=np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _offsets(rows: np.ndarray, n: int, missing: pa.Array | None = None) -> pa.Array:
    """List offsets of entries whose ``rows`` ascend."""
    at = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return at if missing is None else pc.if_else(pa.concat_arrays([missing, pa.array([False])]), pa.scalar(None, pa.int32()), at)


class _Coded:
    """Words of lists as numbers: a word is its place among the ``names``, a pair n + first * n + second."""

    def __init__(self, lists: pa.Array):
        row, words = _rows(lists), lists.flatten().dictionary_encode()
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        same = row[1:] == row[:-1]
        self.names, self.n = words.dictionary, max(len(words.dictionary), 1)
        self.width = self.n * (self.n + 1)
        pairs = self.n + ids[:-1][same] * self.n + ids[1:][same]
        self.row, self.code = np.concatenate([row, row[1:][same]]), np.concatenate([ids, pairs])

    def per_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and count of the different terms of each row; rows ascend."""
        both, tf = np.unique(self.row * self.width + self.code, return_counts=True)
        return both // self.width, both % self.width, tf

    def terms(self, code: np.ndarray) -> pa.Array:
        single = code < self.n
        out = [self.names.take(pa.array(code[single]))]
        first, second = self.names.take(pa.array(code[~single] // self.n - 1)), self.names.take(pa.array(code[~single] % self.n))
        out.append(pc.binary_join_element_wise(first, second, " "))
        place = np.empty(len(code), np.int64)
        place[np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])] = np.arange(len(code))
        return pa.concat_arrays(out).take(pa.array(place))


def counted(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, words) to (key, terms): words and pairs of neighbours with their counts; a missing list stays missing."""

    def run(batches):
        for part in _slices(batches, "_words"):
            lists = part.column("_words")
            coded = _Coded(lists)
            row, code, tf = coded.per_row()
            entries = pa.StructArray.from_arrays([coded.terms(code), pa.array(tf, pa.int32())], fields=list(TERMS.value_type))
            terms = pa.ListArray.from_arrays(_offsets(row, part.num_rows, lists.is_null() if lists.null_count else None), entries, type=TERMS)
            yield pa.RecordBatch.from_arrays([part.column(key), terms], [key, "terms"])

    return run


def _summed(term: pa.Array, cf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], ["term", "cf", "df"])


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(terms) to (term, cf, df): counts of each term over a slice of rows."""
    for part in _slices(batches, "terms"):
        entries = part.column("terms").flatten()
        term = entries.field("term").dictionary_encode()
        ids = term.indices.to_numpy(zero_copy_only=False)
        cf = np.bincount(ids, entries.field("tf").to_numpy(zero_copy_only=False), len(term.dictionary))
        yield _summed(term.dictionary, cf.astype(np.int64), np.bincount(ids, minlength=len(cf)))


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words) to (term, cf, df): counts of each word and pair over a slice of rows."""
    for part in _slices(batches, "_words"):
        coded = _Coded(part.column("_words"))
        code, cf = np.unique(coded.code, return_counts=True)
        _, each, _ = coded.per_row()
        yield _summed(coded.terms(code), cf, np.unique(each, return_counts=True)[1])


def weighted(key: str, names: pa.Array, idf: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, texts) to (key, idx, val): unit vectors over the terms ``names``, by place; other terms are left out.

    ``texts`` holds the words of each text of the key; a term has an entry per text.
    """
    split = pc.split_pattern(names, " ")
    pieces = pc.unique(split.flatten())
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    word = pc.index_in(split.flatten(), value_set=pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    n = max(len(pieces), 1)
    single = np.full(n + 1, -1)  # the last place is for words of no term
    single[word[start[size == 1]]] = np.flatnonzero(size == 1)
    pair, place = word[start[size == 2]] * n + word[start[size == 2] + 1], np.flatnonzero(size == 2)
    pair, place = np.append(pair[np.argsort(pair)], -1), np.append(place[np.argsort(pair)], -1)

    def run(batches):
        for part in _slices(batches, "texts"):
            texts = part.column("texts").flatten()
            owner, text, words = _rows(part.column("texts")), _rows(texts), texts.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(words.dictionary, value_set=pieces), n).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = known[words.indices.to_numpy(zero_copy_only=False)]
            both = np.flatnonzero((text[1:] == text[:-1]) & (ids[1:] < n) & (ids[:-1] < n))
            code = ids[both] * n + ids[both + 1]
            at = np.searchsorted(pair[:-1], code)
            idx = np.concatenate([single[ids], np.where(pair[at] == code, place[at], -1)])
            text = np.concatenate([text, text[both]])
            entry, tf = np.unique(text[idx >= 0] * len(names) + idx[idx >= 0], return_counts=True)
            text, idx = np.divmod(entry, max(len(names), 1))
            row, weight = owner[text], (1 + np.log(tf)) * idf[idx]
            if len(owner) > len(np.unique(owner)):  # a key of several texts
                order = np.lexsort((weight, idx, row))
                row, idx, weight = row[order], idx[order], weight[order]
            norm = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
            at = _offsets(row, part.num_rows)
            lists = [pa.ListArray.from_arrays(at, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(at, pa.array(weight / norm[row], pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(key), *lists], [key, "idx", "val"])

    return run
