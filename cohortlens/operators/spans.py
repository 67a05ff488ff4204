"""Runs of characters cut into pieces, and pieces merged to words, in Arrow batches."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

try:
    from _md5 import md5  # for short keys less than half the time of the general constructor
except ImportError:
    from hashlib import md5

# Executors need not have this package installed: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = re.compile(r"[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")
PIECES = ("tok_start", "tok_end", "token", "value")  # one array each in a note's row


def cut(key: str, size: int, seed: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, texts) to (key, tok_start, tok_end, token, value): pieces of at most ``size`` characters of the runs that are not blank.

    The runs of several texts of a key take turns; offsets count the characters of all runs before.
    The value is uniform: the first 32 bits of the md5 of ``seed``, key and start.
    """
    piece = re.compile(rf"[^ \t\n\x0b\f\r]{{1,{size}}}")

    def pieces(texts: list[str], starts: list[int], tokens: list[str]) -> None:
        if len(texts) == 1 and "\x0b" not in texts[0] and "\f" not in texts[0]:  # every space is blank
            for found in piece.finditer(texts[0]):
                starts.append(found.start())
                tokens.append(found[0])
            return
        base = 0
        for run in (r for turn in zip_longest(*map(RUN.findall, texts)) for r in turn if r is not None):
            if run.strip(" \n\t\r"):
                for o in range(0, len(run), size):
                    starts.append(base + o)
                    tokens.append(run[o : o + size])
            base += len(run)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                starts, tokens, bits, ends = [], [], [], [0]
                for note, texts in zip(part.column(key).to_pylist(), part.column("texts").to_pylist()):
                    pieces(texts, starts, tokens)
                    head = "|".join([seed, *([] if note is None else [str(note)]), ""]).encode()
                    bits += [md5(head + b"%d" % s).digest()[:4] for s in starts[ends[-1] :]]
                    ends.append(len(starts))
                start, token = pa.array(starts, pa.int64()), pa.array(tokens, pa.string())
                value = pa.array(np.frombuffer(b"".join(bits), ">u4") / 4294967296.0)
                flat = [start, pc.add(start, pc.utf8_length(token).cast(pa.int64())), token, value]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c) for c in flat]
                yield pa.RecordBatch.from_arrays([part.column(key), *lists], [key, *PIECES])

    return run


def _follows(column: pa.Array) -> np.ndarray:
    """Whether a value equals the one before it; missing values are equal."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    return np.concatenate([[False], same.to_numpy(zero_copy_only=False)])


def _flat(rows: pa.RecordBatch, note: str) -> pa.Table:
    """Notes with arrays of pieces to one row per piece, sorted by note row, start and token."""
    of = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(rows.column("token")), 0))
    names = [*PIECES, "_open"]
    flat = pa.Table.from_arrays([pa.array(of), rows.column(note).take(pa.array(of)), *[pc.list_flatten(rows.column(c)) for c in names]], ["_of", note, *names])
    start = pc.fill_null(flat.column("tok_start").combine_chunks(), np.iinfo(np.int64).min).to_numpy()
    if ((of[1:] == of[:-1]) & (start[1:] <= start[:-1])).any():
        keys = [(c, "ascending") for c in ("_of", "tok_start", "token")]
        flat = flat.take(pc.sort_indices(flat, sort_keys=keys, null_placement="at_start"))
    return flat.drop_columns("_of")


def merged(note: str, arrays: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces (note, tok_start, tok_end, token, value, _open), sorted by note and start, to words (note, word, value, word_start).

    A piece continues a word when the piece before is ``_open`` and ends where it
    starts. Pieces with one start stay together. Only the last word of a batch is held.
    With ``arrays`` a row is a whole note and its pieces are arrays, in any order.
    """

    def words(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, int]:
        """The words of sorted rows, without the last one unless ``last``, and the rows they take."""
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        note_of, start, value = column[note], column["tok_start"], column["value"]
        same = _follows(note_of)
        meets = pc.fill_null(pc.equal(column["tok_end"].slice(0, len(rows) - 1), start.slice(1)), False)
        is_open = pc.fill_null(column["_open"].slice(0, len(rows) - 1), False)
        joined = same & np.concatenate([[False], pc.and_(meets, is_open).to_numpy(zero_copy_only=False)])
        # A word begins with the pieces of one start, if any of these does not continue another.
        peers = np.flatnonzero(~(same & _follows(start)))
        begins = np.zeros(len(rows), bool)
        begins[peers] = np.logical_or.reduceat(~joined, peers)
        at = np.flatnonzero(begins)
        end = len(rows) if last else int(at[-1])
        at = at[at < end]
        if not len(at):
            return None, end
        starts = pc.fill_null(start, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[:end]
        first = np.minimum.reduceat(starts, at)
        held = value.is_valid().to_numpy(zero_copy_only=False)[:end]
        total = np.add.reduceat(pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)[:end], at)
        token = pa.ListArray.from_arrays(pa.array(np.append(at, end), pa.int32()), pc.fill_null(column["token"], "").slice(0, end))
        out = [
            note_of.take(pa.array(at)),
            pc.binary_join(token, ""),
            pa.array(total, pa.float64(), mask=np.add.reduceat(held.astype(int), at) == 0),
            pa.array(first, pa.int64(), mask=first == np.iinfo(np.int64).max),
        ]
        return pa.RecordBatch.from_arrays(out, [note, "word", "value", "word_start"]), end

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                out, taken = words(rows, False)
                rest = rows.slice(taken)
                if out is not None:
                    yield out
        if rest is not None:
            yield words(rest, True)[0]

    def run_notes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = _flat(batch.slice(at, 500), note)
                if rows.num_rows:
                    yield words(rows, True)[0]

    return run_notes if arrays else run
