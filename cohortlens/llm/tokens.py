"""Token ids of whole texts, a batch at a time, with the public word tokenizer file.

The word tokenizer lower-cases, drops white space and never joins text across
a space, a line break, or between a letter and punctuation. So a text's ids
are the ids of its chunks between such places, in order. Each different chunk
is encoded by the library once and its ids are gathered for all its places. A chunk
of Latin letters alone is one word that the normalizer only lower-cases: it goes
straight to the tokenizer's model, in the model's alphabet of bytes.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa

from cohortlens.llm.shingles import ascii_lower, utf8

#: Chunks in the newer of two stores of known ids; when it is full it becomes the older one.
KEPT_CHUNKS = 400_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The byte alphabet: bytes that print in Latin-1 are themselves, the others follow from 256 on.
_ODD_BYTES = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_ALPHABET = {b: 256 + k for k, b in enumerate(_ODD_BYTES)}


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the texts in order, and how many of them each text has.

    Chunks end at spaces, line breaks and texts' ends, and before a comma or
    full stop that ends a chunk and follows a letter of A-Z. A-Z is lower-cased
    unless a special token's opening is in the batch: those match by case.
    """
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _GAP[data]
    first = np.zeros(n + 1, bool)  # a chunk may start here: after a gap or at a text's start
    first[starts] = True
    first[:-1] |= gap[:n]
    ends_here = gap[2:] | first[1:]
    stop = np.zeros(n, bool)
    stop[1:] = _STOP[data[1:]] & _LETTER[data[:-1]]
    first[:-1] |= stop & ends_here & ~first[:-1]
    solid = ~gap[1:-1]
    at = np.flatnonzero(first[:-1] & solid)
    kept = data[solid]
    if b"<|" not in data.tobytes():
        kept = ascii_lower(kept)
    place = np.cumsum(solid)
    offsets = np.concatenate([place[at] - 1, [len(kept)]]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return out, np.diff(np.searchsorted(at, starts))


class Encoder:
    """Ids of strings under the tokenizer file ``path`` (read on each worker)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        parts = json.loads(self._tokenizer.to_str())
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        steps = [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"]:
            raise ValueError("texts may be cut into chunks under the word tokenizer only")
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self._kept) > KEPT_CHUNKS:
            self._kept, self._older = {}, self._kept
        other = []
        for w in words:
            if w in self._kept:
                continue
            if w in self._older:
                self._kept[w] = self._older[w]
            elif _PLAIN.fullmatch(w):
                spelled = w.lower().encode().decode("latin-1").translate(_ALPHABET)
                self._kept[w] = np.array([t.id for t in self._model.tokenize(spelled)], np.uint32).tobytes()
            else:
                other.append(w)
        for i in range(0, len(other), 8192):
            part = other[i : i + 8192]
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
            end = 0
            for w, x in zip(part, ids, strict=True):
                begin, end = end, end + 4 * len(x)
                self._kept[w] = flat[begin:end]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's end among them (null: empty)."""
        places, counts = chunks(*utf8(texts))
        codes = places.dictionary_encode()
        words = codes.dictionary.to_pylist()
        self._learn(words)
        ids = [self._kept[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(sizes) - sizes
        at = codes.indices.to_numpy(zero_copy_only=False)
        long = sizes[at]
        ends = np.concatenate([[0], np.cumsum(long)])
        # Place p of the output holds flat[p - start of p's chunk there + first of that chunk's ids].
        out = flat[np.repeat(first[at] - ends[:-1], long) + np.arange(ends[-1])]
        return out, ends[np.cumsum(counts)]


def shared_encoder(path: str) -> Encoder:
    """The worker process's encoder for ``path``, kept between its tasks."""
    held = sys.modules.setdefault("cohortlens_encoders", types.ModuleType("cohortlens_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def with_end(ids: np.ndarray, ends: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the id ``last`` after each text, and the starts of all texts (n + 1 numbers)."""
    n = len(ends)
    out = np.empty(len(ids) + n, np.uint32)
    stops = ends + np.arange(n)
    plain = np.ones(len(out), bool)
    plain[stops] = False
    out[plain] = ids
    out[stops] = last
    return out, np.concatenate([[0], stops + 1]).astype(np.int64)
