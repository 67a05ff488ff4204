"""Token ids in files of directly addressable codes.

A file holds the ids of whole documents. Each id is split into eight-bit chunks:
level 0 has the lowest chunk of every id, level k the next chunk of the ids that
go on. A level's bitmap says which of its chunks go on, and a rank directory
counts the set bits before every block of 512, so that the place of an id's next
chunk is one directory entry and at most 64 bytes of bitmap away. Any id is read
with a few small range reads and nothing else is decoded.

Layout, little-endian: magic (8 bytes); a header of 64-bit numbers (documents,
tokens, levels, then per level: chunks); doc_id column (8 bytes each); doc_id
validity (1 byte each); document starts (documents + 1); then per level: chunks,
bitmap padded to 64 bytes, rank directory. Sections start at multiples of 8.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, materialise, ready, scratch_path
from cohortlens.llm.shingles import slices, utf8
from cohortlens.llm.tokens import shared_encoder, with_end

MAGIC = b"DACODES1"
BLOCK = 512
#: Ids after which a task closes a file, and text that is encoded at a time.
FILE_TOKENS, SLICE_BYTES = 4_000_000, 4 << 20
#: Files that a reading task takes.
FILES_PER_TASK = 16


def _padded(raw: bytes, to: int = 8) -> bytes:
    return raw + bytes(-len(raw) % to)


def encode_file(doc_ids: np.ndarray, valid: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bits, np.cumsum(ones) - ones))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels), *[level[0] for level in levels]], np.int64)
    parts = [MAGIC, head.tobytes(), doc_ids.astype(np.int64).tobytes(), _padded(valid.astype(np.uint8).tobytes()), starts.astype(np.int64).tobytes()]
    for _, chunk, bits, ranks in levels:
        parts += [_padded(chunk.tobytes()), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class CodeFile:
    """Reads a file in ranges: ``read(offset, length) -> bytes``."""

    def __init__(self, read) -> None:
        self._read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.docs, self.tokens, n = self._numbers(8, 3)
        sizes = self._numbers(32, n)
        at = 32 + 8 * n
        self._ids, at = at, at + 8 * self.docs
        self._valid, at = at, at + self.docs + -self.docs % 8
        self._starts, at = at, at + 8 * (self.docs + 1)
        self._levels = []
        for size in sizes:
            bits = at + size + -size % 8
            ranks = bits + -(-size // BLOCK) * (BLOCK // 8)
            self._levels.append((at, bits, ranks))
            at = ranks + 8 * -(-size // BLOCK)

    def _numbers(self, at: int, n: int) -> list[int]:
        return np.frombuffer(self._read(at, 8 * n), np.int64).tolist()

    def _rank(self, bits: int, ranks: int, i: int) -> int:
        """Set bits of a level before place i."""
        block = i // BLOCK
        if i % BLOCK == 0 and block * BLOCK == i:
            upto = b""
        else:
            upto = self._read(bits + block * (BLOCK // 8), -(-(i % BLOCK) // 8))
        known = np.frombuffer(upto, np.uint8).copy()
        if i % 8 and len(known):
            known[-1] &= (1 << (i % 8)) - 1
        before = self._read(ranks + 8 * block, 8)
        return int(np.frombuffer(before, np.int64)[0]) + int(np.bitwise_count(known).sum()) if before else 0

    def token(self, i: int) -> int:
        """The id at place i of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k, (codes, bits, ranks) in enumerate(self._levels):
            out |= self._read(codes + i, 1)[0] << (8 * k)
            if not self._read(bits + i // 8, 1)[0] >> (i % 8) & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids from place ``begin`` to before ``end``."""
        total = end - begin
        out = np.zeros(total, np.uint32)
        where = np.arange(total)
        for k, (codes, bits, ranks) in enumerate(self._levels):
            if begin == end:
                break
            out[where] |= np.frombuffer(self._read(codes + begin, end - begin), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            flags = np.unpackbits(np.frombuffer(self._read(bits + begin // 8, -(-end // 8) - begin // 8), np.uint8), bitorder="little")
            where = where[flags[begin % 8 : begin % 8 + end - begin].astype(bool)]
            if k + 1 == len(self._levels):
                break
            begin = self._rank(bits, ranks, begin) if len(where) else 0
            end = begin + len(where)
        return out

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id column, its validity, and the starts of the documents."""
        ids = np.frombuffer(self._read(self._ids, 8 * self.docs), np.int64)
        valid = np.frombuffer(self._read(self._valid, self.docs), np.uint8).astype(bool)
        return ids, valid, np.frombuffer(self._read(self._starts, 8 * (self.docs + 1)), np.int64)


def open_codes(path: str) -> CodeFile:
    """A file by path or URI of any store that pyarrow knows, read in ranges."""
    store, name = fs.FileSystem.from_uri(path)
    source = store.open_input_file(name)
    return CodeFile(lambda at, length: source.read_at(length, at))


def _write(tokenizer: str, end_id: int, root: str, file_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        store, folder = fs.FileSystem.from_uri(root)
        part, held, names, count, seq = TaskContext.get().partitionId(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([np.diff(h[1]) for h in held])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            valid = ~doc_ids.is_null().to_numpy(zero_copy_only=False)
            raw = encode_file(doc_ids.fill_null(0).to_numpy(), valid, starts, ids)
            # An attempt's files count only if its rows reach the manifest; others stay unread.
            name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.codes"
            with store.open_output_stream(f"{folder}/{name}") as sink:
                sink.write(raw)
            row = {"part": part, "seq": seq, "path": f"{root}/{name}", "n_docs": len(doc_ids), "n_tokens": len(ids), "n_bytes": len(raw)}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            data, starts = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for a, b in slices(starts, SLICE_BYTES):
                held.append(with_end(*encoder.encode(batch.column("text").slice(a, b - a)), end_id))
                names.append(doc_ids.slice(a, b - a))
                count += len(held[-1][0])
                if count >= file_tokens:
                    yield close()
                    held, names, count, seq = [], [], 0, seq + 1
        if held:
            yield close()

    return work


def write_codes(docs: DataFrame, tokenizer: str, end_id: int, root: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order under ``root``; returns the manifest.

    One manifest row per file: part, seq, path, n_docs, n_tokens, n_bytes and
    start (ids in all files before it). Null texts are empty: they have the end
    id alone. Rows without doc_id come first; rows of one doc_id stand in the
    order of their texts' hashes. Other columns are not read. No rows: no files.
    """
    spark = ready(docs.sparkSession)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    order = ["doc_id", "_order"]
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_order", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "part long, seq long, path string, n_docs long, n_tokens long, n_bytes long"
    manifest = materialise(arrow_map(rows, _write(tokenizer, end_id, root, file_tokens), schema), "manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            codes = open_codes(path)
            doc_ids, valid, starts = codes.documents()
            for a, b in slices(starts * 4, SLICE_BYTES):
                ids = codes.slice(int(starts[a]), int(starts[b])).astype("<u4")
                cut = (starts[a : b + 1] - starts[a]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[a:b], mask=~valid[a:b]),
                        pa.array(starts[a:b] + start),
                        pa.array(np.diff(starts[a : b + 1])),
                        pa.array([zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids, decoded from the files."""
    files = manifest.select("path", "start")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(manifest.count() / FILES_PER_TASK))
    return arrow_map(files.repartition(tasks, "path"), _read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def code_root(docs: DataFrame) -> str:
    """A fresh folder for files under the shared scratch folder, as a URI."""
    path = scratch_path(docs.sparkSession, "codes")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
