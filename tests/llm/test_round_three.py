"""WARC transactions, periodic runs and grid codes against plain Python."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import grid_codes, periodic_runs, queries, warc
from helpers import DOCS, documents, words

# ── WARC ────────────────────────────────────────────────────────────────────

PAGES = "page_id long, url string, html string, digest string, first long, n long"


def archived(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    files = warc.write_archives(pages, f"file://{tmp_path}/warc", **options)
    return warc.read_records(files, payloads=True)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "<p>é</p>", "x" * 300_000, "\r\n\r\nWARC/1.1\r\n", "a", "b"]
    rows = [(i, rng.choice([f"http://h{i}.org/a?b", None, "bad\r\nWARC-Type: x", "http://[", "é"]), rng.choice(texts), "d", 1, 2) for i in range(60)]
    rows += [(None, "http://n.org", "only once", None, None, None), (None, "http://n.org", "a", None, None, None)]
    captures = warc.assemble(archived(spark, rows, tmp_path, file_bytes=4000))
    found = warc.resolve_revisits(captures, warc.metadata_field("page-id").cast("long"))
    got = {}
    for r in found.select("*", warc.metadata_field("page-id").alias("page")).collect():
        assert len(r.requests) == 1 and len(r.metadata) == 1
        got[r.page and int(r.page), r.payload_digest] = (r.payload_bytes, r.capture.record_type, r.first and r.first.order, r.capture.payload)
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = {}
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        own = first.get(html or "", page) == page
        want[page, digest(html)] = (len(raw), "response" if own else "revisit", None if own else first[html or ""], bytearray(raw) if own else None)
    assert got == want


def test_archives_repeated_rows_and_least(spark, tmp_path):
    rows = [(4, "u", "same", None, None, None)] * 3 + [(9, "v", "same", None, None, None), (5, "v", "", None, None, None), (6, "v", None, None, None, None)]
    captures = warc.assemble(archived(spark, rows, tmp_path, least=1))
    kinds = sorted((r.page, r.kind) for r in captures.select(warc.metadata_field("page-id").alias("page"), F.col("capture.record_type").alias("kind")).collect())
    assert kinds == [("4", "response")] * 3 + [("5", "response"), ("6", "response"), ("9", "revisit")]


def test_archives_empty(spark, tmp_path):
    assert warc.assemble(archived(spark, [], tmp_path)).count() == 0


def record(kind, name, block=b"", named=(), more=""):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"WARC-Concurrent-To: <{x}>\r\n" for x in named) + more
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_assembly_follows_links_either_way(spark, tmp_path):
    http = "Content-Type: application/http; msgtype=response\r\n"
    first = [
        record("warcinfo", "i", b"software: x\r\n"),
        record("response", "r1", b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody", ["q1"], http),  # names its request
        record("request", "q2", named=["r2"]),
        record("metadata", "m1", b"via: x\r\nvia: y\r\n", ["q1"], "Content-Type:\r\n application/warc-fields\r\n"),
        record("metadata", "m2", named=["m1"]),  # three links from its response
        record("metadata", "lost", named=["nowhere"]),
        record("metadata", "both", named=["r2", "r1"]),
    ]
    second = [record("request", "q1"), record("response", "r2"), record("request", "q2", named=["r2"]), record("response", "alone")]
    (tmp_path / "a.warc").write_bytes(b"".join(first))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, second)))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", 1) for n in ("a.warc", "b.warc.gz")], "path string, n_bytes long")
    records = warc.read_records(files).withColumn("capture_id", F.lit(1)).drop("capture_id")
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for k, r in got.items()} == {
        "r1": (["q1"], ["both", "m1", "m2"]), "r2": (["q2"], []), "alone": ([], []),
    }
    assert got["r1"].capture.first_line == "HTTP/1.1 404 Not Found" and got["r1"].capture.payload_digest == digest("body")
    assert [(f.name, f.value) for f in got["r1"].metadata[1].fields] == [("via", "x"), ("via", "y")]
    assert sorted(r.record_id for r in warc.orphans(records).collect()) == ["i", "lost"]


def test_broken_archives_are_named(spark, tmp_path):
    for name, raw in (("cut", record("response", "r", b"12345")[:-8]), ("odd", b"nonsense\r\n")):
        (tmp_path / name).write_bytes(raw)
        files = spark.createDataFrame([(f"file://{tmp_path}/{name}", 1)], "path string, n_bytes long")
        with pytest.raises(Exception, match=f"record 0 of file://.*{name}"):
            warc.read_records(files).collect()


def test_object_store_names():
    seen = []

    class Stand:
        from_uri = staticmethod(lambda uri: seen.append(uri) or (None, ""))

    real, warc.fs.FileSystem = warc.fs.FileSystem, Stand
    try:
        warc.store_of("s3a://bucket/x")
        warc.store_of("file:///x")
    finally:
        warc.fs.FileSystem = real
    assert seen == ["s3://bucket/x", "file:///x"]


# ── periodic runs ───────────────────────────────────────────────────────────


def plain_runs(ws, least=6, exponent=4):
    found = {}
    for q in range(1, len(ws) // exponent + 1):
        i = q
        while i < len(ws):
            j = i
            while j < len(ws) and ws[j] == ws[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i - q, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, plant):
    ws = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ws)
    if plant and doc_id is not None and h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(ws), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(ws) if i not in gone)),
    )


def repeating(rng):
    out = []
    for _ in range(rng.randrange(7)):
        block = [rng.choice("abcde") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 12))]
        out += block * rng.randrange(1, 8) + block[: rng.randrange(len(block))]
    return rng.choice([" ", "\n", " \t "]).join(out)


def test_runs_equal_plain_python(spark, tmp_path):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in documents(rng, 120)] + [(1000 + i, repeating(rng)) for i in range(400)]
    rows += [(-5, "z " * 20_000), (3001, "a b c " * 3000 + "d"), (3001, "a b c " * 3000 + "d"), (None, "q " * 30), (None, None), (3002, "É É É É É É\u00a0")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, runs int").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_row(d, t, True)) for d, t in rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (1, 5), (40, 4)])
def test_runs_of_random_words(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        ws = repeating(rng).split()
        numbers = {}
        ids = np.array([numbers.setdefault(w, i) for i, w in enumerate(ws)], np.int64)
        got = [tuple(map(int, r)) for r in periodic_runs.find_runs(ids, least, exponent)]
        assert got == sorted(plain_runs(ws, least, exponent), key=lambda r: (r[0], r[2]))


def test_one_word_many_times_is_not_quadratic():
    assert periodic_runs.find_runs(np.zeros(400_000, np.int64)).tolist() == [[0, 400_000, 1]]


# ── grid codes ──────────────────────────────────────────────────────────────


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    side = len(kept[0][1]) // parts
    cut = [[v[p * side : (p + 1) * side] for p in range(parts)] for _, v, _ in kept]
    book = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [best(p, c[p])[1] for c in cut]
            for e in set(chosen):
                mine = [c[p] for c, x in zip(cut, chosen, strict=True) if x == e]
                book[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [best(p, c[p]) for p in range(parts)]
        out.append((i, label, [e for _, e in found], sum(d for d, _ in found)))
    return out, book


def vectors(rng, n, dims, scale):
    return [(int(i), rng.normal(0, scale, dims).astype(np.float32).tolist(), rng.choice([1, 2, None])) for i in range(n)]


EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, codes int"


@pytest.mark.parametrize(("n", "scale", "entries"), [(700, 0.2, 64), (300, 0.01, 64), (30, 3.0, 64), (200, 1e6, 16), (60, 1e12, 8)])
def test_codes_equal_plain_python(spark, n, scale, entries):
    rng = np.random.default_rng(n)
    rows = vectors(rng, n, 16, scale)
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [0.0] * 15, 1), (n + 4, [float("inf")] * 16, 1)]
    rows += odd + [rows[3], rows[3], (None, rows[5][1], None), (rows[7][0], rows[8][1], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], EMBEDDINGS).repartition(4)
    coded, book = grid_codes.grid_codes(df, parts=4, entries=entries)
    want, plain = plain_codes(rows, 4, entries, 2)
    assert book == plain
    got = grid_codes.with_label_errors(coded).collect()
    assert sorted(str((r.vec_id, r.label, list(r.codes), r.error)) for r in got) == sorted(str((i, x, c, e if e < 2**63 else None)) for i, x, c, e in want)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert all(r.label_error == (s if (s := sums[r.label]) < 2**63 and r.error is not None else r.label_error) for r in got)


def test_codes_of_few_or_no_rows(spark):
    df = spark.createDataFrame([], EMBEDDINGS)
    coded, book = grid_codes.grid_codes(df)
    assert coded.count() == 0 and book == []
    row = (1, [0.5] * 16, None, "x", 1)
    coded, book = grid_codes.grid_codes(spark.createDataFrame([row, (2, [0.5] * 32, 1, "x", 1)], EMBEDDINGS))
    assert [(r.vec_id, r.codes, r.error) for r in coded.collect()] == [(1, [0] * 16, 0)] and len(book[0]) == 1
    with pytest.raises(ValueError, match="equal parts"):
        grid_codes.grid_codes(spark.createDataFrame([(1, [0.5] * 15, 1, "x", 1)], EMBEDDINGS))


def test_cells_forgotten_and_kept_agree():
    rng = np.random.default_rng(2)
    for k, d, scale in ((64, 4, 30), (5, 1, 3), (17, 3, 1000), (1, 2, 5)):
        entries = rng.integers(-scale, scale + 1, (k, d))
        grids = [grid_codes.Grid(entries, memo=m) for m in (3, 1 << 14)]
        for _ in range(4):
            points = rng.integers(-2 * scale, 2 * scale + 1, (200, d))
            squared = ((points[:, None] - entries) ** 2).sum(2)
            for grid in grids:
                codes, least = grid.nearest(points)
                assert (codes == squared.argmin(1)).all() and (least == squared.min(1)).all()


def test_registered_documents_match_contract_columns(spark):
    for name in ("op11_warc_transactions", "op12_periodic_runs", "op13_grid_codes"):
        assert name in queries.QUERIES and name in queries.SQL
    assert DOCS
