"""Token files, packing, sharding, mixing and top-k search against plain Python, and their laws."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import curriculum, direct_codes, kd_search, label_sharding, tier_packing, tokens
from helpers import DOCS, documents, prose, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return documents(random.Random(6)) + [(900, "<|endoftext|>A, b. <|ENDOFTEXT|> it's I'LL é, x. ... a., b", "en", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library(rows, plain):
    texts = [r[1] for r in rows] + ["ΑΣ ΣΑΣ́ Å é", "a\tb\x0bc\x85d　e", "x.", ".", ",\n.", "퟿,"]
    ids, ends = tokens.Encoder(PATH).encode(pa.array(texts))
    parts = np.split(ids, ends[:-1])
    assert [p.tolist() for p in parts] == [plain(t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1 << 31), (511, 300), (512, 70000), (513, 70000), (20000, 49408)])
def test_codes_give_random_access(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    raw = direct_codes.encode_file(np.array([5, 6]), np.array([True, False]), np.array([0, n // 2, n]), ids)
    codes = direct_codes.CodeFile(lambda at, length: raw[at : at + length])
    rng = random.Random(n)
    for i in [rng.randrange(n) for _ in range(300 if n else 0)]:
        assert codes.token(i) == ids[i]
    for _ in range(60):
        a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        assert (codes.slice(a, b) == ids[a:b]).all()
    assert codes.documents()[1].tolist() == [True, False]
    with pytest.raises(IndexError):
        codes.token(n)


def test_code_files_round_trip(docs, rows, plain, monkeypatch):
    monkeypatch.setattr(direct_codes, "SLICE_BYTES", 4000)
    manifest = direct_codes.write_codes(docs, PATH, 2, direct_codes.code_root(docs), file_tokens=3000)
    files = manifest.collect()
    assert len(files) > 2
    got = sorted(map(tuple, direct_codes.read_documents(manifest).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = Counter((r[0], len(x := plain(r[1], 2)), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert Counter((d, n, crc) for d, _, n, crc in got) == want
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    one = direct_codes.open_codes(files[0].path)
    assert one.token(one.tokens - 1) == 2
    empty = docs.limit(0)
    assert direct_codes.read_documents(direct_codes.write_codes(empty, PATH, 2, direct_codes.code_root(empty))).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2048], [5000, 1, 1], [1500] * 100, [3] * 500, "mixed"])
def test_plan_fills_windows(sizes):
    if sizes == "mixed":
        rng = random.Random(2)
        sizes = [rng.randrange(1, 5000) for _ in range(700)]
    windows, seen, short = tier_packing.plan_block(sizes), defaultdict(list), 0
    for tier, pieces in windows:
        total = sum(n for _, _, n in pieces)
        short += total != tier
        assert total <= tier and tier in tier_packing.TIERS
        for d, at, n in pieces:
            seen[d].append((at, n))
    assert short <= 1
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at and n > 0
            at += n
        assert at == size


def test_packed_pieces_hold_every_id(docs, rows, plain):
    got = tier_packing.pack(docs, PATH, 1, block_tokens=5000, step_tokens=4096).collect()
    ids = {r.doc_id: [] for r in got}
    by_sequence, steps = defaultdict(list), defaultdict(Counter)
    for r in got:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length
        by_sequence[r.sequence_id].append((r.offset, r.length, r.tier))
        ids[r.doc_id].append((r.start, part))
        steps[r.step_id][r.tier] += r.offset == 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at <= tier
    want = Counter(r[0] for r in rows)
    for r in rows:
        if want[r[0]] == 1:
            assert [x for _, part in sorted(ids[r[0]]) for x in part] == plain(r[1], 1)
    assert tier_packing.pack(docs.limit(0), PATH, 1).count() == 0


def balance(got, shards):
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    return [load[s] for s in range(shards)]


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(1500)]
    texts += [t for t in texts[:150] for _ in range(rng.randrange(1, 5))]
    texts += ["hot " * 30] * 800
    data = [(i, t, i % 3) for i, t in enumerate(texts)] + [(None, None, 0), (3, "", 0), (3, "", 0)]
    got = label_sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string, shard int"), 8).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    load = balance(got, 8)
    assert max(load) - min(load) <= 2 * max(r.size for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(set)
    for r in got:
        groups[(r.text_crc32, r.size)].add(r.shard)
    copies = Counter((r.text_crc32, r.size) for r in got)
    split = sum(len(groups[g]) > 1 for g, n in copies.items() if n > 1)
    assert split <= 0.1 * sum(n > 1 for n in copies.values())
    hot = (zlib.crc32(("hot " * 30).encode()), 128)
    assert len(groups[hot]) <= 8


def test_shards_of_few_rows(spark):
    schema = "doc_id long, text string"
    assert label_sharding.shard_documents(spark.createDataFrame([], schema), 4).count() == 0
    same = label_sharding.shard_documents(spark.createDataFrame([(i, "same") for i in range(40)], schema), 4).collect()
    assert max(balance(same, 4)) - min(balance(same, 4)) <= 24


def sharded_copies(spark, counts, shards=24):
    """Shards of each group of copies, for equal sizes; the groups' sizes are ``counts``."""
    texts = [f"text {i:06d}" for i, n in enumerate(counts) for _ in range(n)]
    got = label_sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards).collect()
    load = balance(got, shards)
    assert len(got) == len(texts) and max(load) - min(load) <= 2 * got[0].size
    name, found = {zlib.crc32(t.encode()): t for t in texts}, defaultdict(set)
    for r in got:
        found[name[r.text_crc32]].add(r.shard)
    return [found[f"text {i:06d}"] for i in range(len(counts))]


def test_shards_of_a_copy_heavy_table(spark):
    found = sharded_copies(spark, [10] * 970 + [1] * 300)
    assert all(len(s) == 1 for s in found)


def test_shards_full_of_copies_cut_few_groups(spark):
    rng = random.Random(5)
    found = sharded_copies(spark, [rng.randrange(2, 12) for _ in range(500)])
    assert sum(len(s) > 1 for s in found) < 24


def test_a_hot_group_lies_in_few_shards(spark):
    found = sharded_copies(spark, [1000] + [5] * 120 + [1] * 1400)
    assert len(found[0]) == 8
    assert sum(len(s) > 1 for s in found[1:]) <= 1


def test_copies_larger_than_a_shard(spark):
    assert len(set().union(*sharded_copies(spark, [2], 8))) == 2


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free -= full or free
    return target


def test_mix_meets_targets(docs, rows):
    got = curriculum.plan_mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies
        assert list(r.positions) == sorted(r.positions) and all(0 <= x <= 1 for x in r.positions)
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    for s in sizes:  # near to the target, unless every document left over is larger than the gap twice
        least = min(r.copies for r in got if r.source == s and r.size)
        left = [r.size for r in got if r.source == s and r.size and r.copies == least]
        assert abs(taken[s] - target[s]) <= max(10, min(left) / 2)
    again = curriculum.plan_mix(docs.repartition(7)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert curriculum.plan_mix(docs.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    schedules = (((0.0, 2.0), (0.5, 0.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 1.0)))
    data = [(i, "w " * 10, "abc"[i % 3], "x") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, position string")
    plan = curriculum.plan_mix(df, curriculum.Mix(weights=(1, 1, 1), schedules=schedules, share=1.0))
    at = {s: np.sort([x for r in rows for x in r.positions]) for s, rows in by_source(plan.collect()).items()}
    grid = np.linspace(0, 1, 21)
    demand = {"a": np.where(grid < 0.5, 2 * grid - 2 * grid**2, 0.5 + 2 * (grid - 0.5) ** 2), "b": grid, "c": grid**2}
    for s, want in demand.items():
        assert np.abs(np.searchsorted(at[s], grid) / len(at[s]) - want).max() < 0.01


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def test_mixed_documents_repeat_rows(docs, rows):
    plan = curriculum.plan_mix(docs).collect()
    got = curriculum.mixed_documents(docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in plan:
        want[(r.doc_id, r.size)] += r.copies
    assert Counter((r.doc_id, len(words(r.text))) for r in got.collect()) == +want


def plain_top(vectors, k=5):
    out = []
    for i, (a, x) in enumerate(vectors):
        if a % 50 == 0:
            best = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b) for j, (b, y) in enumerate(vectors) if i != j and len(x) == len(y))
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [64, 5000])
def test_top_k_equals_all_pairs(spark, shard_rows):
    rng = random.Random(9)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    data += [(2000 + i, [0.5] * 6) for i in range(300)]  # one common vector, and ties
    odd = [(3000, None), (3050, []), (3100, [1.0, None] + [0.0] * 4), (3150, [float("nan")] * 6), (3200, [float("inf")] * 6), (None, [1.0] * 6), (3250, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "s") for i, v in data + odd], "vec_id long, embedding array<float>, shard string")
    got = kd_search.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard_rows)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in [*data, (3250, [1.0, 2.0])]]
    assert sorted(map(tuple, got.collect())) == plain_top(whole)
    assert kd_search.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_components_beyond_64_bits(spark):
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    rng = random.Random(5)
    data = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-2, 24) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = kd_search.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, shard_rows=32)
    whole = [(i, [clip(int(np.floor(256 * x))) for x in v]) for i, v in data]
    want = []
    for a, x in whole[::50]:
        best = sorted((-clip(sum(p * q for p, q in zip(x, y, strict=True))), b) for b, y in whole if a != b)
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_regions_of_cuts_are_even_and_ties_stay_together():
    points = np.random.default_rng(1).normal(0, 1000, (4096, 5)).astype(np.int64)
    counts = np.bincount(kd_search.Cuts(points, 64).regions(points), minlength=64)
    assert counts.sum() == 4096 and counts.min() >= 56 and counts.max() <= 72
    same = np.tile(points[:1], (500, 1))
    assert len(set(kd_search.Cuts(same, 16).regions(same).tolist())) == 1
    assert kd_search.Cuts(points[:0], 16).regions(points).tolist() == [0] * 4096


def test_a_query_visits_only_shards_in_reach(spark, monkeypatch):
    visited = []
    true_visit = kd_search._visit
    monkeypatch.setattr(kd_search, "_visit", lambda visits, *rest: (visited.append(visits.count()), true_visit(visits, *rest))[1])
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 20, (16, 3))
    data = [(i, (centres[i % 16] + rng.normal(0, 0.1, 3)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = kd_search.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, shard_rows=50)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    assert sorted(map(tuple, got.collect())) == plain_top(whole)
    assert sum(visited) < 32 * 32 / 4
