"""Near duplicates, line dedup, quality statistics, personal data and URL lists against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import anchors, hyperminhash, line_runs, outliers, shingles, url_lists
from helpers import DOCS, documents, line_dedup, near_groups, prose, statistics, words


@pytest.fixture(scope="module")
def rows():
    return documents(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(7)
    base = prose(rng, 120, 5000).split(" ")
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # a family whose copies are linked with some and not with others
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"s{j}" for j in range(4 + i % 3)) + " tail" * (i % 2)) for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a B"), (205, "x " * 4000)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == near_groups(rows)


def test_near_duplicates_tiles(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "TILE_CLASSES", 8)
    monkeypatch.setattr(hyperminhash, "TILE_SHINGLES", 700)
    rng = random.Random(8)
    base = prose(rng, 60, 5000).split(" ")
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == near_groups(rows)


def bucket_keys(sets, rule=hyperminhash.Rule()):
    """(band, code) of each set, as the operator makes them."""
    n = np.array([len(s) for s in sets])
    codes = hyperminhash.filled(hyperminhash.registers(sets)).view(np.int64)
    keys = [{(b, c) for b, c in enumerate(row)} if k > hyperminhash.SHORT else set() for row, k in zip(codes.tolist(), n, strict=True)]
    for s, own in zip(sets, keys, strict=True):
        if len(s) <= rule.most_keyed:
            own |= {(hyperminhash.BANDS, int(h)) for h in s[: rule.prefix(len(s))]}
    return keys


@pytest.mark.parametrize("size", [3, 10, 32, 33, 60, 100, 300])
def test_chance_buckets_do_not_grow_with_the_corpus(size):
    rng = np.random.default_rng(size)
    for n in (2000, 8000):
        sets = [np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64)) for _ in range(n)]
        counts = Counter(k for keys in bucket_keys(sets) for k in keys)
        assert sum(c * (c - 1) // 2 for c in counts.values()) <= n // 1000


@pytest.mark.parametrize("size", [3, 4, 7, 15, 29, 32, 33, 36, 42, 43, 60, 150, 600])
def test_pairs_at_the_threshold_share_a_bucket_and_pass_the_estimate(size):
    rng, rule, missed, turns = np.random.default_rng(size), hyperminhash.Rule(), 0, 400
    for _ in range(turns):
        # |A & B| = i, |A | B| = size with 100 i >= 75 size, the rest dealt to either side.
        union = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        shared = -(-75 * len(union) // 100)
        picks = rng.permutation(len(union))
        cut = shared + rng.integers(0, len(union) - shared + 1)
        one, two = np.sort(union[picks[:cut]]), np.sort(union[np.concatenate([picks[:shared], picks[cut:]])])
        a, b = bucket_keys([one, two])
        sketch = hyperminhash.registers([one, two])
        near = hyperminhash.estimate(sketch[0], len(one), sketch[1:], np.array([len(two)]))[0] >= rule.least_estimate(min(len(one), len(two)))
        missed += not (a & b and near)
    assert missed == 0


def test_near_duplicates_ids(spark):
    text, other = prose(random.Random(1), 40), prose(random.Random(2), 40)
    rows = [(5, text, 1), (None, text, 2), (5, other, 3), (9, other, 4), (None, "alone by itself", 5), (7, None, 6)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cid long"))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got.collect() if r.component_id is not None)
    assert found == [(False, 5, 5, True), (False, 5, 5, True), (False, 7, 7, True), (False, 9, 5, False), (True, 0, 5, False)]
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_takes_off_chance_collisions():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 5000, np.uint64)) for _ in range(60)]
    sketch = hyperminhash.registers(sets)
    n = np.array([len(s) for s in sets])
    same = np.mean([(sketch[0] == sketch[i]).sum() for i in range(1, 60)])
    assert abs(same - hyperminhash.expected_collisions(n[0], n[1])) < 0.2
    half = np.unique(np.concatenate([sets[0][:4000], sets[1][:1000]]))
    got = hyperminhash.estimate(sketch[0], n[0], hyperminhash.registers([half]), np.array([len(half)]))
    assert abs(got[0] - 4000 / 6000) < 0.15


def test_hashes_do_not_depend_on_the_batch(rows):
    texts = [r[1] for r in rows]
    data, starts = shingles.utf8(pa.array(texts))
    together = shingles.shingle_sets(data, starts)
    for text, found in zip(texts, together, strict=True):
        alone = shingles.shingle_sets(*shingles.utf8(pa.array([text])))[0]
        assert (alone == found).all() and len(alone) == len(found)
    hashes, first = shingles.word_hashes(data, starts)
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]


def test_line_dedup_equals_plain_python(docs, rows):
    got = line_runs.deduplicate_lines(docs.select("doc_id", "text", "n_chars"), batches=5, fanout=2)
    got = [(r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    assert sorted(got, key=str) == line_dedup([(r[0], r[1]) for r in rows])


def test_line_that_most_documents_have(spark, monkeypatch):
    """One hot line is split over tasks and still counted whole."""
    for key, value in (("skewJoin.skewedPartitionThresholdInBytes", "16k"), ("advisoryPartitionSizeInBytes", "16k"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.adaptive.{key}", value)
    plans = []
    true_materialise = line_runs.materialise

    def stored(df, name):
        out = true_materialise(df, name)
        if name == "dropped":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(line_runs, "materialise", stored)
    for key, value in (("autoBroadcastJoinThreshold", "-1"), ("files.maxPartitionBytes", "32k"), ("files.openCostInBytes", "1k")):
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        rows = [(i, "the very common line" + f"\nown line number {i}" * (i % 16 == 0)) for i in range(12000)]
        got = line_runs.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(24), batches=1).select("row.doc_id", "n_dropped").collect()
    finally:
        for key in ("skewJoin.skewedPartitionThresholdInBytes", "advisoryPartitionSizeInBytes", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.adaptive.{key}")
        for key in ("autoBroadcastJoinThreshold", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{key}")
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(i, int(i > 0)) for i in range(12000)]
    assert any("skew=true" in p for p in plans)


def test_line_dedup_empty(spark):
    assert line_runs.deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_statistics_equal_plain_python(docs, rows):
    texts = [r[1] for r in rows] + ["a b c a b c x", "a a a a", "p q r s p q r", "#a $b\n#a $b\n \n \n#a $b"]
    df = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in outliers.with_statistics(df).collect():
        assert tuple(r)[2:] == statistics(texts[r.doc_id]), texts[r.doc_id]


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(80, 900), 9000), rng.choice(["en", None]), rng.choice(["a", None]), i) for i in range(400)]
    junk = [(1000 + i, " ".join(rng.choice(["#$%|", "a", "<>"]) + str(rng.randrange(99999)) for _ in range(200)), "en", "a", 0) for i in range(4)]
    base = [(2000, None, "en", "a", 0), (2001, "few words", "en", "a", 0), (2002, "same words here " * 90, "en", "a", 0)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows + junk + base, DOCS)).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[i].kept or got[i].base_failed for i in (1000, 1001, 1002, 1003))
    assert all(got[i].base_failed and not got[i].kept for i in (2000, 2001, 2002))
    assert outliers.judge(spark.createDataFrame([], DOCS)).count() == 0
    assert outliers.judge(spark.createDataFrame(rows[:1], DOCS)).first().kept


def test_outlier_distances_equal_numpy(spark, monkeypatch):
    """Concentration steps, core by histogram cells, and distances, against NumPy on exact integers."""
    stored = {}
    true_materialise = outliers.materialise
    monkeypatch.setattr(outliers, "materialise", lambda df, name: stored.setdefault(name, true_materialise(df, name)))
    rng, rules = random.Random(11), outliers.Rules()
    rows = [(i, prose(rng, rng.randrange(60, 500), 3000) + " #$%" * rng.choice([0, 0, 0, 5, 40]), "en", rng.choice(["a", "b"]), i) for i in range(240)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, DOCS)).collect()}
    p = len(rules.spreads)
    xs = [f"x{i}" for i in range(p)]
    facts = stored["statistics"].where("not base_failed").select("grp", "doc_id", *xs, F.xxhash64("doc_id", *xs).alias("spot")).collect()
    shrink = rules.core / outliers._cdf(outliers._quantile(rules.core, p), p + 2)
    limit = outliers._quantile(1 - rules.tail, p)
    for group in {r.grp for r in facts}:
        own = [r for r in facts if r.grp == group]
        points, spots = np.array([[r[x] for x in xs] for r in own], float), np.array([r.spot for r in own]).view(np.uint64)
        ends = []
        for start in range(3):
            core = np.ones(len(own), bool) if start == 0 else (spots >> np.uint64(start)) & np.uint64(1) == 0
            for step in range(rules.steps + 1):
                centre, part = points[core].mean(0), points[core]
                scatter = shrink * (part.T @ part / len(part) - np.outer(centre, centre)) + np.diag([(x * outliers.UNIT) ** 2 for x in rules.spreads])
                away = points - centre
                d2 = np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter), away)
                cell = np.floor(np.log(np.maximum(d2, 1e-9)) * 64)
                core = cell <= np.sort(cell)[int(np.ceil(rules.core * len(own))) - 1]
            ends.append((np.linalg.slogdet(scatter)[1], start, d2))
        d2 = min(ends, key=lambda x: x[:2])[2]
        for r, want in zip(own, d2, strict=True):
            assert got[r.doc_id].distance == pytest.approx(want, rel=1e-6)
            assert got[r.doc_id].kept == (want <= limit)


def test_outlier_steps_move_no_rows_and_write_few_files(spark, monkeypatch):
    """Many groups and shuffle partitions: the estimates stay a few files, and no join of a fit sorts its rows by group."""
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    before = {k: spark.conf.get(k) for k in settings}
    written, plans = {}, {}
    true_materialise = outliers.materialise

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        written[name] = true_materialise(df, name)
        return written[name]

    monkeypatch.setattr(outliers, "materialise", stored)
    monkeypatch.setattr(outliers, "ready", lambda session: session)
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(60, 90), 3000), rng.choice(["en", "de", None]), f"s{i % 4}", i) for i in range(120)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert outliers.judge(spark.createDataFrame(rows, DOCS)).where("kept").count() > 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert written["fit-4"].count() == 3 * len({r[2:4] for r in rows})
    for name in written.keys() - {"statistics"}:
        assert len(written[name].inputFiles()) <= 4, name
    for step in range(1, 5):
        assert "SortMergeJoin" not in plans[f"fit-{step}"]


def test_outlier_sums_pass_64_bits(spark):
    big = 1 << 31
    rows = spark.range(4).select(F.lit("g").alias("grp"), F.lit(big).cast("long").alias("x0"), F.lit(-big).cast("long").alias("x1"))
    got = outliers._sums(rows, ["grp"], 2).first()
    assert (got.n, got.s0, got.s1, got.s00, got.s10, got.s11) == (4, 4 * big, -4 * big, 4.0 * big**2, -4.0 * big**2, 4.0 * big**2)


def test_anchor_spans_equal_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, text):
        digits = re.sub(r"\D", "", text)
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        return kind == "email" or (16 <= len(digits) <= 19 and anchors.luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)

    rng, automaton = random.Random(3), anchors.build_automaton()
    for turn in range(20000):
        alphabet = rng.choice(["a@.-b ", "0123.5 ", "4-9 0", "+1(2) .-", "+19.@a 2-", "é4@.1+ a"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        if turn % 5 == 0:
            text += " 4111 1111-1111 1111 " + text
        found = anchors.find_spans(text, automaton)
        for kind, pattern in patterns.items():
            assert found[kind] == [m.span() for m in re.finditer(pattern, text) if valid(kind, m.group())], text


def test_anchor_cues(spark):
    text = "IBAN: GB82 WEST 1234 5698 7654 32 and https://bob:pw@x.org/a"
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (None, "é a@b.co " + "9" * 9000, 0), (1, text, 0)]
    got = anchors.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans long")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and "account:6:33" in by[1].spans and "login:46:58" in by[1].spans
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest() == by[3].base_sha256
    assert by[None].n_email == 1 and by[None].spans.startswith("email:2:8")


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("HTTPS://user:pw@host.org", "login", "user:pw@host.org"), ("see postgres://u:p@h/db", "login", "u:p@h"), ("://a:b@c", "login", None),
        ("IBAN is GB82WEST12345698765432", "account", "GB82WEST12345698765432"), ("iban-no. GB82 WEST 1234 5698 7654 32!", "account", "GB82 WEST 1234 5698 7654 32"),
        ("pay DE89 3704 0044 0532 0130 00.", "account", "DE89 3704 0044 0532 0130 00"), ("DE89370400440532013001", "account", None), ("XDE89370400440532013000", "account", None),
        ("Account no. 123456789", "account", "123456789"), ("account 123456789", "account", None), ("account no. 12345", "account", None),
        ("at 12 Main Street, Apt 4B.", "address", "12 Main Street, Apt 4B"), ("221B Baker St", "address", "221B Baker St"), ("350 5th Avenue", "address", "350 5th Avenue"),
        ("12 of the Main Street", "address", None), ("no way", "address", None), ("in der Hauptstraße 12a, Ulm", "address", "Hauptstraße 12a"), ("Hauptstraße", "address", None),
    ],
)
def test_added_kinds(text, kind, part):
    for text, shift in ((text, 0), (f"é ß {text} x", 4)):
        spans = anchors.find_spans(text, anchors.build_automaton())[kind]
        assert [text[a:b] for a, b in spans] == ([part] if part else [])
        assert all(a >= shift for a, _ in spans)


def test_added_spans_never_overlap():
    rng, automaton = random.Random(8), anchors.build_automaton()
    parts = [*"aA1 0.#:-@+/éß", "Street ", " st", "iban ", "GB82", "account no ", "://", "weg ", "straße ", " Apt ", "DE89"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        for spans in anchors.find_spans(text, automaton).values():
            assert all(0 <= a < b <= len(text) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_url_lists_take_deep_paths_and_any_spelling(spark):
    entries = [("BAD.org", "Block", 10, "Add"), ("bad.org", "block", 20, "Remove"), ("http://deep.org./a//b/?q", "block", 1, "add"), ("deep.org/a/b/c/d", "allow", 1, "add"), ("/", "block", 1, "add")]
    cases = [("http://bad.org/", 15, "block"), ("http://bad.org/", 25, "none"), ("http://deep.org/a/b/c", 5, "block"), ("http://deep.org//a/b?x", 5, "block"),
             ("http://deep.org/a/bc", 5, "none"), ("http://deep.org/a/b/c/d/e", 5, "allow"), ("http://x.org" + "/y" * 50000, 5, "none")]
    pages = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id long, url string, day long")
    listed = spark.createDataFrame(entries, "key string, list string, day long, action string")
    got = {r.page_id: r.verdict for r in url_lists.filter_urls(pages, listed).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, _, v in cases]


def test_url_lists(spark):
    entries = [("bad.org", "block", 10, "add"), ("bad.org", "block", 100, "remove"), ("bad.org", "block", 300, "add"), ("ok.bad.org", "allow", 0, "add"),
               ("bad.org/x", "block", 50, "add"), ("tie.org", "block", 5, "add"), ("tie.org", "allow", 5, "add"), ("gone.org", "block", 7, "add"),
               ("gone.org", "block", 7, "remove"), (None, "block", 1, "add"), ("bad.org", None, 1, "add")]
    cases = [("http://bad.org/", 9, "none"), ("http://bad.org/", 10, "block"), ("https://U@WWW.bad.org:80/x?y", 99, "block"), ("http://bad.org/", 100, "none"),
             ("http://bad.org/x/y", 120, "block"), ("http://bad.org", 5000, "block"), ("http://ok.bad.org/x", 50, "allow"), ("http://tie.org", 6, "allow"),
             ("http://gone.org", 8, "none"), (None, 50, "none"), ("", 50, "none"), ("/relative", 50, "none"), ("http://bad.org", None, "none")]
    pages = spark.createDataFrame([(i, u, d, "k") for i, (u, d, _) in enumerate(cases)] * 2, "page_id long, url string, day long, key string")
    listed = spark.createDataFrame(entries, "key string, list string, day long, action string")
    got = url_lists.filter_urls(pages, listed).collect()
    assert len(got) == 2 * len(cases)
    assert all(r.verdict == cases[r.page_id][2] and r.kept == (r.verdict != "block") for r in got)
    assert {r.verdict for r in url_lists.filter_urls(pages, listed.limit(0)).collect()} == {"none"}
    assert url_lists.filter_urls(pages.limit(0), listed).count() == 0
