"""The pipeline's stages, each against plain Python on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm.outliers import judge
from helpers import DOCS, documents, line_dedup, near_groups, prose, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, run as the driver does: written and read again."""
    rng = random.Random(12)
    rows = documents(rng, 50)
    shared = "a passage that many documents share and that is long"
    rows += [(200 + i, f"{prose(rng, 90, 5000)}\n{shared}\n{prose(rng, 20, 5000)}", "en", "a", 0) for i in range(30)]
    rows = [r if r[0] is not None else (299, *r[1:]) for r in rows]
    rows = list({r[0]: r for r in rows}.values())
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((before, docs, before.collect(), docs.collect()))
    return str(folder), out


def test_all_but_the_last_keep_the_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for before, after, _, _ in stages[1][:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    before, _, rows, kept = stages[1][0]
    wanted = {r.doc_id for r in judge(before).collect() if r.kept}
    assert wanted and sorted(map(str, kept)) == sorted(str(r) for r in rows if r.doc_id in wanted)


def test_lines(stages):
    _, _, rows, got = stages[1][1]
    want = {d: text for d, _, _, text in line_dedup([(r.doc_id, r.text) for r in rows])}
    assert {r.doc_id: r.text for r in got} == want
    assert sum(len(t) for t in want.values()) < sum(len(r.text) for r in rows)


def test_near_duplicates(stages):
    _, _, rows, got = stages[1][2]
    want = sorted(d for d, _, _, kept in near_groups([(r.doc_id, r.text) for r in rows]) if kept)
    assert sorted(r.doc_id for r in got) == want and len(want) < len(rows)


def test_mixing(stages):
    _, _, rows, got = stages[1][3]
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= {r.doc_id for r in rows} and max(copies.values()) <= 2
    size = {r.doc_id: len(words(r.text)) for r in rows}
    assert 1.2 * sum(size.values()) <= sum(size[d] * n for d, n in copies.items()) <= 1.6 * sum(size.values())


def test_packing(stages):
    _, _, rows, got = stages[1][4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    expect = Counter()
    for (d, n), k in want.items():
        expect[d] += n * k
    assert total == expect
    lengths = defaultdict(int)
    for r in got:
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= 2048 and np.mean(list(lengths.values())) > 256


def test_run_and_registration(spark, stages):
    got = corpus_pipeline.run(spark, stages[0])
    assert got.count() > 0
    assert got.columns == stages[1][4][1].columns
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_quality_judges_rows_not_ids(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80, 5000), "en", "a", 1) for i in range(40)]
    rows += [(None, "too short", "en", "a", 1), (None, None, None, None, None), (3, "short too", "en", "a", 1), rows[5]]
    rows += [(None, prose(rng, 80, 5000), "en", "a", 1)]
    got = corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in rows if len(words(r[1])) > 50)


def test_near_duplicates_of_rows_without_or_with_one_id(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (prose(rng, 100, 5000) for _ in range(6))
    rows = [(None, a), (7, a), (None, a), (None, b), (None, b), (None, b + " more"), (None, c + " more"), (9, c), (4, d), (4, d), (4, e)]
    rows += [(None, f), (11, ""), (11, ""), (12, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len([x for x in got if x[0] is None and (x[1] or "").startswith(b)]) == 1
    want = [(7, a), (9, c), (4, d), (4, e), (None, f), (11, ""), (12, ""), (None, ""), (None, None)]
    assert sorted(map(str, (x for x in got if not (x[1] or "").startswith(b)))) == sorted(map(str, want))


CLASHES = DOCS + ", _id long, _row string, _a long, _b long, _doc string, size long, copies long, row string, id string, kept boolean, tags map<string,int>"


def clashing(rows):
    return [(*r, 7, "r", 8, 9, "d", 10, 11, "w", "i", False, {"t": 1}) for r in rows]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, k):
    rng = random.Random(k)
    rows = [(i, prose(rng, 80, 5000), "en", "a", 1) for i in range(30)] + [(None,) * 5] * 3
    stage = corpus_pipeline.STAGES[k][1]
    docs = spark.createDataFrame(clashing(rows), CLASHES)
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    found = got.collect()
    assert {r.doc_id for r in found} >= set(range(30)) if k < 3 else len(found) >= 30
    assert all(tuple(r)[5:] == (7, "r", 8, 9, "d", 10, 11, "w", "i", False, {"t": 1}) for r in found)
    assert stage(spark, docs.limit(0), "").count() == 0
    assert stage(spark, docs.where("doc_id is null"), "").count() == (0 if k in (0, 3) else 3)


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert corpus_pipeline.packing_stage(spark, docs, "").count() == 0


def test_mixing_takes_repeated_rows_each(spark):
    rng = random.Random(9)
    text = prose(rng, 50, 5000)
    rows = [(1, text, "en", "a", 1)] * 40 + [(i, prose(rng, 50, 5000), "en", "b", 1) for i in range(2, 90)]
    got = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, DOCS).repartition(5), "").collect())
    assert 40 <= got[1] <= 80 and all(got[i] <= 2 for i in range(2, 90)) and sum(got.values()) == pytest.approx(1.5 * 128, abs=2)


def test_row_keys_tell_nulls_and_places_apart(spark):
    from cohortlens.llm.common import row_key

    rows = [(None, "a", {"x": 1}), ("a", None, {"x": 1}), ("a", "a", {"x": 2}), ("a", "a", {"x": 1}), ("", "a", {"x": 1}), ("a", "a", None)]
    df = spark.createDataFrame(rows * 2, "p string, q string, m map<string,int>")
    assert df.select(*row_key(df)).distinct().count() == len(rows)
