"""Sections, masking, lexicon and windows on hand-written notes."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators import attribution, corpus, models

NOTES = {
    1: "Preamble\nSocial History: \n lives alone \n\nHistory of Present Illness:\nfirst\nmore\nDischarge Medications:\nx\n",
    2: "Social History:\n\nSocial History:\nsecond body\nSocial History:\nthird body",
    3: "He said Social History: was\nNo header here",
    4: "Past Medical History:\nPTSD, F43.1\nBrief Hospital Course:\nstable",
    5: "",
    6: None,
    7: "Brief Hospital Course:\n   edges 　\nNot A Header: text\nEND",
}


def _by_rule(text, order=tx.SECTION_ORDER):
    """The section rule spelled out in plain Python."""
    found, name, lines = {}, None, []

    def close():
        body = "\n".join(lines).strip()
        if name in order and body and name not in found:
            found[name] = body

    for line in (text or "").split("\n"):
        m = re.fullmatch(r"([A-Z][A-Za-z /&\-]+):[ ]*", line)
        if m:
            close()
            name, lines = m.group(1).strip().lower(), []
        else:
            lines.append(line)
    close()
    return [(n, found[n]) for n in order if n in found]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(list(NOTES.items()), "hadm_id long, text string")


def test_sections_follow_the_rule(notes):
    for order in (tx.SECTION_ORDER, tx.SECTION_ORDER_NO_PMH):
        got = tx.with_sections(notes, "text", order).select("hadm_id", "sections").collect()
        for r in got:
            assert [(s.name, s.body) for s in (r.sections or [])] == _by_rule(NOTES[r.hadm_id], order)


def test_spans_point_into_the_joined_text(notes):
    rows = tx.with_sections(notes, "text").select(
        "sections", tx.joined_sections(F.col("sections")).alias("t"), tx.section_spans(F.col("sections")).alias("spans")
    )
    for r in rows.where("t IS NOT NULL").collect():
        for section, span in zip(r.sections, r.spans):
            assert r.t[span.span_start : span.span_end] == section.body


def test_removed_section_falls_back(notes):
    base = tx.with_sections(notes, "text").select("hadm_id", tx.joined_sections(F.col("sections")).alias("note_text")).where("note_text IS NOT NULL")
    only_pmh = notes.sparkSession.createDataFrame([(9, "Past Medical History:\nonly")], "hadm_id long, text string")
    joined = tx.with_sections(only_pmh, "text").select("hadm_id", tx.joined_sections(F.col("sections")).alias("note_text"))
    out = {r.hadm_id: r.note_text for r in corpus.without_section(notes.unionByName(only_pmh), base.unionByName(joined)).collect()}
    assert out[4] == "stable" and out[9] == "only"


def test_masking(spark):
    text = "Post  Traumatic, post-traumatic, posttraumatic PTSD f43.1 F43x1 309.81 Trauma-Related\nStress trauma"
    df = spark.createDataFrame([(text,)], "t string").select(tx.mask(F.col("t")).alias("m"))
    assert df.first().m == "[PTSD_MASKED], [PTSD_MASKED], [PTSD_MASKED] [PTSD_MASKED] [PTSD_MASKED] F43x1 [PTSD_MASKED] [PTSD_MASKED] trauma"


def test_lexicon_has_sixty_patterns_and_sound_shortcuts():
    assert len(tx.PHRASE_LEXICON) == 60
    assert len(tx.CLINICAL_TERMS) == 36
    for pattern, _, _ in tx.PHRASE_LEXICON:
        literal = tx._required_literal(pattern)
        assert literal  # counts are compared with a full scan below
    assert tx._required_literal(r"\bmva\b|\bmvc\b") == "mv"  # what all branches share
    assert tx._required_literal(r"\bcar\b|\bbus\b") is None
    assert tx._required_literal(r"\bfoo(bar(baz)?quxxx)?\b") == "foo" == tx._first_letters(r"\bfoo(bar(baz)?quxxx)?\b")
    assert tx._first_letters(r"\bab{0,1}c\b") == "a" and tx._first_letters(r"abc") is None


def test_lexicon_scores_equal_plain_counts(spark):
    texts = [
        "PTSD ptsd post traumatic stress; posttraumatic stress, re-experiencing, reexperience",
        "assaulted, assault; combat  veteran combat related. witnessed\nviolence; self blame self-blame",
        "étrauma trauma traumatic ſexual assault; sexual assault", "", "prazosin PCL-5 caps 5 trauma focused",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in tx.with_lexicon_scores(df, "t").collect():
        counts = [len(re.findall(p, texts[r.i], re.IGNORECASE)) for p, _, _ in tx.PHRASE_LEXICON]
        assert list(r.lexicon_hits) == counts
        assert r.score_raw == sum(c * w for c, (_, w, _) in zip(counts, tx.PHRASE_LEXICON))
        n = len(texts[r.i].split())
        assert r.score_norm == pytest.approx(r.score_raw / n if n else 0.0)
        assert sum(r.score_by_criterion.values()) == r.score_raw
        assert sum(r.lexicon_matches.values()) == sum(counts)


def test_windows_cover_every_token_once_per_stride(spark):
    for n in (0, 1, 14, 15, 16, 30, 31, 100):
        df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "hadm_id long, t string")
        got = [(r.window_no, r.window_text.split()) for r in attribution.windows(df, "t", 16, 8).orderBy("window_no").collect()]
        want, start, words = [], 0, [f"w{i}" for i in range(n)]
        while True:
            want.append((len(want), words[start : start + 14]))
            if start + 14 >= n:
                break
            start += 8
        assert got == want


def test_whole_words_merge_pieces(spark):
    rows = [(1, 0, 4, "hype", 0.1), (1, 4, 9, "rvigi", 0.2), (1, 10, 11, "a", 1.0), (1, 12, 17, "self-", 0.5), (1, 17, 21, "harm", 0.5), (1, 22, 24, "x2", 9.0)]
    df = spark.createDataFrame(rows, "hadm_id long, tok_start long, tok_end long, token string, value double")
    got = {r.word: round(r.value, 6) for r in attribution.whole_words(df).collect()}
    assert got == {"hypervigi": 0.3, "self-harm": 1.0}


def test_tokens_outside_spans_are_unknown(spark):
    spans = spark.createDataFrame([(1, [("a", 0, 5), ("b", 7, 9)])], "hadm_id long, spans array<struct<name string, span_start int, span_end int>>")
    tokens = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 7, 9), (2, 0, 1)], "hadm_id long, tok_start long, tok_end long")
    got = sorted((r.hadm_id, r.tok_start, r.section) for r in attribution.section_of(tokens, spans).collect())
    assert got == [(1, 0, "a"), (1, 4, "unknown"), (1, 7, "b"), (2, 0, "unknown")]


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, "beta gamma x"), (3, "")], "d long, t string")
    weights = models.tfidf(df, "d", "t").groupBy("d").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r.d for r in weights} == {1, 2}
    assert all(r.s == pytest.approx(1.0) for r in weights)


def test_lexicon_counts_equal_a_full_scan(spark):
    """Letters that equal a-z without case, and patterns whose letters are optional."""
    lexicon = [
        (r"\bviolence\b", 1.0, "A"), (r"\binsomnia\b", 2.0, "A"), (r"\bfoo(bar(baz)?quxxx)?\b", 1.0, "B"), (r"\bab{0,1}c\b", 1.0, "B"),
        (r"flashbacks?", 1.0, "B"), (r"\b(?:night|day)mare", 1.0, "C"), (r"one|two", 1.0, "C"), (r"\bsk[iy]p+ed\b", 1.0, "C"), (r"\d\s*kg", 1.0, "C"),
    ]
    texts = [
        "domestic VİOLENCE and İNSOMNIA", "vıolence, INSOMNIA insomnia", "foo foobarquxxx foobarbazquxxx fooq", "ac abc abbc AC", "FlaſhbacK and flashbacks",
        "nightmare Daymares mare", "ONE two stone", "sKipped SKYPPED ſkiped", "5 Kg, 6kg 7 KG", "", "ÉACÉ éviolence", "x" * 500,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: list(r.lexicon_hits) for r in tx.with_lexicon_scores(df, "text", lexicon).collect()}
    assert got == {i: [len(re.findall(p, t, re.IGNORECASE)) for p, _, _ in lexicon] for i, t in enumerate(texts)}


def test_a_term_is_looked_for_only_where_its_letters_stand(spark):
    texts = ["Stabbed; ſelf-harm, overſe", "İNTRUSIVE sıde", "Detoxé MVC mv ama", "", None, "aétrauma Trauma", "panİc HEROİN COKAINE"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    gated = tx.with_term_flags(rows, "text").select("id", "term_flags")
    plain = {t: tx.mentions(F.col("text"), [p]).cast("int") for t, p in tx.CLINICAL_TERMS.items()}
    wanted = {r.id: {t: r[t] for t in plain} for r in rows.select("id", *[c.alias(t) for t, c in plain.items()]).collect()}
    assert {r.id: r.term_flags for r in gated.collect()} == wanted
    assert sum(map(sum, (w.values() for w in wanted.values()))) > 4
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Contains\(_folded#\d+, trauma\) AND RLIKE", plan)


def test_words_merge_in_one_pass_whatever_the_batches(spark):
    """Repeated, missing and shared starts, missing values, words over batch ends; no window over a note."""
    import random

    rng = random.Random(5)
    rows = []
    for note in (1, 2, 3, None):
        at = 0
        for _ in range(60):
            token = rng.choice(["ab", "c-", "d'", "e", "9", "é", "x."])
            rows.append((note, at, at + len(token), token, rng.choice([0.5, 1.0, None])))
            at += len(token) + rng.choice([0, 0, 0, 1])
    rows += [(4, 0, 2, "ab", 1.0), (4, 2, 4, "cd", 1.0), (4, 2, 4, "cd", 2.0), (4, 4, 5, "e", 4.0), (5, 3, 4, "ab\n", 1.0), (5, 4, 6, "cd", 1.0)]
    want, held = [], None
    for r in sorted(rows, key=lambda r: (r[0] or 0, r[1])):  # nothing joins the second of two equal starts but its peer
        peer = held and held["note"] == r[0] and held["start"] == r[1]
        joins = held and held["note"] == r[0] and held["end"] == r[1] and re.search(r"[^\W\d_'\-]$|['\-]$", held["token"].rstrip("\n"))
        if not (peer or joins):
            held = {"note": r[0], "first": r[1], "text": "", "values": []}
            want.append(held)
        held.update(start=r[1], end=r[2], token=r[3], text=held["text"] + r[3], values=[*held["values"], r[4]])
    want = [w for w in want if w["note"] != 4 and re.fullmatch(r"(?:[^\W\d_]|['\-]){2,}", w["text"])]
    total = lambda v: -1.0 if all(x is None for x in v) else sum(x for x in v if x is not None)
    want = [(w["note"] or 0, w["first"], w["text"], total(w["values"])) for w in want]
    # The second of two pieces with one start begins a word, and its peer goes with it.
    want += [(4, 0, "ab", 1.0), (4, 2, "cdcde", 7.0)]
    df = spark.createDataFrame(rows, "hadm_id long, tok_start long, tok_end long, token string, value double").repartition(5)
    words = attribution.whole_words(df)
    assert "Window" not in words._jdf.queryExecution().executedPlan().toString()
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("3", usual):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [(r.hadm_id or 0, r.word_start, r.word, -1.0 if r.value is None else r.value) for r in words.collect()]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
        assert sorted(got) == sorted(want)


def test_pieces_are_cut_without_a_window(spark, tmp_path):
    from cohortlens.functions import text as tx
    from cohortlens.plans import standins

    texts = [(7, "Plan:\nwordlonger than\tfive\x0b é𝔘𝔘𝔘𝔘𝔘x\n", "en"), (14, "one\ntwo", "en"), (14, "three four\n", "en"), (21, None, "en"), (28, "", "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in texts], standins.SCHEMAS["documents"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tokens = standins.token_pieces(spark, str(tmp_path))
    assert "Window" not in tokens._jdf.queryExecution().executedPlan().toString()
    parsed = tx.with_sections(standins.discharge(spark, str(tmp_path)), "text").select("hadm_id", tx.joined_sections(F.col("sections")).alias("t"))
    notes = {}
    for r in parsed.where("t IS NOT NULL").collect():
        notes.setdefault(r.hadm_id, []).append(re.findall(r"[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", r.t))
    want = []
    for key, lists in notes.items():
        base = 0
        for turn in range(max(map(len, lists))):
            for run in (part[turn] for part in lists if turn < len(part)):
                if run.strip(" \n\t\r"):
                    want += [(key, base + o, base + o + len(run[o : o + 5]), run[o : o + 5]) for o in range(0, len(run), 5)]
                base += len(run)
    got = [(r.hadm_id, r.tok_start, r.tok_end, r.token) for r in tokens.collect()]
    assert len(got) > 20 and sorted((k, e - s) for k, s, e, _ in got) == sorted((k, e - s) for k, s, e, _ in want)
    assert sorted(x for x in got if x[0] != 14) == sorted(x for x in want if x[0] != 14)


def test_words_of_notes_in_one_row_are_those_of_their_pieces(spark):
    """Arrays in any order, missing notes, starts and values; small batches."""
    import random

    rng = random.Random(6)
    rows = []
    for note in (1, 2, 3, 4, 5, None):
        at = 0
        for _ in range(50):
            token = rng.choice(["ab", "c-", "D'", "e", "9", "é", "x.", "ab\n"])
            rows.append((note, at, at + len(token), token, rng.choice([0.5, 1.0, None])))
            at += len(token) + rng.choice([0, 0, 0, 1])
        rows += rng.sample(rows, 3) + [(note, None, 4, "abc", 1.0)]
    df = spark.createDataFrame(rows, "hadm_id long, tok_start int, tok_end long, token string, value double")
    packed = df.orderBy(F.rand(3)).groupBy("hadm_id").agg(*[F.collect_list(F.struct(c)).getField(c).alias(c) for c in df.columns[1:]])
    blank = packed.limit(1).select(F.lit(9).cast("long").alias("hadm_id"), *[F.slice(c, 1, 0).alias(c) for c in df.columns[1:]])
    words = attribution.whole_words(packed.union(blank).coalesce(1))
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan

    def found(words):
        return sorted((r.hadm_id or 0, r.word_start if r.word_start is not None else -1, r.word, -1.0 if r.value is None else r.value) for r in words.collect())

    want = found(attribution.whole_words(df))
    assert len(want) > 30
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", usual):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert found(words) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_values_of_pieces_follow_their_note_and_start(spark, tmp_path):
    from cohortlens.plans import standins

    texts = [(7, "Plan:\nwordlonger than\tfive\x0b é𝔘𝔘𝔘𝔘𝔘x\n"), (14, "one two\nPlan:\nthe é𝔘𝔘𝔘𝔘𝔘𝔘 word\n\tend"), (None, "Plan:\nno key here"), (21, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], standins.SCHEMAS["documents"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tokens = standins.token_pieces(spark, str(tmp_path))
    rows = tokens.withColumn("want", standins.md5_uniform("9", F.col("hadm_id"), F.col("tok_start"))).collect()
    assert len(rows) > 10 and all(r.value == r.want and r.tok_end == r.tok_start + len(r.token) for r in rows)
    assert any("𝔘" in r.token for r in rows)


def test_terms_by_attribution_move_no_piece(spark, tmp_path):
    """Pieces stay in their note's row: none is a row that is sorted or shuffled on the way to its word."""
    from cohortlens.plans import standins
    from cohortlens.plans.catalogue import QUERIES

    text = "History of Present Illness:\nalpha betagamma\nalpha\nalpha delta\n"
    docs = spark.createDataFrame([(7 * i, text, "en", "s", len(text)) for i in range(1, 5)], standins.SCHEMAS["documents"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("top_terms_by_attribution", "attribution_by_term", "whole_word_values"):
        found = QUERIES[name].run(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Sort [hadm_id" not in plan and plan.count("hashpartitioning(hadm_id") == 1
        assert {"alpha", "betagamma"} <= {r.word for r in found.collect()}
