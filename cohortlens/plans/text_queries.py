"""Queries on note sections, masking, lexicon scores, windows and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators import attribution, characteristics, corpus, models
from cohortlens.plans import sql as sq
from cohortlens.plans import standins
from cohortlens.plans.registry import query
from cohortlens.plans.study import Study


def _documents(s: Study):
    return standins.documents(s.spark, s.sf_dir).select("doc_id", "text")


def _all_notes(s: Study, order=tx.SECTION_ORDER):
    """Joined sections of every note, cohort or not."""
    parsed = tx.with_sections(s.discharge, "text", order)
    return parsed.select("hadm_id", "sections", tx.joined_sections(F.col("sections")).alias("note_text"))


@query("note_sections", "hadm_id:l name:s body:s", "TXT1", "SELECT hadm_id, name, body FROM all_sections")
def note_sections(s: Study):
    return tx.with_sections(s.discharge, "text").select("hadm_id", F.explode("sections").alias("x")).select("hadm_id", "x.*")


@query("note_section_map", "hadm_id:l hpi:s n_sections:l", "TXT1",
       "SELECT hadm_id, max(body) FILTER (WHERE name = 'history of present illness') AS hpi, count(*) AS n_sections FROM all_sections GROUP BY 1")
def note_section_map(s: Study):
    parsed = tx.with_sections(s.discharge, "text").where(F.size("sections") > 0)
    by_name = parsed.withColumn("m", tx.section_map(F.col("sections")))
    return by_name.select(
        "hadm_id", F.try_element_at("m", F.lit("history of present illness")).alias("hpi"), F.size("m").alias("n_sections")
    )


@query("joined_sections", "hadm_id:l note_text:s n_chars:l n_tokens:d", "TXT2 PRJ19",
       "SELECT hadm_id, note_text, length(note_text) AS n_chars, length(note_text) / 4.0 AS n_tokens FROM all_joined")
def joined_sections(s: Study):
    notes = _all_notes(s).where("note_text IS NOT NULL")
    text = F.col("note_text")
    return notes.select("hadm_id", "note_text", F.length(text).alias("n_chars"), tx.token_estimate(text).alias("n_tokens"))


@query("section_spans", "hadm_id:l name:s span_start:l span_end:l", "TXT4",
       "SELECT hadm_id, name, span_start, span_end FROM spans")
def section_spans(s: Study):
    notes = tx.with_sections(s.discharge, "text")
    return notes.select("hadm_id", F.explode(tx.section_spans(F.col("sections"))).alias("x")).select("hadm_id", "x.*")


@query("section_removed", "hadm_id:l note_text:s", "TXT3 JN14",
       "SELECT j.hadm_id, coalesce(n.note_text, j.note_text) AS note_text FROM all_joined j LEFT JOIN nopmh_joined n ON j.hadm_id = n.hadm_id")
def section_removed(s: Study):
    base = _all_notes(s).where("note_text IS NOT NULL").select("hadm_id", "note_text")
    return corpus.without_section(s.discharge, base)


@query("section_removal_changes", "n_notes:l n_changed:l", "TXT6 TXT3",
       """SELECT count(*) AS n_notes, count(*) FILTER (WHERE coalesce(n.note_text, j.note_text) <> j.note_text) AS n_changed
          FROM all_joined j LEFT JOIN nopmh_joined n ON j.hadm_id = n.hadm_id""")
def section_removal_changes(s: Study):
    base = _all_notes(s).where("note_text IS NOT NULL").select("hadm_id", "note_text")
    return corpus.changed_count(base, corpus.without_section(s.discharge, base))


@query("masked_notes", "hadm_id:l masked:s changed:l", "TXT5 TXT6",
       f"""SELECT hadm_id, regexp_replace(text, {sq.q(sq.MASK_REGEX)}, {sq.q(tx.MASK_TOKEN)}, 'g') AS masked,
                  CASE WHEN regexp_matches(text, {sq.q(sq.MASK_REGEX)}) THEN 1 ELSE 0 END AS changed FROM discharge""")
def masked_notes(s: Study):
    text = F.col("text")
    return s.discharge.select(
        "hadm_id", tx.mask(text).alias("masked"), tx.mentions(text, tx.MASK_PATTERNS).cast("int").alias("changed")
    )


@query("notes_primary_or_fallback", "subject_id:l hadm_id:l group:s is_prediagnosis:l note_text:s", "TXT12 TXT1 TXT2 JN1 SRC3",
       "SELECT * FROM notes_raw")
def notes_primary_or_fallback(s: Study):
    return s.notes


@query("training_corpus", "subject_id:l hadm_id:l group:s label:l note_text:s is_masked:l", "TXT5 SET4 PRJ7", "SELECT * FROM corpus")
def training_corpus(s: Study):
    return s.corpus


@query("leakage_audit", "n_prediagnosis:l n_prediagnosis_hit:l n_positive:l n_masked:l leakage_rate:d masked_rate:d", "AGG9",
       f"""SELECT *, coalesce(n_prediagnosis_hit / nullif(n_prediagnosis, 0)::DOUBLE, 0) AS leakage_rate,
                  coalesce(n_masked / nullif(n_positive, 0)::DOUBLE, 0) AS masked_rate FROM (
              SELECT count(*) FILTER (WHERE is_prediagnosis) AS n_prediagnosis,
                     count(*) FILTER (WHERE is_prediagnosis AND regexp_matches(note_text, {sq.q(sq.MASK_REGEX)})) AS n_prediagnosis_hit,
                     count(*) FILTER (WHERE "group" = 'ptsd_pos') AS n_positive,
                     count(*) FILTER (WHERE "group" = 'ptsd_pos' AND regexp_matches(note_text, {sq.q(sq.MASK_REGEX)})) AS n_masked
              FROM notes_raw)""")
def leakage_audit(s: Study):
    return corpus.leakage_audit(s.notes)


@query("note_lengths_by_group", "group:s n:l mean:d min:d max:d mean_tokens:d Q1:d median:d Q3:d", "AGG8 PRJ19",
       f"""SELECT "group", count(*) AS n, avg(length(note_text)) AS mean, min(length(note_text)) AS min, max(length(note_text)) AS max,
                  avg(length(note_text)) / 4 AS mean_tokens, {sq.percentile('length(note_text)', 0.25)} AS "Q1",
                  {sq.percentile('length(note_text)', 0.5)} AS median, {sq.percentile('length(note_text)', 0.75)} AS "Q3"
           FROM notes_raw GROUP BY 1""")
def note_lengths_by_group(s: Study):
    return characteristics.length_distribution(s.notes, "group", "note_text")


@query("document_lengths_by_language", "lang:s n:l mean:d min:d max:d mean_tokens:d Q1:d median:d Q3:d", "AGG8",
       f"""SELECT lang, count(*) AS n, avg(length(text)) AS mean, min(length(text)) AS min, max(length(text)) AS max,
                  avg(length(text)) / 4 AS mean_tokens, {sq.percentile('length(text)', 0.25)} AS "Q1",
                  {sq.percentile('length(text)', 0.5)} AS median, {sq.percentile('length(text)', 0.75)} AS "Q3"
           FROM documents GROUP BY 1""")
def document_lengths_by_language(s: Study):
    docs = standins.table(s.spark, s.sf_dir, "documents")
    return characteristics.length_distribution(docs, "lang", "text")


_LEX = tx.PHRASE_LEXICON
_FOLDED_NOTES = f"(SELECT hadm_id, text, {sq.folded('text')} AS folded FROM discharge)"


def _criteria_sql(column: str, lexicon, criteria) -> str:
    parts = []
    for c in criteria:
        parts.append(f"{sq.lexicon_score(column, [x for x in lexicon if x[2] == c])} AS \"score_{c}\"")
    return ", ".join(parts)


@query("lexicon_scores", "hadm_id:l score_raw:d score_norm:d " + " ".join(f"score_{c}:d" for c in tx.CRITERIA), "TXT7 TXT8 TXT9",
       f"""SELECT hadm_id, score_raw, CASE WHEN n_words > 0 THEN score_raw / n_words ELSE 0 END AS score_norm,
                  {', '.join(f'"score_{c}"' for c in tx.CRITERIA)} FROM (
              SELECT hadm_id, {sq.lexicon_score('folded', _LEX)} AS score_raw, {sq.hits('text', chr(92) + 'S+')} AS n_words,
                     {_criteria_sql('folded', _LEX, tx.CRITERIA)} FROM {_FOLDED_NOTES})""")
def lexicon_scores(s: Study):
    scored = tx.with_lexicon_scores(s.discharge, "text")
    by = F.col("score_by_criterion")
    return scored.select("hadm_id", "score_raw", "score_norm", *[by[c].alias(f"score_{c}") for c in tx.CRITERIA])


@query("lexicon_matches", "pattern:s n_notes:l n_hits:l", "TXT10",
       "SELECT pattern, count(*) AS n_notes, sum(h) AS n_hits FROM (" + " UNION ALL ".join(
           f"SELECT {sq.q(p)} AS pattern, {sq.hits('folded', p)} AS h FROM {_FOLDED_NOTES}" for p, _, _ in _LEX
       ) + ") WHERE h > 0 GROUP BY pattern")
def lexicon_matches(s: Study):
    scored = tx.with_lexicon_scores(s.discharge, "text")
    return scored.select(F.explode("lexicon_matches").alias("pattern", "h")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_notes"), F.sum("h").alias("n_hits")
    )


@query("stopword_scores", "doc_id:l score_raw:d score_norm:d", "TXT7 TXT8",
       f"""SELECT doc_id, score_raw, CASE WHEN n_words > 0 THEN score_raw / n_words ELSE 0 END AS score_norm FROM (
               SELECT doc_id, {sq.lexicon_score('folded', standins.STOPWORD_LEXICON)} AS score_raw, {sq.hits('text', chr(92) + 'S+')} AS n_words
               FROM (SELECT doc_id, text, {sq.folded('text')} AS folded FROM documents))""")
def stopword_scores(s: Study):
    scored = tx.with_lexicon_scores(_documents(s), "text", standins.STOPWORD_LEXICON)
    return scored.select("doc_id", "score_raw", "score_norm")


@query("clinical_term_flags", "term:s n_notes:l", "TXT11",
       "SELECT term, count(*) AS n_notes FROM (" + " UNION ALL ".join(
           f"SELECT {sq.q(t)} AS term FROM {_FOLDED_NOTES} WHERE regexp_matches(folded, {sq.q('(?i)' + p)})" for t, p in tx.CLINICAL_TERMS.items()
       ) + ") GROUP BY term")
def clinical_term_flags(s: Study):
    flags = tx.with_term_flags(s.discharge, "text").select(F.explode("term_flags").alias("term", "flag"))
    return flags.where("flag = 1").groupBy("term").agg(F.count(F.lit(1)).alias("n_notes"))


@query("any_trauma_term", "hadm_id:l hit:l", "TXT11",
       f"SELECT hadm_id, CASE WHEN {sq.any_substring('text', tx.TRAUMA_SUBSTRINGS)} THEN 1 ELSE 0 END AS hit FROM discharge")
def any_trauma_term(s: Study):
    return s.discharge.select("hadm_id", tx.contains_any(F.col("text"), tx.TRAUMA_SUBSTRINGS).cast("int").alias("hit"))


_WORDS = f"regexp_extract_all(text, {sq.q(chr(92) + 'S+')})"


@query("first_words", "doc_id:l head:s", "TXT13",
       f"SELECT doc_id, array_to_string(list_slice({_WORDS}, 1, 512), ' ') AS head FROM documents")
def first_words(s: Study):
    return _documents(s).select("doc_id", tx.first_words(F.col("text"), 512).alias("head"))


_WINDOWS = f"""SELECT doc_id, CAST(k AS BIGINT) AS window_no, len(part) AS n_words, array_to_string(part, ' ') AS window_text FROM (
    SELECT doc_id, k, list_slice(w, k * 64 + 1, k * 64 + 126) AS part FROM (
        SELECT doc_id, w, unnest(range(0, 1 + CASE WHEN len(w) <= 126 THEN 0 ELSE CAST(ceil((len(w) - 126) / 64.0) AS BIGINT) END)) AS k
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))"""


@query("text_windows", "doc_id:l window_no:l n_words:l window_text:s", "TXT14", _WINDOWS)
def text_windows(s: Study):
    return attribution.windows(_documents(s), "text", 128, 64, ["doc_id"])


_WINDOW_SCORE = f"({sq.hits('folded', chr(92) + 'bthe' + chr(92) + 'b')} + {sq.hits('folded', chr(92) + 'band' + chr(92) + 'b')}) / n_words::DOUBLE"


@query("pooled_window_scores", "doc_id:l max_pool:d mean_pool:d n_windows:l best_window:l", "TXT14 TXT15 WIN7",
       f"""SELECT doc_id, max(score) AS max_pool, avg(score) AS mean_pool, count(*) AS n_windows,
                  arg_max(window_no, score * 1e6 - window_no) AS best_window FROM (
              SELECT doc_id, window_no, round({_WINDOW_SCORE}, 6) AS score FROM (SELECT *, {sq.folded('window_text')} AS folded FROM ({_WINDOWS}) WHERE n_words > 0)) GROUP BY doc_id""")
def pooled_window_scores(s: Study):
    parts = attribution.windows(_documents(s), "text", 128, 64, ["doc_id"]).where("n_words > 0")
    count = F.regexp_count("window_text", F.lit(r"(?iU)\bthe\b")) + F.regexp_count("window_text", F.lit(r"(?iU)\band\b"))
    scored = parts.withColumn("score", F.round(count / F.col("n_words"), 6))
    return attribution.pooled(scored, ["doc_id"])


def _type_token_scorer(texts: list[str]) -> list[float]:
    """Stand-in scorer: share of distinct words, as any model function could return."""
    return [len(set(t.split())) / max(len(t.split()), 1) for t in texts]


@query("pluggable_window_scorer", "doc_id:l max_pool:d mean_pool:d n_windows:l best_window:l", "TXT14 TXT15",
       f"""SELECT doc_id, max(score) AS max_pool, avg(score) AS mean_pool, count(*) AS n_windows,
                  min(window_no) FILTER (WHERE score = best) AS best_window FROM (
              SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM (
                  SELECT doc_id, window_no, coalesce(len(list_distinct(string_split(window_text, ' '))) / nullif(n_words, 0)::DOUBLE, 0) AS score
                  FROM ({_WINDOWS}))) GROUP BY doc_id""")
def pluggable_window_scorer(s: Study):
    parts = attribution.windows(_documents(s), "text", 128, 64, ["doc_id"])
    return attribution.pooled(attribution.score_windows(parts, _type_token_scorer), ["doc_id"])


# ── attribution ─────────────────────────────────────────────────────────────

_LOCATED = """SELECT t.*, coalesce((SELECT arg_min(s.name, s.place) FROM spans s
        WHERE s.hadm_id = t.hadm_id AND t.tok_start >= s.span_start AND t.tok_end <= s.span_end), 'unknown') AS section FROM tokens t"""


def _tokens(s: Study):
    return standins.token_pieces(s.spark, s.sf_dir)


def _words(s: Study):
    return attribution.whole_words(standins.token_notes(s.spark, s.sf_dir))


def _spans(s: Study):
    return tx.with_sections(s.discharge, "text").select("hadm_id", tx.section_spans(F.col("sections")).alias("spans"))


@query("token_sections", "section:s n:l first_start:l last_end:l", "JN13",
       f"SELECT section, count(*) AS n, min(tok_start) AS first_start, max(tok_end) AS last_end FROM ({_LOCATED}) GROUP BY 1")
def token_sections(s: Study):
    return attribution.section_of(_tokens(s), _spans(s)).groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.min("tok_start").alias("first_start"), F.max("tok_end").alias("last_end")
    )


@query("attribution_by_section", "section:s total_attribution:d pct_of_total:d n_tokens:l mean_per_token:d", "ML11 JN13",
       f"""SELECT section, sum(abs(value)) AS total_attribution, sum(abs(value)) / sum(sum(abs(value))) OVER () * 100 AS pct_of_total,
                  count(*) AS n_tokens, sum(abs(value)) / count(*) AS mean_per_token FROM ({_LOCATED}) GROUP BY section""")
def attribution_by_section(s: Study):
    return attribution.by_section(attribution.section_of(_tokens(s), _spans(s)))


_LETTER = r"[\p{L}''\-]$"
_WORDS_MERGED = rf"""SELECT hadm_id, word, value, word_start FROM (
    SELECT hadm_id, g, lower(string_agg(token, '' ORDER BY tok_start)) AS word, sum(value) AS value, min(tok_start) AS word_start FROM (
        SELECT *, sum(CASE WHEN prev_end = tok_start AND regexp_matches(prev_token, '{_LETTER}') THEN 0 ELSE 1 END) OVER (PARTITION BY hadm_id ORDER BY tok_start) AS g FROM (
            SELECT *, lag(tok_end) OVER (PARTITION BY hadm_id ORDER BY tok_start) AS prev_end,
                   lag(token) OVER (PARTITION BY hadm_id ORDER BY tok_start) AS prev_token FROM tokens)) GROUP BY hadm_id, g)
    WHERE regexp_matches(word, '^[\p{{L}}''\-]{{2,}}$')"""


@query("whole_word_values", "hadm_id:l word:s value:d word_start:l", "TXT17", _WORDS_MERGED)
def whole_word_values(s: Study):
    return _words(s)


_TERMS = f"""SELECT word, avg(value) AS mean_attribution, stddev_pop(value) AS std_attribution, count(*) AS n_occurrences,
    sum(value) AS total_attribution FROM ({_WORDS_MERGED}) GROUP BY word HAVING count(*) >= 3"""


@query("attribution_by_term", "word:s mean_attribution:d std_attribution:d n_occurrences:l total_attribution:d", "ML12", _TERMS)
def attribution_by_term(s: Study):
    return attribution.by_term(_words(s))


@query("top_terms_by_attribution", "word:s n_occurrences:l mean_attribution:d", "TOP2 ML12",
       f"SELECT word, n_occurrences, mean_attribution FROM ({_TERMS}) ORDER BY mean_attribution DESC, word LIMIT 50")
def top_terms_by_attribution(s: Study):
    return attribution.top_by_mean(attribution.by_term(_words(s)))


# ── text features ───────────────────────────────────────────────────────────

_UNI = f"regexp_extract_all(lower(text), {sq.q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')})"
TFIDF_SQL = f"""WITH w AS (SELECT doc_id, {_UNI} AS w FROM documents),
    terms AS (
        SELECT doc_id, unnest(w) AS term FROM w
        UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, md5('42|' || term), term LIMIT 50000),
    raw AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE)) AS x FROM tf JOIN vocab USING (term)),
    unit AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("tfidf_terms", "term:s n_docs:l total_weight:d", "TXT16",
       f"{TFIDF_SQL} SELECT term, count(*) AS n_docs, sum(weight) AS total_weight FROM unit GROUP BY term")
def tfidf_terms(s: Study):
    weights = models.tfidf(_documents(s), "doc_id", "text")
    return weights.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("weight").alias("total_weight"))
