"""The registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import url_lists, warc
from cohortlens.llm.anchors import personal_data
from cohortlens.llm.common import table
from cohortlens.llm.curriculum import plan_mix
from cohortlens.llm.direct_codes import code_root, read_documents, write_codes
from cohortlens.llm.grid_codes import grid_codes, with_label_errors
from cohortlens.llm.hyperminhash import near_duplicates
from cohortlens.llm.kd_search import top_inner_products
from cohortlens.llm.label_sharding import shard_documents
from cohortlens.llm.line_runs import deduplicate_lines
from cohortlens.llm.outliers import judge
from cohortlens.llm.periodic_runs import periodic_runs, run_digests, with_planted_runs
from cohortlens.llm.tier_packing import pack

TOKENIZER = "word_bpe_49k.json"

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.filter_urls(url_lists.own_captures(pages), url_lists.own_lists(pages))


def token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_codes(docs, public_tokenizers.path(TOKENIZER), 2, code_root(docs)))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("distance")


def pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    out = pack(docs, public_tokenizers.path(TOKENIZER), 1)
    digest = F.crc32("ids").alias("ids_crc32")
    return out.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    out = plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = warc.assemble(warc.read_records(warc.write_archives(pages, warc.archive_root(pages))))
    found = warc.resolve_revisits(captures, warc.metadata_field("page-id").cast("long"))
    return found.select(
        warc.metadata_field("page-id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("capture.record_type").alias("record_type"),
        F.col("first.order").alias("refers_to"),
        (1 + F.size("requests") + F.size("metadata")).cast("long").alias("n_records"),
    )


def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebook = grid_codes(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(x) for part in codebook for entry in part for x in entry)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_errors(coded).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")
    )


NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""

_URL_KEYS = """
pages_h AS (
  SELECT page_id, url, (page_id * 37) % 730 AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '')[1:2] AS segments
  FROM pages),
pages_k AS (
  SELECT *, CASE WHEN host IS NULL THEN [] ELSE list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[:i], '/'))) END AS keys
  FROM pages_h),
numbers AS (
  SELECT key, ('0x' || substr(h, 1, 6))::BIGINT AS a, ('0x' || substr(h, 7, 6))::BIGINT % 730 AS first,
    ('0x' || substr(h, 13, 6))::BIGINT % 200 AS more, ('0x' || substr(h, 19, 6))::BIGINT % 730 AS allowed
  FROM (SELECT key, md5(key) AS h FROM (SELECT DISTINCT unnest(keys) AS key FROM pages_k))),
entries AS (
  SELECT key, 'block' AS list, first AS day, 'add' AS action FROM numbers WHERE a % 3 = 0
  UNION ALL SELECT key, 'block', first + 30 + more, 'remove' FROM numbers WHERE a % 3 = 0
  UNION ALL SELECT key, 'block', first + 120 + more, 'add' FROM numbers WHERE a % 3 = 0
  UNION ALL SELECT key, 'allow', allowed, 'add' FROM numbers WHERE a % 5 = 0),
spans AS (
  SELECT *, coalesce(lead(day) OVER (PARTITION BY key, list ORDER BY day), 1099511627776) AS until
  FROM (SELECT key, list, day, max(action) AS action FROM entries GROUP BY ALL))"""

URL_SQL = f"""
WITH {_URL_KEYS},
hits AS (
  SELECT page_id, e.key, e.list, e.day AS since,
    row_number() OVER (PARTITION BY page_id ORDER BY length(e.key) DESC, (e.list = 'allow') DESC, e.key DESC, e.day DESC) AS place
  FROM (SELECT page_id, day, unnest(keys) AS key FROM pages_k) p
  JOIN spans e ON e.key = p.key AND e.action = 'add' AND e.day <= p.day AND p.day < e.until)
SELECT p.page_id, p.day, p.host, coalesce(h.list, 'none') AS verdict, h.key AS matched_key, h.since AS listed_since,
  coalesce(h.list, 'none') <> 'block' AS kept
FROM pages_k p LEFT JOIN hits h ON h.page_id = p.page_id AND h.place = 1
"""

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, o.owner IS NOT NULL AND o.owner < doc_id AS gone FROM keyed k LEFT JOIN owners o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS q
  FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(q, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, 3::BIGINT AS n_records
FROM d
"""

_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

RUNS_SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
hashed AS (
  SELECT doc_id, {_WORDS.format('text')} AS ws,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
planned AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a,
    CASE WHEN len(ws) > 0 THEN 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) END AS p
  FROM hashed),
texts AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws
  FROM planned),
words AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM texts),
-- A lag counts only where three words in a row recur, as every run has that.
grams AS (
  SELECT doc_id, n, i, w, hash(w, lead(w, 1) OVER s, lead(w, 2) OVER s) AS g, lead(w, 2) OVER s IS NOT NULL AS whole
  FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS lag FROM grams x JOIN grams y
    ON x.doc_id = y.doc_id AND x.g = y.g AND x.whole AND y.whole AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
chains AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS chain FROM pairs),
stretches AS (
  SELECT doc_id, lag AS period, min(i) - lag AS start, count(*) + 2 + lag AS length FROM chains GROUP BY doc_id, lag, chain
  HAVING count(*) + 2 + lag >= greatest(6, 4 * lag)),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY ALL),
summed AS (
  SELECT doc_id, count(*) AS n_runs, max({{'l': length, 's': -start, 'p': -period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.p)::BIGINT AS period,
  (1000 * best.l // -best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN summed USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""


def _round(k: int) -> str:
    """SQL of one assignment of every part and the entries' means."""
    return f"""
a{k} AS (
  SELECT vec_id, p, any_value(x) AS x, min(64 * list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT + e) AS best
  FROM parts JOIN c{k} USING (p) GROUP BY vec_id, p),
m{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, best % 64 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY 1, 2, 3)
  GROUP BY p, e),
c{k + 1} AS (SELECT p, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))"""


CODES_SQL = f"""
WITH base AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(0, 16)) AS p FROM base)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),
{_round(0)},
{_round(1)},
{_round(2)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM coded JOIN base USING (vec_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_lists": url_filter,
    "op2_direct_codes": token_codes,
    "op3_label_sharding": sharding,
    "op4_robust_outliers": quality_rules,
    "op5_anchor_pii": pii_anchors,
    "op6_line_runs": line_dedup,
    "op7_kd_search": top_k,
    "op8_tier_packing": packing,
    "op9_curriculum_mix": curriculum,
    "op10_hyperminhash_near_dedup": near_dedup,
    "op11_warc_transactions": warc_transactions,
    "op12_periodic_runs": periodic,
    "op13_grid_codes": vector_codes,
}

#: The other operators are iterative, tokenize or hash in ways that SQL lacks; tests/llm checks them against plain Python.
SQL: dict[str, str] = {
    "op1_url_lists": URL_SQL,
    "op6_line_runs": LINES_SQL,
    "op7_kd_search": TOP_K_SQL,
    "op10_hyperminhash_near_dedup": NEAR_SQL,
    "op11_warc_transactions": WARC_SQL,
    "op12_periodic_runs": RUNS_SQL,
    "op13_grid_codes": CODES_SQL,
}
