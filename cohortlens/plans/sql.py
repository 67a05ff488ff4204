"""The same stand-ins and stages in plain SQL, written independently of the operators.

``assemble`` puts the needed common table expressions in front of a query.
"""

from __future__ import annotations

import re

from cohortlens.functions import codes as cd
from cohortlens.functions import demographics as dm
from cohortlens.functions import stats as st_
from cohortlens.functions import text as tx
from cohortlens.plans import standins as st


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chars(text: str) -> str:
    """String literal with line breaks spelled as chr(10)."""
    return " || chr(10) || ".join(q(p) for p in text.split("\n")) if "\n" in text else q(text)


def case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k if isinstance(k, int) else q(k)} THEN {chars(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def any_prefix(column: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {q(p)})" for p in prefixes) + ")"


def any_substring(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), {q(p)})" for p in parts) + ")"


def uniform(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296e0)"


def age_bucket(age: str) -> str:
    whens = " ".join(f"WHEN CAST({age} AS INT) BETWEEN {a} AND {a + 9} THEN '{a}s'" for a in (20, 30, 40, 50))
    return f"CASE {whens} ELSE 'Other' END"


def race(column: str, labels: dict[str, str]) -> str:
    u = f"upper(coalesce({column}, ''))"
    return (
        f"CASE WHEN {u} LIKE '%WHITE%' THEN {q(labels['white'])}"
        f" WHEN {u} LIKE '%BLACK%' OR {u} LIKE '%AFRICAN%' THEN {q(labels['black'])}"
        f" WHEN {u} LIKE '%HISPANIC%' OR {u} LIKE '%LATINO%' THEN {q(labels['hispanic'])}"
        f" WHEN {u} LIKE '%ASIAN%' THEN {q(labels['asian'])} ELSE {q(labels['other'])} END"
    )


def folded(column: str) -> str:
    """Accented letters as "_", so that ASCII word boundaries fall where Unicode ones do."""
    return f"regexp_replace({column}, '[\\x{{C0}}-\\x{{24F}}]', '_', 'g')"


def hits(column: str, pattern: str) -> str:
    """Number of case-insensitive matches."""
    return f"len(regexp_extract_all({column}, {q('(?i)' + pattern)}))"


def lexicon_score(column: str, lexicon) -> str:
    return "(" + " + ".join(f"{w}e0 * {hits(column, p)}" for p, w, _ in lexicon) + ")"


def percentile(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"


def _rational(x: str, coefficients: tuple[list[float], list[float]]) -> str:
    top, bottom = coefficients
    num, den = f"{x} * {top[-1]!r}::DOUBLE", x
    for a, b in zip(top[:-2], bottom[:-1], strict=True):
        num, den = f"({num} + {a!r}::DOUBLE) * {x}", f"({den} + {b!r}::DOUBLE) * {x}"
    return f"(({num} + {top[-2]!r}::DOUBLE) / ({den} + {bottom[-1]!r}::DOUBLE))"


def erfc(x: str) -> str:
    """Complementary error function of a column or bracketed expression."""
    y, square = f"abs({x})", f"({x} * {x})"
    inverse = f"(1e0 / greatest({square}, 1e-300))"
    middle = f"exp(-{square}) * {_rational(y, st_.ERFC_MIDDLE)}"
    far = f"exp(-{square}) / {y} * (1e0 / sqrt(pi()) - {inverse} * {_rational(inverse, st_.ERFC_FAR)})"
    upper = f"CASE WHEN {y} <= 4 THEN {middle} WHEN {y} < 27 THEN {far} ELSE 0e0 END"
    return f"CASE WHEN {y} <= 0.46875e0 THEN 1e0 - {x} * {_rational(square, st_.ERF_NEAR)} WHEN {x} < 0 THEN 2e0 - {upper} ELSE {upper} END"


def newton(source: str, grid: list[float], width: int, steps: int = 30) -> str:
    """(k, c, beta): penalised logistic fits of ``source`` (k, y, w, x) by full Newton steps, one recursion for all.

    x holds ``width`` doubles, the last of them 1 for the intercept, which is not
    penalised. Each step sums the bordered system, eliminates it pivot by pivot
    (it is positive definite) and subtracts the last column.
    """
    d = width
    return f"""
        WITH RECURSIVE newton_rows AS ({source}),
        newton_steps AS (
            SELECT 0 AS step, k, c, list_transform(range(0, {d}), lambda i: 0e0) AS beta
            FROM (SELECT DISTINCT k FROM newton_rows) CROSS JOIN (SELECT unnest({grid}::DOUBLE[]) AS c)
            UNION ALL
            SELECT step + 1, k, c, list_transform(range(1, {d} + 1), lambda i: beta[i] - solved[i][{d} + 1]) FROM (
                SELECT step, k, c, beta, list_reduce(list_concat([m], list_transform(range(1, {d} + 1), lambda q: [[q::DOUBLE]])),
                    lambda a, q: list_transform(range(1, {d} + 1), lambda i: CASE WHEN i = q[1][1]::INT THEN list_transform(a[i], lambda v: v / a[i][i])
                        ELSE list_transform(range(1, {d} + 2), lambda j: a[i][j] - a[i][q[1][1]::INT] * a[q[1][1]::INT][j] / a[q[1][1]::INT][q[1][1]::INT]) END)) AS solved
                FROM (
                    SELECT step, k, c, beta, list_transform(range(0, {d}), lambda i: list_transform(range(0, {d} + 1), lambda j:
                        c * flat[i * ({d} + 1) + j + 1] + CASE WHEN i < {d} - 1 AND j = i THEN 1e0 WHEN i < {d} - 1 AND j = {d} THEN beta[i + 1] ELSE 0e0 END)) AS m
                    FROM (
                        SELECT step, k, c, beta, list(v ORDER BY q) AS flat FROM (
                            SELECT step, k, c, beta, q, sum(CASE WHEN q % ({d} + 1) < {d} THEN h * x[q // ({d} + 1) + 1] * x[q % ({d} + 1) + 1] ELSE r * x[q // ({d} + 1) + 1] END) AS v
                            FROM (
                                SELECT *, w * p * (1 - p) AS h, w * (p - y) AS r, unnest(range(0, {d} * ({d} + 1))) AS q FROM (
                                    SELECT step, s.k, c, beta, y, w, x, 1e0 / (1e0 + exp(-list_dot_product(x, beta))) AS p
                                    FROM newton_steps s JOIN newton_rows n ON n.k = s.k WHERE step < {steps}))
                            GROUP BY step, k, c, beta, q)
                        GROUP BY step, k, c, beta))))
        SELECT k, c, beta FROM newton_steps WHERE step = {steps}"""


_LINES = "string_split(text, chr(10))"
_IS_HEADER = f"regexp_full_match(line, {q(tx.HEADER)})"
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"
_INTO_NOTE = "list_transform(" + _LINES + ", lambda x, i: concat(" + (
    case(f"(doc_id + i - 1) % {len(st.HEADERS)}", dict(enumerate(st.HEADERS)), "''")
) + ", x, " + case("(doc_id * 3 + i - 1) % 13", dict(enumerate(st.PHRASES)), "''") + "))"


def _sections(order: list[str], source: str, prefix: str) -> dict[str, str]:
    """CTEs that read sections line by line."""
    names = ", ".join(q(n) for n in order)
    rank = case("name", {n: str(i) for i, n in enumerate(order)})
    return {
        f"{prefix}_lines": f"""
            SELECT hadm_id, i, line, {_IS_HEADER} AS is_header,
                   sum(CASE WHEN {_IS_HEADER} THEN 1 ELSE 0 END) OVER (PARTITION BY hadm_id ORDER BY i) AS sec
            FROM (SELECT hadm_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM {source})""",
        f"{prefix}_bodies": f"""
            SELECT hadm_id, sec,
                   lower(trim(rtrim(rtrim(max(line) FILTER (WHERE is_header)), ':'))) AS name,
                   trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_header), ''), {_TRIM}) AS body
            FROM {prefix}_lines WHERE sec > 0 GROUP BY hadm_id, sec""",
        f"{prefix}_sections": f"""
            SELECT hadm_id, name, body, CAST({rank} AS INT) AS place FROM (
                SELECT *, row_number() OVER (PARTITION BY hadm_id, name ORDER BY sec) AS rn
                FROM {prefix}_bodies WHERE body <> '' AND name IN ({names})
            ) WHERE rn = 1""",
        f"{prefix}_joined": f"""
            SELECT hadm_id, string_agg(body, chr(10) || chr(10) ORDER BY place) AS note_text
            FROM {prefix}_sections GROUP BY hadm_id""",
    }


_FLAGS_DX = ", ".join(
    f"max(CASE WHEN {any_prefix('icd_code', p)} THEN 1 ELSE 0 END) AS \"{n}\"" for n, p in cd.COMORBIDITY_PREFIXES.items()
)
_FLAGS_RX = ", ".join(
    f"max(CASE WHEN {any_substring('drug', p)} THEN 1 ELSE 0 END) AS \"{n}\"" for n, p in cd.DRUG_SUBSTRINGS.items()
)
_ALL_FLAGS = ", ".join(
    f"coalesce(f.\"{n}\", 0) AS \"{n}\"" for n in [*cd.COMORBIDITY_PREFIXES, *cd.DRUG_SUBSTRINGS]
)
_TARGET = "((trim(icd_version) = '10' AND starts_with(icd_code, 'F431')) OR (trim(icd_version) = '9' AND icd_code = '30981'))"

MASK_REGEX = "(?i)" + "|".join(tx.MASK_PATTERNS)

CTES: dict[str, str] = {
    # stand-ins
    "patients": f"""
        SELECT c_custkey AS subject_id,
               CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(15 + c_custkey % 70 AS INT) AS anchor_age, 1998 AS anchor_year,
               {case('c_nationkey % 5', dict(enumerate(st.ERAS)))} AS anchor_year_group
        FROM customer""",
    "admissions": f"""
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
               o_orderdate + to_hours(o_orderkey % 240) AS dischtime,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'EW EMER.' WHEN '2-HIGH' THEN 'DIRECT EMER.'
                    WHEN '3-MEDIUM' THEN NULL ELSE 'ELECTIVE' END AS admission_type,
               CASE o_orderstatus WHEN 'F' THEN 'Medicaid' WHEN 'O' THEN 'Self Pay' ELSE 'Private' END AS insurance,
               {case('c_mktsegment', st.RACES)} AS race
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "diagnoses": f"""
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
               {case('l_partkey % 400', dict(enumerate(st.CODES)), "'Z00.0'")} AS icd_code,
               CASE WHEN l_partkey % 400 IN (1, 3, 5) THEN '9' ELSE '10' END AS icd_version
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prescriptions": f"""
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
               CASE WHEN l_partkey % 100 = 14 THEN NULL ELSE {case('l_partkey % 100', st.DRUGS, "'Saline'")} END AS drug,
               CASE WHEN l_orderkey % 50 <> 0 THEN l_shipdate END AS starttime
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "discharge": f"SELECT doc_id AS hadm_id, array_to_string({_INTO_NOTE}, chr(10)) AS text FROM documents",
    # cohort
    "coded": "SELECT subject_id, hadm_id, upper(replace(trim(icd_code), '.', '')) AS icd_code, icd_version FROM diagnoses",
    "positives": f"SELECT DISTINCT subject_id FROM coded WHERE {_TARGET}",
    "target_admissions": f"SELECT DISTINCT subject_id, hadm_id FROM coded WHERE {_TARGET}",
    "proxy_candidates": f"""
        SELECT DISTINCT a.subject_id
        FROM (SELECT subject_id, starttime FROM prescriptions WHERE {any_substring('drug', cd.DRUG_SUBSTRINGS['rx_prazosin'])}) a
        JOIN (SELECT subject_id, starttime FROM prescriptions WHERE {any_substring('drug', cd.DRUG_SUBSTRINGS['rx_ssri_snri'])}) b
          ON a.subject_id = b.subject_id
        WHERE abs(epoch_us(a.starttime) - epoch_us(b.starttime)) <= 180 * 86400000000""",
    "proxies": f"""
        SELECT subject_id FROM proxy_candidates
        WHERE subject_id NOT IN (SELECT subject_id FROM positives)
          AND subject_id NOT IN (SELECT subject_id FROM coded WHERE {any_prefix('icd_code', cd.EXCLUSION_PREFIXES)})""",
    "aged": """
        SELECT a.*, p.gender, p.anchor_age, p.anchor_year, year(a.admittime) AS admit_year,
               CASE WHEN p.anchor_age IS NOT NULL THEN greatest(18, p.anchor_age + year(a.admittime) - p.anchor_year) END AS age_at_admission
        FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id""",
    "pool": f"""
        SELECT subject_id, hadm_id, gender, age_at_admission, {age_bucket('age_at_admission')} AS decade FROM (
            SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM aged) WHERE rn = 1""",
    "cases": "SELECT * FROM pool WHERE subject_id IN (SELECT subject_id FROM positives)",
    "candidates": """
        SELECT * FROM pool WHERE subject_id NOT IN (SELECT subject_id FROM positives)
          AND subject_id NOT IN (SELECT subject_id FROM proxies)""",
    "demand": "SELECT decade, gender, 3 * count(*) AS needed FROM cases WHERE gender IS NOT NULL GROUP BY ALL",
    "unlabeled": """
        SELECT subject_id FROM (
            SELECT c.subject_id, d.needed,
                   row_number() OVER (PARTITION BY c.decade, c.gender ORDER BY md5('42|' || c.subject_id), c.subject_id) AS rn
            FROM candidates c JOIN demand d ON c.decade = d.decade AND c.gender = d.gender) WHERE rn <= needed""",
    "members": """
        SELECT subject_id, 'ptsd_pos' AS "group" FROM positives
        UNION ALL SELECT subject_id, 'proxy' FROM proxies UNION ALL SELECT subject_id, 'unlabeled' FROM unlabeled""",
    "adm_extract": """
        SELECT r.*, i.index_admittime, r.admittime = i.index_admittime AS is_index_admission
        FROM (SELECT a.*, m."group" FROM aged a JOIN members m ON a.subject_id = m.subject_id) r
        LEFT JOIN (
            SELECT a.subject_id, min(a.admittime) AS index_admittime
            FROM aged a JOIN members m ON a.subject_id = m.subject_id
            LEFT JOIN target_admissions t ON a.subject_id = t.subject_id AND a.hadm_id = t.hadm_id
            WHERE m."group" <> 'ptsd_pos' OR t.hadm_id IS NOT NULL GROUP BY a.subject_id
        ) i ON r.subject_id = i.subject_id""",
    "index_rows": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY hadm_id) AS rn FROM adm_extract WHERE is_index_admission
        ) WHERE rn = 1""",
    "prior_admissions": "SELECT subject_id, hadm_id, \"group\" FROM adm_extract WHERE admittime < index_admittime",
    "prior_flags": f"""
        SELECT i.subject_id, coalesce(n.n, 0) AS n_prior_admissions, {_ALL_FLAGS}
        FROM index_rows i
        LEFT JOIN (SELECT subject_id, count(*) AS n FROM prior_admissions GROUP BY 1) n ON i.subject_id = n.subject_id
        LEFT JOIN (
            SELECT subject_id, * EXCLUDE (subject_id) FROM
            (SELECT c.subject_id, {_FLAGS_DX} FROM coded c JOIN prior_admissions p USING (subject_id, hadm_id) GROUP BY 1)
            FULL JOIN
            (SELECT r.subject_id, {_FLAGS_RX} FROM prescriptions r JOIN prior_admissions p USING (subject_id, hadm_id) GROUP BY 1)
            USING (subject_id)
        ) f ON i.subject_id = f.subject_id""",
    "admission_counts": "SELECT subject_id, count(DISTINCT hadm_id) AS total_admissions FROM admissions GROUP BY 1",
    "profile": """
        SELECT i.*, c.total_admissions, f.* EXCLUDE (subject_id),
               (epoch_us(i.dischtime) - epoch_us(i.admittime)) / 86400e6 AS los_days
        FROM index_rows i LEFT JOIN admission_counts c ON i.subject_id = c.subject_id
        JOIN prior_flags f ON i.subject_id = f.subject_id""",
    # notes
    **_sections(tx.SECTION_ORDER, "discharge", "all"),
    **_sections(tx.SECTION_ORDER_NO_PMH, "discharge", "nopmh"),
    "notes_kept": """
        SELECT e.subject_id, e.hadm_id, e."group", j.note_text,
               (e."group" = 'ptsd_pos' AND e.admittime < e.index_admittime) AS is_prediagnosis
        FROM adm_extract e JOIN all_joined j ON e.hadm_id = j.hadm_id
        WHERE e.is_index_admission OR (e."group" = 'ptsd_pos' AND e.admittime < e.index_admittime)""",
    "notes_raw": """
        SELECT * FROM notes_kept WHERE NOT ("group" = 'ptsd_pos' AND NOT is_prediagnosis
            AND subject_id IN (SELECT subject_id FROM notes_kept WHERE "group" = 'ptsd_pos' AND is_prediagnosis))""",
    "corpus": f"""
        SELECT subject_id, hadm_id, "group", CASE WHEN "group" = 'ptsd_pos' THEN 1 ELSE 0 END AS label,
               CASE WHEN "group" = 'ptsd_pos' THEN regexp_replace(note_text, {q(MASK_REGEX)}, {q(tx.MASK_TOKEN)}, 'g') ELSE note_text END AS note_text,
               "group" = 'ptsd_pos' AS is_masked
        FROM notes_raw WHERE "group" <> 'proxy'""",
    "subject_labels": "SELECT subject_id, arg_min(label, hadm_id) AS label FROM corpus GROUP BY 1",
    # scores
    "labelled_docs": """
        SELECT o_custkey AS subject_id, l.doc_id AS hadm_id, l.quality AS label, l.toxic, d.text, d.lang, d.n_chars
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN orders ON o_orderkey = l.doc_id""",
    "scored_docs": f"""
        SELECT *, {lexicon_score('folded', st.STOPWORD_LEXICON)} AS score_raw, {uniform("'42'", 'hadm_id')} AS u,
               {hits('text', chr(92) + 'S+')} AS n_words,
               CASE WHEN {uniform("'7'", 'subject_id')} < 0.5e0 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, {folded('text')} AS folded FROM labelled_docs)""",
    "scores": """
        SELECT 'kw' AS model, split, subject_id, hadm_id, label, score_raw AS score FROM scored_docs
        UNION ALL SELECT 'kw_norm', split, subject_id, hadm_id, label, CASE WHEN n_words > 0 THEN score_raw / n_words ELSE 0e0 END FROM scored_docs
        UNION ALL SELECT 'len', split, subject_id, hadm_id, label, n_chars / (n_chars + 2000e0) FROM scored_docs
        UNION ALL SELECT 'hash', split, subject_id, hadm_id, label, u FROM scored_docs
        UNION ALL SELECT 'grid', split, subject_id, hadm_id, label, floor(u * 20) / 20e0 FROM scored_docs""",
    "platt": newton("SELECT model AS k, label AS y, 1e0 AS w, [score, 1e0] AS x FROM scores WHERE split = 'val'", [1.0], 2),
    "platt_scores": """
        SELECT s.*, 1e0 / (1e0 + exp(-(score * beta[1] + beta[2]))) AS calibrated FROM scores s JOIN platt ON k = model""",
    "probabilities": "SELECT * EXCLUDE (calibrated) REPLACE (CASE WHEN model = 'kw' THEN calibrated ELSE score END AS score) FROM platt_scores",
    "thresholds": """
        SELECT model, coalesce(max(score) FILTER (WHERE recall >= 0.85e0), min(score)) AS threshold FROM (
            SELECT t.model, t.score, sum(CASE WHEN s.label = 1 AND s.score >= t.score THEN 1 ELSE 0 END) / nullif(sum(s.label), 0)::DOUBLE AS recall
            FROM (SELECT DISTINCT model, score FROM scores WHERE split = 'val') t
            JOIN (SELECT * FROM scores WHERE split = 'val') s ON s.model = t.model GROUP BY ALL) GROUP BY model""",
    "decided": "SELECT s.*, t.threshold, CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END AS predicted FROM scores s JOIN thresholds t ON s.model = t.model",
    "demo": f"""
        SELECT subject_id, coalesce(gender, 'Unknown') AS gender, {race('race', dm.RACE_LABELS_SHORT)} AS race_cat,
               {age_bucket('age_at_admission')} AS age_group, coalesce(upper(admission_type) LIKE '%EMER%', false) AS is_emergency
        FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn
              FROM aged WHERE hadm_id IN (SELECT hadm_id FROM scores)) WHERE rn = 1""",
    "decided_demo": """
        SELECT d.*, m.gender, m.race_cat, m.age_group, m.is_emergency,
               CASE WHEN m.race_cat = 'White' THEN 'White' ELSE 'Non-White' END AS race_binary
        FROM decided d JOIN demo m ON d.subject_id = m.subject_id""",
    "grouped": """
        SELECT *, 'sex' AS "group", gender AS value FROM decided_demo
        UNION ALL SELECT *, 'age_group', age_group FROM decided_demo
        UNION ALL SELECT *, 'race', race_cat FROM decided_demo
        UNION ALL SELECT *, 'race_binary', race_binary FROM decided_demo
        UNION ALL SELECT *, 'emergency', CAST(is_emergency AS VARCHAR) FROM decided_demo""",
    # token attributions
    "runs": f"""
        SELECT hadm_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos
        FROM (SELECT hadm_id, regexp_extract_all(note_text, {q(chr(92) + 'S+|' + chr(92) + 's+')}) AS r FROM all_joined)""",
    "placed": """
        SELECT hadm_id, run, coalesce(sum(length(run)) OVER (PARTITION BY hadm_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
        FROM runs""",
    "tokens": f"""
        SELECT hadm_id, CAST(base + o AS BIGINT) AS tok_start, CAST(base + o AS BIGINT) + length(substr(run, o + 1, 5)) AS tok_end,
               substr(run, o + 1, 5) AS token, {uniform("'9'", 'hadm_id', 'CAST(base + o AS BIGINT)')} AS value
        FROM (SELECT hadm_id, run, base, CAST(unnest(range(0, length(run), 5)) AS INT) AS o FROM placed WHERE regexp_matches(run, '{chr(92)}S'))""",
    "spans": """
        SELECT hadm_id, name, place,
               coalesce(sum(length(body) + 2) OVER (PARTITION BY hadm_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span_start,
               coalesce(sum(length(body) + 2) OVER (PARTITION BY hadm_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(body) AS span_end
        FROM all_sections""",
}


def _needed(text: str, found: dict[str, None]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            found[name] = None


def assemble(sql: str, columns: dict[str, str]) -> str:
    """Query with its CTEs in front and every output column cast and rounded."""
    found: dict[str, None] = {}
    _needed(sql, found)
    prefix = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in found) + " " if found else ""
    kinds = {"s": "VARCHAR", "l": "BIGINT", "t": "TIMESTAMP"}

    def output(name: str, kind: str) -> str:
        quoted = f'"{name}"'
        if kind == "d":
            return f"round(CAST({quoted} AS DOUBLE), 9) + 0e0 AS {quoted}"
        return f"CAST({quoted} AS {kinds[kind]}) AS {quoted}"

    picks = ", ".join(output(n, k) for n, k in columns.items())
    return f"{prefix}SELECT {picks} FROM ({sql}) result"
