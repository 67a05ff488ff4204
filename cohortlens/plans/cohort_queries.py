"""Queries on codes, cohorts, joins, sets, samples and the characteristics table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import codes, demographics
from cohortlens.operators import (
    characteristics,
    cohort,
    controls,
    corpus,
    features,
    prefix,
    sampling,
)
from cohortlens.plans import sql as sq
from cohortlens.plans import standins
from cohortlens.plans.registry import query
from cohortlens.plans.study import Study
from cohortlens.session import materialise

GROUPS = [cohort.POSITIVE, cohort.PROXY, cohort.UNLABELED]


# ── projections and predicates ──────────────────────────────────────────────


@query(
    "icd_codes_normalised", "icd_code:s is_target:l is_mdd:l is_exact:l n:l", "PRJ1 PRJ2 PRJ3 PRJ4 SRC2",
    f"""SELECT icd_code, CASE WHEN {sq._TARGET} THEN 1 ELSE 0 END AS is_target,
               CASE WHEN {sq.any_prefix('icd_code', codes.COMORBIDITY_PREFIXES['dx_MDD'])} THEN 1 ELSE 0 END AS is_mdd,
               CASE WHEN icd_code = '30500' THEN 1 ELSE 0 END AS is_exact, count(*) AS n
        FROM coded GROUP BY ALL""",
)
def icd_codes_normalised(s: Study):
    coded = cohort.coded_rows(s.diagnoses)
    code = F.col("icd_code")
    return coded.groupBy(
        "icd_code",
        codes.is_target_code(code, F.col("icd_version")).cast("int").alias("is_target"),
        codes.has_prefix(code, codes.COMORBIDITY_PREFIXES["dx_MDD"]).cast("int").alias("is_mdd"),
        codes.is_code(code, "30500").cast("int").alias("is_exact"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "drug_predicates", "drug:s ssri:l sga:l usable:l n:l", "PRJ5 PRJ6",
    f"""SELECT drug, CASE WHEN {sq.any_substring('drug', codes.DRUG_SUBSTRINGS['rx_ssri_snri'])} THEN 1 ELSE 0 END AS ssri,
               CASE WHEN {sq.any_substring('drug', codes.DRUG_SUBSTRINGS['rx_SGA'])} THEN 1 ELSE 0 END AS sga,
               CASE WHEN length(trim(coalesce(drug, ''))) > 0 AND starttime IS NOT NULL THEN 1 ELSE 0 END AS usable, count(*) AS n
        FROM prescriptions GROUP BY ALL""",
)
def drug_predicates(s: Study):
    drug = F.col("drug")
    return s.prescriptions.groupBy(
        "drug",
        codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_ssri_snri"]).cast("int").alias("ssri"),
        codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_SGA"]).cast("int").alias("sga"),
        (codes.not_blank(drug) & F.col("starttime").isNotNull()).cast("int").alias("usable"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "admission_columns",
    "subject_id:l hadm_id:l age:l age_raw:l decade:s race_long:s race_short:s race_binary:s emergency:l payer_table:l payer_features:l los_days:d",
    "PRJ8 PRJ9 PRJ10 PRJ11 PRJ12 PRJ13 PRJ15 JN3",
    f"""SELECT subject_id, hadm_id, age_at_admission AS age, anchor_age + admit_year - anchor_year AS age_raw,
               {sq.age_bucket('age_at_admission')} AS decade,
               {sq.race('race', demographics.RACE_LABELS_LONG)} AS race_long,
               {sq.race('race', demographics.RACE_LABELS_SHORT)} AS race_short,
               CASE WHEN {sq.race('race', demographics.RACE_LABELS_SHORT)} = 'White' THEN 'White' ELSE 'Non-White' END AS race_binary,
               CASE WHEN upper(coalesce(admission_type, '')) LIKE '%EMER%' THEN 1 ELSE 0 END AS emergency,
               CASE WHEN upper(insurance) IN ('MEDICAID', 'SELF PAY', 'SELF-PAY') THEN 1 ELSE 0 END AS payer_table,
               CASE WHEN upper(insurance) IN ('MEDICAID', 'SELF PAY') THEN 1 ELSE 0 END AS payer_features,
               (epoch_us(dischtime) - epoch_us(admittime)) / 86400e6 AS los_days
        FROM aged""",
)
def admission_columns(s: Study):
    d = demographics
    aged = cohort.with_age(s.admissions, s.patients)
    short = d.race_category(F.col("race"))
    return aged.select(
        "subject_id", "hadm_id", F.col("age_at_admission").alias("age"),
        d.age_at(F.col("anchor_age"), F.col("anchor_year"), F.col("admittime"), floor=None).alias("age_raw"),
        d.age_bucket(F.col("age_at_admission")).alias("decade"),
        d.race_category(F.col("race"), d.RACE_LABELS_LONG).alias("race_long"),
        short.alias("race_short"),
        d.binary_race(short).alias("race_binary"),
        d.is_emergency(F.col("admission_type")).cast("int").alias("emergency"),
        d.has_payer(F.col("insurance"), d.PAYERS_TABLE).cast("int").alias("payer_table"),
        d.has_payer(F.col("insurance"), d.PAYERS_FEATURES).cast("int").alias("payer_features"),
        d.days_between(F.col("admittime"), F.col("dischtime")).alias("los_days"),
    )


@query(
    "race_one_hot", "race_Asian:l race_Black:l race_Hispanic:l race_Other/Unknown:l race_White:l n:l", "PRJ14",
    "SELECT " + ", ".join(
        f"CASE WHEN {sq.race('race', demographics.RACE_LABELS_SHORT)} = '{k}' THEN 1 ELSE 0 END AS \"race_{k}\""
        for k in sorted(demographics.RACE_LABELS_SHORT.values())
    ) + ", count(*) AS n FROM admissions GROUP BY ALL",
)
def race_one_hot(s: Study):
    category = demographics.race_category(F.col("race"))
    columns = demographics.one_hot(category, list(demographics.RACE_LABELS_SHORT.values()), "race_")
    return s.admissions.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "propensity_clipping", "subject_id:l clipped:d", "PRJ17",
    f"SELECT c_custkey AS subject_id, least(greatest({sq.uniform('c_custkey')}, 0.05e0), 0.95e0) AS clipped FROM customer",
)
def propensity_clipping(s: Study):
    u = standins.md5_uniform(F.col("subject_id"))
    return s.patients.select("subject_id", demographics.clip(u, 0.05, 0.95).alias("clipped"))


# ── joins and sets ──────────────────────────────────────────────────────────


@query("target_subjects", "subject_id:l", "PRJ2 SET5", "SELECT * FROM positives")
def target_subjects(s: Study):
    return s.positives


@query("cohort_semi_join", "subject_id:l n:l", "JN1",
       "SELECT subject_id, count(*) AS n FROM admissions WHERE subject_id IN (SELECT subject_id FROM positives) GROUP BY 1")
def cohort_semi_join(s: Study):
    return cohort.keep_members(s.admissions, s.positives, "subject_id").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("unlabeled_candidates", "subject_id:l gender:s age_at_admission:l decade:s", "JN2 JN3 SET2",
       "SELECT subject_id, gender, age_at_admission, decade FROM candidates")
def unlabeled_candidates(s: Study):
    return s.candidates.select("subject_id", "gender", "age_at_admission", "decade")


@query("drug_band_join", "subject_id:l", "JN4 SET1", "SELECT * FROM proxy_candidates")
def drug_band_join(s: Study):
    return cohort.proxy_candidates(s.prescriptions)


@query("proxy_subjects", "subject_id:l", "JN2 JN4 SET2", "SELECT * FROM proxies")
def proxy_subjects(s: Study):
    return s.proxies


@query(
    "subject_set_algebra", "set_name:s n:l", "SET1 SET2 SET3 SET5",
    f"""WITH p AS (SELECT DISTINCT subject_id FROM prescriptions WHERE {sq.any_substring('drug', ['prazosin'])}),
             a AS (SELECT DISTINCT subject_id FROM prescriptions WHERE {sq.any_substring('drug', codes.DRUG_SUBSTRINGS['rx_ssri_snri'])})
        SELECT 'both' AS set_name, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM a)
        UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM p UNION SELECT * FROM a)
        UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM a)""",
)
def subject_set_algebra(s: Study):
    drug = F.col("drug")
    p = cohort.keys_where(s.prescriptions, codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_prazosin"]), "subject_id")
    a = cohort.keys_where(s.prescriptions, codes.drug_matches(drug, codes.DRUG_SUBSTRINGS["rx_ssri_snri"]), "subject_id")
    sets = {"both": p.intersect(a), "either": p.union(a).distinct(), "first_only": p.subtract(a)}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("set_name"), "n") for k, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("group_members", "subject_id:l group:s", "PRJ7 SET3 SMP1", "SELECT * FROM members")
def group_members(s: Study):
    return s.members


@query(
    "admission_extract",
    "subject_id:l hadm_id:l admittime:t dischtime:t admission_type:s insurance:s race:s group:s gender:s anchor_age:l anchor_year:l admit_year:l age_at_admission:l index_admittime:t is_index_admission:l",
    "JN1 JN3 JN5 PRJ7 PRJ8 WIN2 AGG1",
    "SELECT * FROM adm_extract",
)
def admission_extract(s: Study):
    return s.extract


@query("before_index_flags", "subject_id:l hadm_id:l is_prior:l", "PRJ18",
       "SELECT subject_id, hadm_id, CASE WHEN admittime < index_admittime THEN 1 ELSE 0 END AS is_prior FROM adm_extract")
def before_index_flags(s: Study):
    prior = F.coalesce(F.col("admittime") < F.col("index_admittime"), F.lit(False))
    return s.extract.select("subject_id", "hadm_id", prior.cast("int").alias("is_prior"))


@query("first_admissions", "subject_id:l hadm_id:l admittime:t", "WIN1",
       """SELECT subject_id, hadm_id, admittime FROM (
              SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM admissions) WHERE rn = 1""")
def first_admissions(s: Study):
    return cohort.first_rows(s.admissions, "subject_id", "admittime", "hadm_id", ["hadm_id", "admittime"])


@query("first_event_times", "subject_id:l first_time:t n_admissions:l", "AGG1 AGG2",
       "SELECT subject_id, min(admittime) AS first_time, count(DISTINCT hadm_id) AS n_admissions FROM admissions GROUP BY 1")
def first_event_times(s: Study):
    first = cohort.first_time(s.admissions, "subject_id", "admittime", "first_time")
    counts = cohort.admission_counts(s.admissions).withColumnRenamed("total_admissions", "n_admissions")
    return first.join(counts, "subject_id")


@query("prior_admission_rows", "subject_id:l hadm_id:l", "JN6 PRJ18",
       "SELECT subject_id, hadm_id FROM prior_admissions")
def prior_admission_rows(s: Study):
    return cohort.prior_rows(s.extract.drop("index_admittime"), s.index).select("subject_id", "hadm_id")


@query("prior_diagnosis_rows", "subject_id:l hadm_id:l icd_code:s n:l", "JN7",
       "SELECT c.subject_id, c.hadm_id, c.icd_code, count(*) AS n FROM coded c JOIN prior_admissions p USING (subject_id, hadm_id) GROUP BY ALL")
def prior_diagnosis_rows(s: Study):
    prior = cohort.prior_rows(s.extract.drop("index_admittime"), s.index)
    return cohort.coded_rows(cohort.events_of(s.diagnoses, prior)).groupBy("subject_id", "hadm_id", "icd_code").agg(
        F.count(F.lit(1)).alias("n")
    )


_FLAGS = cohort.FLAG_COLUMNS


@query(
    "prior_history_flags", "subject_id:l n_prior_admissions:l " + " ".join(f"{f}:l" for f in _FLAGS) + " prior_psych_any:l",
    "AGG3 AGG4 AGG5 JN6 JN7 JN15",
    'SELECT *, greatest("dx_MDD", "dx_anxiety", "dx_suicidal") AS prior_psych_any FROM prior_flags',
)
def prior_history_flags(s: Study):
    return cohort.prior_flags(s.extract, s.index, s.diagnoses, s.prescriptions)


@query(
    "flag_coverage", "flag:s n:l share:d", "AGG14",
    "SELECT flag, sum(v) AS n, avg(v) AS share FROM (UNPIVOT (SELECT * EXCLUDE (subject_id, n_prior_admissions) FROM prior_flags) ON * INTO NAME flag VALUE v) GROUP BY flag",
)
def flag_coverage(s: Study):
    flags = cohort.prior_flags(s.extract, s.index, s.diagnoses, s.prescriptions)
    return cohort.flag_coverage(flags, _FLAGS)


# ── reports ─────────────────────────────────────────────────────────────────


def _characteristics_sql() -> str:
    race = sq.race("race", demographics.RACE_LABELS_LONG)
    bucket = sq.age_bucket("age_at_admission")
    items = {
        "Female": "gender = 'F'", "Male": "gender = 'M'",
        "OtherSex": "coalesce(gender, '') NOT IN ('F', 'M')",
    }
    for a in demographics.AGE_BUCKETS:
        items[f"Age_{a}"] = f"{bucket} = '{a}'"
    for label in demographics.RACE_LABELS_LONG.values():
        key = label.replace("/", "_").replace(" ", "_").replace("-", "_")
        items[f"Race_{key}"] = f"{race} = '{label}'"
    items["Single_admit"] = "total_admissions = 1"
    items["Multi_admit"] = "total_admissions > 1"
    items["Emergency"] = "upper(admission_type) LIKE '%EMER%'"
    items["MedicaidSelfPay"] = "upper(insurance) IN ('MEDICAID', 'SELF PAY', 'SELF-PAY')"
    for f in _FLAGS:
        kind, rest = f.split("_", 1)
        items[f"{kind.capitalize()}_{rest}"] = f'"{f}" = 1'
    values = {"N": "count(*)"}
    for k, c in items.items():
        hit = f"count(*) FILTER (WHERE {c})"
        values[f"{k}_n"] = hit
        values[f"{k}_pct"] = f"{hit} / count(*)::DOUBLE * 100"
    values["Age_mean"] = "avg(age_at_admission)"
    values["Age_sd"] = "stddev_samp(age_at_admission)"
    for m, column in (("Admissions", "total_admissions"), ("LOS", "los_days")):
        for level, p in characteristics.QUARTILES.items():
            values[f"{m}_{level}"] = sq.percentile(column, p)
    columns = ", ".join(f'CAST({e} AS DOUBLE) AS "{k}"' for k, e in values.items())
    return f'UNPIVOT (SELECT "group", {columns} FROM profile GROUP BY "group") ON * EXCLUDE ("group") INTO NAME item VALUE value'


@query("group_characteristics", "group:s item:s value:d", "AGG6", f"SELECT * FROM ({_characteristics_sql()})")
def group_characteristics(s: Study):
    return s.characteristics


@query(
    "characteristics_table", "characteristic:s ptsd_pos:d proxy:d unlabeled:d", "AGG6 AGG7",
    "SELECT item AS characteristic, " + ", ".join(f"max(value) FILTER (WHERE \"group\" = '{g}') AS {g}" for g in GROUPS)
    + f" FROM ({_characteristics_sql()}) GROUP BY item",
)
def characteristics_table(s: Study):
    return characteristics.transposed(s.characteristics, GROUPS)


@query("prediagnosis_share", "n:l n_predx:l predx_share:d", "AGG6",
       """SELECT count(*) AS n, sum(h) AS n_predx, avg(h) AS predx_share FROM (
              SELECT subject_id, max(CASE WHEN admittime < index_admittime THEN 1 ELSE 0 END) AS h
              FROM adm_extract WHERE "group" = 'ptsd_pos' GROUP BY 1)""")
def prediagnosis_share(s: Study):
    return characteristics.predx_share(s.extract)


@query("group_summary", "group:s n_patients:l n_admissions:l n_index:l", "AGG16",
       """SELECT "group", count(DISTINCT subject_id) AS n_patients, count(*) AS n_admissions,
                 sum(CASE WHEN is_index_admission THEN 1 ELSE 0 END) AS n_index FROM adm_extract GROUP BY 1""")
def group_summary(s: Study):
    return cohort.group_summary(s.extract)


@query("count_reconciliation", "group:s actual:l expected:l status:s", "AGG12 SMP1",
       """WITH wanted AS (
              SELECT 'ptsd_pos' AS "group", count(*) AS n FROM positives UNION ALL SELECT 'proxy', count(*) FROM proxies
              UNION ALL SELECT 'unlabeled', sum(least(needed, available)) FROM (
                  SELECT d.needed, count(c.subject_id) AS available FROM demand d LEFT JOIN candidates c ON c.decade = d.decade AND c.gender = d.gender
                  GROUP BY d.decade, d.gender, d.needed))
          SELECT g."group", actual, n AS expected, CASE WHEN actual = n THEN 'OK' ELSE 'MISMATCH' END AS status
          FROM (SELECT "group", count(*) AS actual FROM members GROUP BY 1) g JOIN wanted e ON g."group" = e."group" """)
def count_reconciliation(s: Study):
    """Group sizes against what the code sets and the matching demand let expect."""
    actual = s.members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    size = F.count(F.lit(1)).alias("n")
    taken = sampling.match_shortfall(s.cases, s.candidates, 3).agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("n"))
    parts = ((cohort.POSITIVE, s.positives.agg(size)), (cohort.PROXY, s.proxies.agg(size)), (cohort.UNLABELED, taken))
    expected = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("group"), "n")
        expected = part if expected is None else expected.unionByName(part)
    return cohort.reconcile_counts(actual, expected)


@query("category_values", "column_name:s value:s", "AGG13",
       "SELECT column_name, value FROM (" + " UNION ALL ".join(
           f"(SELECT '{c}' AS column_name, {c} AS value FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL) ORDER BY {c} {lim})"
           for c, t, lim in (("race", "aged", "LIMIT 20"), ("insurance", "aged", ""), ("admission_type", "aged", "LIMIT 10"), ("gender", "aged", ""))) + ")")
def category_values(s: Study):
    aged = cohort.with_age(s.admissions, s.patients)
    return cohort.value_profile(aged, {"race": 20, "insurance": None, "admission_type": 10, "gender": None})


# ── samples and splits ──────────────────────────────────────────────────────


@query("matched_sample", "subject_id:l", "SMP1", "SELECT * FROM unlabeled")
def matched_sample(s: Study):
    return s.unlabeled


@query("match_shortfall", "decade:s gender:s needed:l available:l taken:l shortfall:l", "AGG11 SMP1",
       """SELECT d.decade, d.gender, needed, coalesce(n, 0) AS available, least(needed, coalesce(n, 0)) AS taken,
                 needed - least(needed, coalesce(n, 0)) AS shortfall
          FROM demand d LEFT JOIN (SELECT decade, gender, count(*) AS n FROM candidates GROUP BY ALL) c
            ON d.decade = c.decade AND d.gender = c.gender""")
def match_shortfall(s: Study):
    return sampling.match_shortfall(s.cases, s.candidates, 3)


def _split_sql(source: str, shares: list[tuple[str, float]], rest: str) -> str:
    """Exact-rank split of ``source`` (subject_id, label)."""
    total, whens = 0.0, ""
    for name, share in shares:
        total = round(total + share, 9)
        whens += f" WHEN rn <= floor(n * {total}e0 + 1e-9) THEN '{name}'"
    return f"""SELECT subject_id, label, CASE {whens} ELSE '{rest}' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || subject_id), subject_id) AS rn,
               count(*) OVER (PARTITION BY label) AS n FROM {source})"""


# All subjects with a 0/1 target flag: the split then covers the whole table.
_FLAGGED = "(SELECT subject_id, CASE WHEN subject_id IN (SELECT subject_id FROM positives) THEN 1 ELSE 0 END AS label FROM patients)"
RANDOM_SPLIT = _split_sql(_FLAGGED, [("train", 0.8), ("val", 0.1)], "test")
_ERA = "coalesce(try_cast(split_part(anchor_year_group, ' - ', 1) AS INT), 9999)"
TEMPORAL_SPLIT = f"""{_split_sql(f"(SELECT f.* FROM {_FLAGGED} f JOIN patients p USING (subject_id) WHERE {_ERA} < 2015)", [("train", 0.9)], "val")}
    UNION ALL SELECT f.subject_id, f.label, 'test' FROM {_FLAGGED} f JOIN patients p USING (subject_id) WHERE {_ERA} >= 2015"""


def flagged_subjects(s: Study):
    marked = s.patients.select("subject_id").join(s.positives.withColumn("_p", F.lit(1)), "subject_id", "left")
    return marked.select("subject_id", F.coalesce("_p", F.lit(0)).alias("label"))


@query("stratified_split", "subject_id:l label:l split:s", "SMP2 WIN5", RANDOM_SPLIT)
def stratified_split(s: Study):
    return sampling.stratified_split(flagged_subjects(s))


@query("temporal_split", "subject_id:l label:l split:s", "SMP3", f"SELECT * FROM ({TEMPORAL_SPLIT})")
def temporal_split(s: Study):
    return sampling.temporal_split(flagged_subjects(s), s.patients)


@query("split_checks", "check_name:s violations:l", "SMP4",
       f"""WITH sp AS ({RANDOM_SPLIT})
           SELECT 'overlapping_keys' AS check_name, count(*) AS violations FROM (SELECT subject_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)
           UNION ALL SELECT 'missing_keys', count(*) FROM patients WHERE subject_id NOT IN (SELECT subject_id FROM sp)
           UNION ALL SELECT 'empty_splits', 3 - count(DISTINCT split) FROM sp""")
def split_checks(s: Study):
    labels = flagged_subjects(s)
    return sampling.split_checks(sampling.stratified_split(labels), labels, ["train", "val", "test"])


@query("split_summary", "split:s n_patients:l n_rows:l n_pos:l n_neg:l pos_pct:d", "AGG10 SMP2",
       f"""WITH sp AS ({RANDOM_SPLIT})
           SELECT split, count(DISTINCT a.subject_id) AS n_patients, count(*) AS n_rows, sum(label) AS n_pos,
                  count(*) - sum(label) AS n_neg, sum(label) / count(*)::DOUBLE * 100 AS pos_pct
           FROM admissions a JOIN sp ON a.subject_id = sp.subject_id GROUP BY split""")
def split_summary(s: Study):
    splits = sampling.stratified_split(flagged_subjects(s))
    rows = sampling.assign_rows(s.admissions, splits).join(flagged_subjects(s), "subject_id")
    return sampling.split_summary(rows)


@query("fixed_sample", "subject_id:l hadm_id:l", "SMP5 TOP4",
       """SELECT subject_id, hadm_id FROM (
              SELECT subject_id, min(hadm_id) AS hadm_id FROM admissions GROUP BY 1) ORDER BY md5('42|' || subject_id), subject_id LIMIT 500""")
def fixed_sample(s: Study):
    one = sampling.one_row_per_key(s.admissions, "subject_id", "hadm_id", ["hadm_id"])
    return sampling.fixed_sample(one, 500, ["subject_id"])


@query("key_labels", "subject_id:l first_type:s", "WIN5",
       "SELECT subject_id, arg_min(insurance, hadm_id) AS first_type FROM admissions GROUP BY 1")
def key_labels(s: Study):
    return sampling.key_labels(s.admissions, "subject_id", "insurance", "hadm_id").withColumnRenamed("insurance", "first_type")


# ── controls ────────────────────────────────────────────────────────────────

_CONTROL = sq.any_prefix("icd_code", codes.CONTROL_PREFIXES)
_CONTROLS_SQL = f"""SELECT DISTINCT subject_id FROM coded WHERE {_CONTROL}
    AND subject_id NOT IN (SELECT subject_id FROM members WHERE "group" IN ('ptsd_pos', 'proxy'))
    AND subject_id NOT IN (SELECT subject_id FROM coded WHERE starts_with(icd_code, 'F431') OR icd_code = '30981')"""
_CONTROL_POOL = f"""SELECT subject_id, hadm_id, gender, age_raw, {sq.age_bucket('age_raw')} AS decade FROM (
    SELECT *, anchor_age + admit_year - anchor_year AS age_raw, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn
    FROM aged WHERE subject_id IN ({_CONTROLS_SQL})) WHERE rn = 1"""
_MATCHED_CONTROLS = f"""SELECT subject_id, hadm_id, gender, age_raw AS age_at_admission, decade FROM (
    SELECT c.*, d.needed, row_number() OVER (PARTITION BY c.decade, c.gender ORDER BY md5('42|' || c.subject_id), c.subject_id) AS rn
    FROM ({_CONTROL_POOL}) c JOIN (
        SELECT {sq.age_bucket('age_at_admission')} AS decade, gender, count(*) AS needed FROM index_rows
        WHERE "group" = 'ptsd_pos' AND gender IS NOT NULL GROUP BY ALL) d ON c.decade = d.decade AND c.gender = d.gender) WHERE rn <= needed"""


def _control_parts(s: Study):
    subjects = controls.control_subjects(s.diagnoses, s.members)
    pool = materialise(controls.first_admission_pool(subjects, s.admissions, s.patients), "controls")
    return controls.matched_controls(s.extract, pool)


@query("matched_controls", "subject_id:l hadm_id:l gender:s age_at_admission:l decade:s", "ML9 SMP1 JN2 PRJ3 PRJ8", _MATCHED_CONTROLS)
def matched_controls(s: Study):
    return _control_parts(s)


@query("control_index_admissions", "subject_id:l hadm_id:l", "ML9 AGG1 WIN1",
       f"""SELECT subject_id, hadm_id FROM (
               SELECT c.subject_id, c.hadm_id, row_number() OVER (PARTITION BY c.subject_id ORDER BY a.admittime NULLS LAST, c.hadm_id) AS rn
               FROM (SELECT DISTINCT subject_id, hadm_id FROM coded WHERE {_CONTROL}) c
               JOIN ({_MATCHED_CONTROLS}) m ON c.subject_id = m.subject_id LEFT JOIN admissions a ON a.hadm_id = c.hadm_id) WHERE rn = 1""")
def control_index_admissions(s: Study):
    return controls.control_index(s.diagnoses, s.admissions, _control_parts(s))


_CONTROL_INDEX = f"""SELECT subject_id, hadm_id FROM (
        SELECT c.subject_id, c.hadm_id, row_number() OVER (PARTITION BY c.subject_id ORDER BY a.admittime NULLS LAST, c.hadm_id) AS rn
        FROM (SELECT DISTINCT subject_id, hadm_id FROM coded WHERE {_CONTROL}) c
        JOIN ({_MATCHED_CONTROLS}) m ON c.subject_id = m.subject_id LEFT JOIN admissions a ON a.hadm_id = c.hadm_id) WHERE rn = 1"""


def hard_control_rows(s: Study):
    """Positives' notes against the notes of matched controls at their control admission, split 80/10/10 by subject."""
    index = controls.control_index(s.diagnoses, s.admissions, _control_parts(s)).select("subject_id", "hadm_id")
    return materialise(controls.hard_control_corpus(s.corpus, index, s.discharge), "hard-controls")


@query("hard_control_corpus", "subject_id:l hadm_id:l label:l split:s n_chars:l", "ML9 SMP2 TXT1 SET4",
       f"""WITH noted AS (
               SELECT subject_id, hadm_id, 1 AS label, note_text FROM corpus WHERE label = 1
               UNION ALL SELECT i.subject_id, i.hadm_id, 0, j.note_text FROM ({_CONTROL_INDEX}) i JOIN all_joined j ON j.hadm_id = i.hadm_id),
           parts AS ({_split_sql("(SELECT subject_id, min(label) AS label FROM noted GROUP BY 1)", [("train", 0.8), ("val", 0.1)], "test")})
           SELECT n.subject_id, hadm_id, n.label, split, length(note_text) AS n_chars FROM noted n JOIN parts p ON p.subject_id = n.subject_id""")
def hard_control_corpus(s: Study):
    return hard_control_rows(s).withColumn("n_chars", F.length("note_text"))


# ── features and percentiles ────────────────────────────────────────────────

_FEATURE_SQL = f"""
    WITH ev AS (SELECT subject_id, hadm_id, CASE WHEN "group" = 'ptsd_pos' THEN 1 ELSE 0 END AS label FROM adm_extract WHERE is_index_admission AND "group" <> 'proxy'),
    ix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn
           FROM adm_extract WHERE hadm_id IN (SELECT hadm_id FROM ev)) WHERE rn = 1)
    SELECT i.subject_id, l.label, age_at_admission, CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS sex_female,
           (epoch_us(dischtime) - epoch_us(admittime)) / 86400e6 AS los_days,
           CASE WHEN upper(coalesce(admission_type, '')) LIKE '%EMER%' THEN 1 ELSE 0 END AS emergency_admission,
           CASE WHEN upper(insurance) IN ('MEDICAID', 'SELF PAY') THEN 1 ELSE 0 END AS medicaid_selfpay,
           f.n_prior_admissions, """ + ", ".join(
    f"CASE WHEN {sq.race('race', demographics.RACE_LABELS_SHORT)} = '{k}' THEN 1 ELSE 0 END AS \"race_{k}\""
    for k in sorted(demographics.RACE_LABELS_SHORT.values())
) + ", " + ", ".join(f'f."{x}"' for x in _FLAGS) + """
    FROM ix i JOIN (SELECT subject_id, arg_min(label, hadm_id) AS label FROM ev GROUP BY 1) l ON i.subject_id = l.subject_id
    JOIN prior_flags f ON i.subject_id = f.subject_id"""


def cohort_features(s: Study):
    """Feature table at the index admission; withheld proxy subjects have no label and no part in it."""
    evaluated = s.extract.where(F.col("is_index_admission") & (F.col("group") != cohort.PROXY)).select(
        "subject_id", "hadm_id", (F.col("group") == cohort.POSITIVE).cast("int").alias("label")
    )
    rows = features.structured_features(evaluated, s.extract, s.diagnoses, s.prescriptions)
    return materialise(rows, "features")


@query("structured_features", "subject_id:l label:l " + " ".join(f"{f}:d" for f in features.FEATURES),
       "ML1 JN6 JN15 JN16 AGG3 AGG5 PRJ14 WIN1", _FEATURE_SQL)
def structured_features(s: Study):
    return cohort_features(s)


@query("feature_medians", "feature:s median:d", "PRJ16",
       "SELECT feature, quantile_cont(v, 0.5) AS median FROM (UNPIVOT (SELECT "
       + ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in features.FEATURES)
       + f" FROM ({_FEATURE_SQL})) ON * INTO NAME feature VALUE v) GROUP BY feature")
def feature_medians(s: Study):
    return features.medians(cohort_features(s), features.FEATURES)


@query("imputed_features", "subject_id:l age_at_admission:d los_days:d", "PRJ16",
       f"""SELECT subject_id, coalesce(CASE WHEN subject_id % 3 <> 0 THEN age_at_admission END, (SELECT quantile_cont(age_at_admission::DOUBLE, 0.5) FROM ({_FEATURE_SQL}) WHERE subject_id % 3 <> 0)) AS age_at_admission,
                  los_days FROM ({_FEATURE_SQL})""")
def imputed_features(s: Study):
    # A third of the ages is blanked out so that there is something to fill.
    rows = cohort_features(s).withColumn("age_at_admission", F.when(F.col("subject_id") % 3 != 0, F.col("age_at_admission")))
    return features.impute(rows, rows, ["age_at_admission", "los_days"])


@query("order_value_percentiles", "insurance:s q1:d median:d q3:d", "AGG6 AGG8",
       """SELECT o_orderstatus AS insurance, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                 quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1""")
def order_value_percentiles(s: Study):
    orders = standins.table(s.spark, s.sf_dir, "orders").withColumnRenamed("o_orderstatus", "insurance")
    return prefix.percentiles(orders, ["insurance"], "o_totalprice", {"q1": 0.25, "median": 0.5, "q3": 0.75})
