"""Queries that write a stand-in through a sink and read it back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import errors, evaluation, sampling
from cohortlens.plans import standins
from cohortlens.plans.metric_queries import _CONF, rank_sql
from cohortlens.plans.registry import query
from cohortlens.plans.study import Study
from cohortlens.session import materialise, scratch_path
from cohortlens.sources import landing, readers, writers


def _path(s: Study, name: str) -> str:
    return scratch_path(s.spark, name)


@query("csv_admissions", "subject_id:l hadm_id:l admittime:t dischtime:t deathtime:t admission_type:s insurance:s race:s", "SRC1 SNK2",
       "SELECT *, NULL AS deathtime FROM admissions")
def csv_admissions(s: Study):
    path = _path(s, "admissions-csv")
    writers.write_csv(s.admissions, path)
    return readers.read_table(s.spark, "admissions", path)


@query("csv_patients_pruned", "gender:s anchor_age:l n:l", "SRC1 SRC2",
       "SELECT gender, anchor_age, count(*) AS n FROM patients GROUP BY ALL")
def csv_patients_pruned(s: Study):
    path = _path(s, "patients-csv")
    writers.write_csv(s.patients, path)
    rows = readers.read_table(s.spark, "patients", path, ["gender", "anchor_age"])
    return rows.groupBy("gender", "anchor_age").agg(F.count(F.lit(1)).alias("n"))


@query("csv_notes", "hadm_id:l text:s", "SRC3 JN1",
       "SELECT hadm_id, text FROM discharge WHERE hadm_id IN (SELECT hadm_id FROM admissions WHERE admission_type IS NOT NULL)")
def csv_notes(s: Study):
    path, target = _path(s, "notes-csv"), _path(s, "notes-landed")
    writers.write_csv(s.discharge, path)
    landing.land_notes(s.spark, path, target)
    return landing.landed_notes(s.spark, target, s.admissions.where("admission_type IS NOT NULL"))


@query("landed_notes", "run:l new_files:l n_notes:l n_chars:l", "SRC3",
       """SELECT run, CASE run WHEN 2 THEN 0 ELSE 3 END AS new_files, count(*) AS n_notes, sum(length(text)) AS n_chars
          FROM discharge CROSS JOIN (VALUES (1), (2), (3)) r(run) WHERE run = 3 OR hadm_id % 2 = 0 GROUP BY run""")
def landed_notes(s: Study):
    """Half of the notes is landed, nothing changes, the other half arrives: only new files are parsed."""
    path, target = _path(s, "notes-csv"), _path(s, "notes-landed")
    out = None
    for run, part in ((1, "hadm_id % 2 = 0"), (2, None), (3, "hadm_id % 2 <> 0")):
        if part:
            s.discharge.where(part).repartition(3).write.mode("append").options(header=True, quote='"', escape='"').csv(path)
        new = landing.land_notes(s.spark, path, target)
        notes = landing.landed_notes(s.spark, target).agg(F.count(F.lit(1)).alias("n_notes"), F.sum(F.length("text")).alias("n_chars"))
        # Stored at once: two readings of a folder that grew in between count as the same scan within one plan.
        row = materialise(notes.select(F.lit(run).alias("run"), F.lit(new).alias("new_files"), "n_notes", "n_chars"), "run")
        out = row if out is None else out.unionByName(row)
    return out


@query("parquet_stage_table", "subject_id:l hadm_id:l icd_version:s", "SRC4",
       "SELECT subject_id, hadm_id, icd_version FROM diagnoses")
def parquet_stage_table(s: Study):
    path = _path(s, "diagnoses")
    writers.write_table(s.diagnoses, path)
    return readers.read_parquet(s.spark, path, "subject_id", "hadm_id", "icd_version")


@query("id_list_round_trip", "subject_id:l", "SRC5 SNK1", "SELECT * FROM positives")
def id_list_round_trip(s: Study):
    path = _path(s, "ids")
    writers.write_ids(s.positives, path)
    return readers.read_ids(s.spark, path)


@query("malformed_rows", "reason:s n:l", "SRC6",
       """SELECT reason, count(*) AS n FROM (SELECT CASE hadm_id % 11 WHEN 0 THEN 'invalid starttime' WHEN 1 THEN 'too few fields' WHEN 2 THEN 'too many fields'
              WHEN 3 THEN 'blank subject_id' WHEN 4 THEN 'blank line' WHEN 5 THEN 'open quote' ELSE CASE WHEN starttime IS NULL THEN 'blank starttime' ELSE 'good' END END AS reason
              FROM prescriptions) GROUP BY reason""")
def malformed_rows(s: Study):
    """Short, long, blank and broken lines among the prescriptions; rejects are read from where they were written."""
    path = _path(s, "prescriptions-csv")
    rows, kind = s.prescriptions, F.col("hadm_id") % 11
    drug = F.when(F.col("drug").contains("HCl"), F.lit('"Prazosin, ""HCl"""')).otherwise(F.coalesce("drug", F.lit("")))
    subject = F.when(kind == 3, F.lit(" ")).otherwise(F.col("subject_id").cast("string"))
    start = F.when(kind == 0, "not a time").otherwise(F.coalesce(F.col("starttime").cast("string"), F.lit("")))
    line = F.concat_ws(",", subject, F.col("hadm_id").cast("string"), drug, start)
    line = (
        F.when(kind == 1, F.concat_ws(",", subject, F.col("hadm_id").cast("string"), drug)).when(kind == 2, F.concat(line, F.lit(",more")))
        .when(kind == 4, F.lit("  ")).when(kind == 5, F.concat(F.lit('"'), line)).otherwise(line)
    )
    rows.select(line.alias("value")).write.text(path)
    header = ["subject_id", "hadm_id", "drug", "starttime"]
    good, rejected = readers.split_rejects(s.spark, "prescriptions", path, ["subject_id", "starttime"], _path(s, "prescriptions"), header)
    return good.select(F.lit("good").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("json_thresholds", "model:s threshold:d", "SRC7 SNK3",
       "SELECT model, threshold FROM thresholds WHERE model IN ('len', 'hash') UNION ALL SELECT 'grid_fallback', threshold FROM thresholds WHERE model = 'grid'")
def json_thresholds(s: Study):
    path = _path(s, "thresholds-json")
    wide = s.thresholds.agg(
        *[F.max(F.when(F.col("model") == m, F.col("threshold"))).alias(m) for m in ("len", "hash", "grid")]
    )
    # One nested object, as a metrics file holds it.
    writers.write_nested(wide.coalesce(1), path, {"val_thresholds": ["len", "hash"], "old": ["grid"]})
    main = {"len": "val_thresholds.len", "hash": "val_thresholds.hash", "grid_fallback": "val_thresholds.grid"}
    return readers.read_thresholds(s.spark, f"{path}/*.json", main, {"grid_fallback": "old.grid"})


@query("nested_metrics_json", "model:s auprc:d sensitivity:d specificity:d", "SNK3 EV2",
       f"SELECT r.model, auprc, sensitivity, specificity FROM ({rank_sql('scores', 'model')}) r JOIN ({_CONF}) c ON r.model = c.model")
def nested_metrics_json(s: Study):
    path = _path(s, "metrics-json")
    metrics = evaluation.full_metrics(s.scores, s.thresholds)
    writers.write_nested(metrics, path, {"rank": ["auprc", "auroc"], "operating": ["sensitivity", "specificity", "precision", "f1"]})
    back = s.spark.read.json(path)
    return back.select("model", "rank.auprc", "operating.sensitivity", "operating.specificity")


@query("metric_csv", "model:s n:l auprc:d", "SNK2", f"SELECT model, n, auprc FROM ({rank_sql('scores', 'model')})")
def metric_csv(s: Study):
    path = _path(s, "metrics-csv")
    writers.write_csv(evaluation.rank_metrics(s.scores), path)
    return readers.raw_csv(s.spark, path)


@query("record_dump", "model:s error_side:s n_records:l n_note_chars:l", "SNK4 SMP5 TOP4",
       """SELECT model, error_side, count(*) AS n_records, sum(length(x.text)) AS n_note_chars FROM (
              SELECT *, row_number() OVER (PARTITION BY model, error_side ORDER BY md5('42|' || subject_id || '|' || hadm_id), subject_id, hadm_id) AS rn
              FROM (SELECT *, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_side FROM decided WHERE predicted <> label)) s
          JOIN documents x ON x.doc_id = s.hadm_id WHERE rn <= 25 GROUP BY model, error_side""")
def record_dump(s: Study):
    """Both error sides of every model: 25 annotated notes each, one folder per model and side."""
    path = _path(s, "records")
    docs = standins.table(s.spark, s.sf_dir, "documents").select(F.col("doc_id").alias("hadm_id"), F.col("text").alias("note_text"))
    wrong = s.decided_demo.where("predicted <> label").withColumn("error_side", F.when(F.col("label") == 1, "FN").otherwise("FP"))
    sides = ["model", "error_side"]
    sample = sampling.sample_per_group(wrong, sides, 25, ["subject_id", "hadm_id"]).join(docs, "hadm_id")
    writers.write_records(errors.formatted_records(sample, sides), path, sides)
    text = s.spark.read.text(path, wholetext=True)
    size = F.regexp_extract_all("value", F.lit(r"(?m)^  note_length:\s+(\d+) chars$"), 1)
    each = text.select(*sides, F.explode(size).alias("n"))
    return each.groupBy(*sides).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("n").cast("long")).alias("n_note_chars"))


@query("split_manifest", "split:s n:l", "SNK3 SMP2",
       """SELECT split, count(*) AS n FROM (SELECT CASE WHEN rn <= floor(n * 0.8e0 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.9e0 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (
              SELECT row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)) GROUP BY split""")
def split_manifest(s: Study):
    path = _path(s, "manifest")
    labels = standins.table(s.spark, s.sf_dir, "labels").select(F.col("doc_id").alias("subject_id"), F.col("quality").alias("label"))
    writers.write_split_manifest(sampling.stratified_split(labels), path, "random")
    return s.spark.read.json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("reused_predictions", "model:s n:l mean_score:d", "SNK6", "SELECT model, count(*) AS n, avg(score) AS mean_score FROM scores GROUP BY model")
def reused_predictions(s: Study):
    path = writers.stored_path(_path(s, "predictions"), "lexicon", s.sf_dir)

    def compute():
        return standins.scores(s.spark, s.sf_dir)

    writers.reuse_or_compute(s.spark, path, compute)
    stored = writers.reuse_or_compute(s.spark, path, compute)
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("labelled_concatenation", "source:s n:l n_chars:l n_texts:l", "SET4",
       """SELECT source, count(*) AS n, sum(length(text)) AS n_chars, count(DISTINCT md5(text)) AS n_texts FROM (
              SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY source""")
def labelled_concatenation(s: Study):
    docs = standins.table(s.spark, s.sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    talk = standins.table(s.spark, s.sf_dir, "conversations").select(F.lit("conversations").alias("source"), "text")
    # Different texts per source by two aggregations: no source is gathered in one task.
    texts = docs.unionByName(talk).groupBy("source", F.md5("text").alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )
    return texts.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"), F.count("digest").alias("n_texts")
    )
