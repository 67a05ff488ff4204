"""Queries on linear models: selection, propensity, PU risk, calibration, text, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import calibration, descent, errors, evaluation, features, models, newton, sampling
from cohortlens.plans import sql as sq
from cohortlens.plans import standins
from cohortlens.plans.cohort_queries import _FEATURE_SQL, _split_sql, cohort_features, hard_control_rows
from cohortlens.plans.metric_queries import rank_sql
from cohortlens.plans.registry import query
from cohortlens.plans.study import Study
from cohortlens.plans.text_queries import TFIDF_SQL
from cohortlens.session import materialise, scratch_path

_COLUMNS = features.FEATURES
_BALANCED = "CASE WHEN label = 1 THEN 0.5e0 / avg(label) OVER () ELSE 0.5e0 / (1 - avg(label) OVER ()) END"
_SPLIT = _split_sql("(SELECT subject_id, label FROM feats)", [("train", 0.8), ("val", 0.1)], "test")
_FILLED = ", ".join(
    f"""coalesce(CAST("{c}" AS DOUBLE), (SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.5) FROM parts WHERE split = 'train'), 0e0)""" for c in _COLUMNS
)


def _fit_sql(grid: list[float], rest: str) -> str:
    """``rest`` over ``filled`` (subject_id, label, split, x) and ``fitted`` (c, beta)."""
    rows = f"SELECT '' AS k, label AS y, {_BALANCED} AS w, x FROM filled WHERE split = 'train'"
    return f"""WITH feats AS ({_FEATURE_SQL}), parts AS (SELECT f.*, s.split FROM feats f JOIN ({_SPLIT}) s USING (subject_id)),
        filled AS MATERIALIZED (SELECT subject_id, label, split, [{_FILLED}, 1e0] AS x FROM parts),
        fitted AS MATERIALIZED ({sq.newton(rows, grid, len(_COLUMNS) + 1)})
        {rest}"""


def _split_features(s: Study):
    """Imputed features of the cohort with their split; stored once, as every step of a fit reads them."""
    rows = cohort_features(s)
    parted = rows.join(sampling.stratified_split(rows).select("subject_id", "split"), "subject_id")
    return materialise(features.impute(parted, parted.where("split = 'train'"), _COLUMNS), "imputed")


def _balanced_fit(s: Study, c: float):
    rows = _split_features(s)
    (model,) = newton.fit_logistic(models.balanced(rows.where("split = 'train'")), _COLUMNS, [c], weight="weight")
    return model, rows


@query("logistic_c_sweep", "c:d n:l n_pos:l auprc:d auroc:d", "ML2 ML5 EV36",
       _fit_sql(models.C_GRID, f""", scored AS (SELECT c, label, list_dot_product(x, beta) AS score FROM filled CROSS JOIN fitted WHERE split = 'val')
           {rank_sql('scored', 'c')}"""))
def logistic_c_sweep(s: Study):
    rows = _split_features(s)
    _, results = models.sweep_c(rows.where("split = 'train'"), rows.where("split = 'val'"), _COLUMNS)
    return results


@query("stored_model_scores", "model:s n:l n_pos:l auprc:d auroc:d", "ML5 ML2",
       _fit_sql([1.0], f""", scored AS (SELECT split AS model, label, list_dot_product(x, beta) AS score FROM filled CROSS JOIN fitted)
           {rank_sql('scored', 'model')}"""))
def stored_model_scores(s: Study):
    """A model is fitted, stored as a table, loaded and scores every split."""
    model, rows = _balanced_fit(s, 1.0)
    path = scratch_path(s.spark, "model")
    newton.save_models(s.spark, [model], path)
    (loaded,) = newton.load_models(s.spark, path)
    scored = models.score(loaded, rows).select(F.col("split").alias("model"), "label", F.col("logit").alias("score"))
    return evaluation.rank_metrics(scored)


_COEFFICIENTS = f"SELECT unnest({_COLUMNS!r}) AS feature, unnest(beta[1:{len(_COLUMNS)}]) AS coefficient FROM fitted"


@query("coefficient_ranking", "feature:s coefficient:d place:l", "EV37 ML2",
       _fit_sql([10.0], f"SELECT *, row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS place FROM ({_COEFFICIENTS})"))
def coefficient_ranking(s: Study):
    model, _ = _balanced_fit(s, 10.0)
    return evaluation.coefficient_ranking(newton.coefficient_table(s.spark, [model], intercept=False))


_FLAGS = [c for c in features.PROPENSITY_FEATURES if c.startswith(("dx_", "rx_"))]
_PROPENSITY = f"""WITH feats AS ({_FEATURE_SQL}),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM adm_extract) WHERE rn = 1),
    inputs AS MATERIALIZED (
        SELECT f.subject_id, f.label AS y, 1e0 AS w, '' AS k,
               [CASE WHEN gender = 'F' THEN 1e0 ELSE 0e0 END, coalesce(a.age_at_admission, 40)::DOUBLE,
                CASE WHEN upper(coalesce(admission_type, '')) LIKE '%EMER%' THEN 1e0 ELSE 0e0 END,
                CASE WHEN upper(insurance) IN ('MEDICAID', 'SELF PAY') THEN 1e0 ELSE 0e0 END, f.n_prior_admissions::DOUBLE,
                {', '.join(f'f."{c}"::DOUBLE' for c in _FLAGS)}, greatest(f."dx_MDD", f."dx_anxiety", f."dx_suicidal")::DOUBLE, 1e0] AS x
        FROM feats f LEFT JOIN firsts a ON a.subject_id = f.subject_id),
    fitted AS MATERIALIZED ({sq.newton("SELECT k, y, w, x FROM inputs", [1.0], len(features.PROPENSITY_FEATURES) + 1)})
    SELECT m.subject_id, coalesce(p.e, 0.5e0) AS propensity FROM members m LEFT JOIN (
        SELECT subject_id, least(greatest(1e0 / (1e0 + exp(-list_dot_product(x, beta))), 0.05e0), 0.95e0) AS e FROM inputs CROSS JOIN fitted) p
      ON p.subject_id = m.subject_id"""


def _propensities(s: Study):
    inputs = materialise(features.propensity_inputs(cohort_features(s), s.extract), "propensity-inputs")
    return models.propensities(inputs, features.PROPENSITY_FEATURES)


@query("subject_propensities", "subject_id:l propensity:d", "ML3 PRJ16 PRJ17", _PROPENSITY)
def subject_propensities(s: Study):
    return models.attach_propensity(s.members.select("subject_id"), _propensities(s))


def _risks(scored, prior: float, name: str):
    return evaluation.pu_risk(scored.withColumn("model", F.lit(name)), F.lit(prior), "propensity")


@query("pu_classifier", "model:s positive_risk:d unlabeled_risk:d pu_risk:d", "ML4 ML5 EV33")
def pu_classifier(s: Study):
    """The non-negative risk is minimised on the training rows and reported on the others."""
    rows = _split_features(s)
    rows = models.attach_propensity(features.standardise(rows, rows.where("split = 'train'"), _COLUMNS), _propensities(s))
    rows = rows.withColumnRenamed("label", "l").withColumn("label", F.col("l"))
    dense = materialise(descent.dense_rows(rows, _COLUMNS, weight=1.0 / F.col("propensity"), carried=("split", "propensity")), "dense")
    train = dense.where("split = 'train'")
    prior = float(train.agg(F.avg("y")).first()[0])
    fitted = descent.fit_pu(train, len(_COLUMNS), prior)
    held = descent.with_logit(dense.where("split <> 'train'"), fitted).withColumn("label", F.col("y").cast("int"))
    return _risks(held, prior, "pu_linear")


def _text_rows(s: Study):
    """Sparse vectors of the corpus notes with label, split and propensity of the subject."""
    notes = materialise(s.corpus.select("subject_id", "hadm_id", "label", "note_text"), "corpus")
    vectors, words = models.text_vectors(notes, "hadm_id", "note_text")
    labels = sampling.key_labels(notes, "subject_id", "label", "hadm_id")
    rows = sampling.assign_rows(notes.select("subject_id", "hadm_id", "label"), sampling.stratified_split(labels))
    return notes, rows.join(vectors, "hadm_id"), words


@query("text_classifier", "model:s n:l n_pos:l auprc:d auroc:d", "ML2 TXT16 ML5")
def text_classifier(s: Study):
    """Term weights into a balanced linear model; one row per held-out split."""
    _, rows, words = _text_rows(s)
    return _text_fit(rows, words)


def _text_fit(rows, words):
    train = models.balanced(rows.where("split = 'train'"))
    train = materialise(train.select(F.col("label").cast("double").alias("y"), F.col("weight").alias("w"), "idx", "val"), "train")
    fitted = descent.fit_sparse_logistic(train, words.count())
    scored = descent.with_logit(rows.where("split <> 'train'").select("label", F.col("split").alias("model"), "idx", "val"), fitted, "score")
    return evaluation.rank_metrics(scored)


@query("pu_text_classifier", "model:s positive_risk:d unlabeled_risk:d pu_risk:d", "ML4 EV33 TXT16")
def pu_text_classifier(s: Study):
    _, rows, words = _text_rows(s)
    rows = models.attach_propensity(rows, _propensities(s))
    rows = materialise(
        rows.select("split", "propensity", F.col("label").cast("double").alias("y"), (1.0 / F.col("propensity")).alias("w"), "idx", "val"), "text-rows"
    )
    train = rows.where("split = 'train'")
    prior = float(train.agg(F.avg("y")).first()[0])
    fitted = descent.fit_pu(train, words.count(), prior)
    held = descent.with_logit(rows.where("split <> 'train'"), fitted).withColumn("label", F.col("y").cast("int"))
    return _risks(held, prior, "pu_text")


@query("text_term_attributions", "term:s n:l mean_attribution:d total_attribution:d", "ML13 TXT16 ML12",
       f"""{TFIDF_SQL}, coefs AS (SELECT term, {sq.uniform("'coefficient'", 'term')} - 0.5e0 AS coefficient FROM vocab)
           SELECT term, count(*) AS n, avg(abs(weight * coefficient)) AS mean_attribution, sum(weight * coefficient) AS total_attribution
           FROM unit JOIN coefs USING (term) GROUP BY term""")
def text_term_attributions(s: Study):
    """A declared coefficient per term, multiplied with every note's sparse vector."""
    notes = standins.documents(s.spark, s.sf_dir).select("doc_id", "text")
    vectors, words = models.text_vectors(notes, "doc_id", "text")
    table = words.select("term", (standins.md5_uniform("coefficient", F.col("term")) - 0.5).alias("coefficient"))
    values = models.vector_attribution(vectors, "doc_id", words, table)
    return values.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("value")).alias("mean_attribution"), F.sum("value").alias("total_attribution")
    )


@query("platt_scaling", "model:s hadm_id:l score:d calibrated:d", "ML6", "SELECT model, hadm_id, score, calibrated FROM platt_scores")
def platt_scaling(s: Study):
    return calibration.apply_platt(s.platt, s.scores)


_KINDS = "(VALUES ('raw'), ('platt_scaled'), ('elkan_noto')) t(kind)"


@query("calibration_comparison", "model:s kind:s ece:d", "ML6 ML7 EV12 EV13",
       f"""WITH all_kinds AS (
               SELECT p.model, kind, label, CASE kind WHEN 'raw' THEN score WHEN 'platt_scaled' THEN calibrated ELSE least(greatest(calibrated / c, 0), 1) END AS score
               FROM platt_scores p JOIN (SELECT model, avg(score) AS c FROM scores WHERE split = 'val' AND label = 1 GROUP BY model) v ON v.model = p.model
               CROSS JOIN {_KINDS}),
           binned AS (
               SELECT model, kind, least((rn - 1) // (total // 10), 9) AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed
               FROM (SELECT *, row_number() OVER (PARTITION BY model, kind ORDER BY score, label) AS rn, count(*) OVER (PARTITION BY model, kind) AS total FROM all_kinds)
               GROUP BY ALL)
           SELECT model, kind, sum(n * abs(mean_predicted - observed)) / sum(n) AS ece FROM binned GROUP BY model, kind""")
def calibration_comparison(s: Study):
    c = calibration.labelled_probability(s.scores.where("split = 'val'"))
    corrected = calibration.elkan_noto(calibration.apply_platt(s.platt, s.scores), c)
    kinds = F.array(
        *[F.struct(F.lit(n).alias("kind"), F.col(v).alias("score")) for n, v in
          (("raw", "score"), ("platt_scaled", "calibrated"), ("elkan_noto", "corrected"))]
    )
    keys = ["model", "kind"]
    long = corrected.select("model", "label", F.explode(kinds).alias("k")).select("model", "k.kind", "label", "k.score")
    return calibration.expected_calibration_error(calibration.equal_frequency_bins(long, keys), keys, digits=None)


@query("linear_attribution", "feature:s mean_attribution:d total_attribution:d", "ML13",
       _fit_sql([10.0], f"""SELECT feature, avg(abs(coefficient * v)) AS mean_attribution, sum(coefficient * v) AS total_attribution
           FROM (SELECT unnest({_COLUMNS!r}) AS feature, unnest(x[1:{len(_COLUMNS)}]) AS v FROM filled WHERE split <> 'train') JOIN ({_COEFFICIENTS}) USING (feature)
           GROUP BY feature"""))
def linear_attribution(s: Study):
    model, rows = _balanced_fit(s, 10.0)
    table = newton.coefficient_table(s.spark, [model], intercept=False).select("feature", "coefficient")
    values = models.linear_attribution(rows.where("split <> 'train'"), table, _COLUMNS)
    return values.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_attribution"), F.sum("value").alias("total_attribution")
    )


@query("control_classifier", "model:s n:l n_pos:l auprc:d auroc:d", "ML9 AGG15 TXT16")
def control_classifier(s: Study):
    """Term weights of positives against matched controls, balanced linear model; one row per held-out split."""
    rows = hard_control_rows(s)
    vectors, words = models.text_vectors(rows, "hadm_id", "note_text")
    return _text_fit(rows.join(vectors, "hadm_id"), words)


@query("scored_error_groups", "error_group:s n:l mean_score:d", "ML5 EV28",
       _fit_sql([1.0], f""", cells AS (
               SELECT score, CASE WHEN z >= 0 AND label = 0 THEN 'FP' WHEN z < 0 AND label = 1 THEN 'FN' END AS cell
               FROM (SELECT label, list_dot_product(x, beta) AS z, 1e0 / (1e0 + exp(-list_dot_product(x, beta))) AS score FROM filled CROSS JOIN fitted WHERE split <> 'train'))
           SELECT '{errors.OVERALL}' AS error_group, count(*) AS n, avg(score) AS mean_score FROM cells
           UNION ALL SELECT CASE cell WHEN 'FP' THEN '{errors.FALSE_POSITIVE}' ELSE '{errors.FALSE_NEGATIVE}' END, count(*), avg(score) FROM cells WHERE cell IS NOT NULL GROUP BY cell"""))
def scored_error_groups(s: Study):
    model, rows = _balanced_fit(s, 1.0)
    scored = models.score(model, rows.where("split <> 'train'")).withColumn("predicted", (F.col("logit") >= 0).cast("int"))
    return errors.by_error_group(scored).groupBy("error_group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")
    )
