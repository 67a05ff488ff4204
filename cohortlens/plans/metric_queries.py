"""Queries on classifier evaluation, calibration, decisions, comparison and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import demographics, stats
from cohortlens.functions import text as tx
from cohortlens.operators import (
    calibration,
    compare,
    controls,
    corpus,
    decision,
    errors,
    evaluation,
    fairness,
    models,
    sampling,
)
from cohortlens.operators.attribution import top_decile
from cohortlens.operators.prefix import join_parameters
from cohortlens.plans import sql as sq
from cohortlens.plans import standins
from cohortlens.plans.cohort_queries import RANDOM_SPLIT, TEMPORAL_SPLIT, flagged_subjects
from cohortlens.plans.registry import query
from cohortlens.plans.standins import MODELS
from cohortlens.plans.study import Study
from cohortlens.session import materialise
from cohortlens.sources.writers import review_form


def rank_sql(source: str, keys: str) -> str:
    """Average precision and AUROC by plain windows over the sorted scores."""
    part = f"PARTITION BY {keys}"
    return f"""SELECT {keys}, sum(pos + neg) AS n, sum(pos) AS n_pos,
               CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos / p * tp / (tp + fp)) END AS auprc,
               CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)) END AS auroc
        FROM (SELECT {keys}, score, pos, neg, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
                     nullif(sum(pos) OVER ({part}), 0)::DOUBLE AS p, sum(neg) OVER ({part})::DOUBLE AS n
              FROM (SELECT {keys}, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {source} GROUP BY {keys}, score))
        GROUP BY {keys}"""


def confusion_sql(source: str, keys: str) -> str:
    return f"""SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
               coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
               (tp + fp) / nullif(tp + fp + tn + fn, 0) AS alert_rate
        FROM (SELECT {keys}, count(*) FILTER (WHERE predicted = 1 AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE predicted = 1 AND label = 0)::DOUBLE AS fp,
                     count(*) FILTER (WHERE predicted = 0 AND label = 0)::DOUBLE AS tn, count(*) FILTER (WHERE predicted = 0 AND label = 1)::DOUBLE AS fn
              FROM {source} GROUP BY {keys})"""


_RANK = rank_sql("scores", "model")
_CONF = confusion_sql("decided", "model")


@query("score_histogram", "model:s score:d pos:l neg:l", "WIN4 EV3",
       "SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL")
def score_histogram(s: Study):
    return evaluation.histogram(s.scores)


@query("running_score_counts", "model:s score:d tp:l fp:l", "WIN4",
       """SELECT model, score, sum(sum(label)) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
                 sum(sum(1 - label)) OVER (PARTITION BY model ORDER BY score DESC) AS fp FROM scores GROUP BY model, score""")
def running_score_counts(s: Study):
    h = evaluation.ranked_histogram(s.scores)
    return h.select("model", "score", (F.col("pos_total") - F.col("pos_below")).alias("tp"), (F.col("neg_total") - F.col("neg_below")).alias("fp"))


@query("rank_metrics", "model:s n:l n_pos:l auprc:d auroc:d", "EV3 EV4", _RANK)
def rank_metrics(s: Study):
    return evaluation.rank_metrics(s.scores)


@query("confusion_counts", "model:s tp:l fp:l tn:l fn:l", "EV1 PRJ20", f"SELECT model, tp, fp, tn, fn FROM ({_CONF})")
def confusion_counts(s: Study):
    return evaluation.confusion(s.decided)


@query("operating_metrics", "model:s tp:l fp:l tn:l fn:l sensitivity:d specificity:d precision:d f1:d alert_rate:d", "EV1 EV2", _CONF)
def operating_metrics(s: Study):
    return evaluation.operating_metrics(s.decided)


@query("outcome_cells", "model:s outcome:s n:l", "PRJ20",
       """SELECT model, CASE WHEN predicted = 1 AND label = 1 THEN 'TP' WHEN predicted = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome,
                 count(*) AS n FROM decided GROUP BY ALL""")
def outcome_cells(s: Study):
    return errors.with_outcome(s.decided).groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n"))


_GRID = "SELECT i, CASE WHEN i = 1000 THEN 0e0 ELSE 1e0 + i * -0.001e0 END AS t FROM range(0, 1001) r(i)"


@query("grid_thresholds", "model:s threshold:d", "EV5",
       f"""SELECT m.model, coalesce(max(g.t) FILTER (WHERE g.recall >= 0.85e0), 0) AS threshold FROM (SELECT DISTINCT model FROM scores) m LEFT JOIN (
               SELECT s.model, g.t, count(*) FILTER (WHERE s.score >= g.t AND s.label = 1) / nullif(sum(s.label), 0)::DOUBLE AS recall
               FROM scores s CROSS JOIN ({_GRID}) g GROUP BY ALL) g ON g.model = m.model GROUP BY m.model""")
def grid_thresholds(s: Study):
    return evaluation.threshold_on_grid(s.scores)


@query("score_thresholds", "model:s threshold:d", "EV6", "SELECT * FROM thresholds")
def score_thresholds(s: Study):
    return s.thresholds


@query("precision_at_recall", "model:s precision_at_recall:d", "EV7",
       """SELECT model, coalesce(max(tp / (tp + fp)) FILTER (WHERE tp / p >= 0.85e0), 0) AS precision_at_recall FROM (
              SELECT model, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp, sum(sum(label)) OVER (PARTITION BY model)::DOUBLE AS p
              FROM scores GROUP BY model, score WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model""")
def precision_at_recall(s: Study):
    return evaluation.precision_at_recall(s.scores)


_LR = """CASE WHEN specificity < 1 THEN sensitivity / (1 - specificity) ELSE 'inf'::DOUBLE END AS lr_positive,
    CASE WHEN specificity > 0 THEN (1 - sensitivity) / specificity ELSE 'inf'::DOUBLE END AS lr_negative"""


@query("clinical_utility", "model:s lr_positive:d lr_negative:d diagnostic_odds_ratio:d workup_reduction:d", "EV8",
       f"""SELECT *, CASE WHEN lr_negative > 0 AND lr_negative <> 'inf'::DOUBLE THEN lr_positive / lr_negative ELSE 'inf'::DOUBLE END AS diagnostic_odds_ratio,
                  1 - alert_rate AS workup_reduction FROM (SELECT *, {_LR} FROM ({_CONF}))""")
def clinical_utility(s: Study):
    return evaluation.clinical_utility(evaluation.operating_metrics(s.decided))


@query("clinical_utility_shifted", "model:s lr_positive:d lr_negative:d diagnostic_odds_ratio:d", "EV8",
       f"""SELECT model, sensitivity / (1 - specificity + 1e-9) AS lr_positive, (1 - sensitivity) / (specificity + 1e-9) AS lr_negative,
                  (sensitivity / (1 - sensitivity + 1e-9)) / ((1 - specificity + 1e-9) / (specificity + 1e-9)) AS diagnostic_odds_ratio FROM ({_CONF})""")
def clinical_utility_shifted(s: Study):
    return evaluation.clinical_utility(evaluation.operating_metrics(s.decided), eps=True)


@query("prevalence_recalibration", "model:s prevalence:d ppv:d npv:d nns:d nne:d", "EV9",
       f"""SELECT model, prevalence, ppv, npv, CASE WHEN ppv > 0 THEN 1 / ppv ELSE 'inf'::DOUBLE END AS nns,
                  CASE WHEN sensitivity - (1 - specificity) > 0 THEN 1 / (sensitivity - (1 - specificity)) ELSE 'inf'::DOUBLE END AS nne FROM (
              SELECT *, sensitivity * prevalence / nullif(sensitivity * prevalence + (1 - specificity) * (1 - prevalence), 0) AS ppv,
                     coalesce(specificity * (1 - prevalence) / nullif(specificity * (1 - prevalence) + (1 - sensitivity) * prevalence, 0), 0) AS npv
              FROM ({_CONF}) CROSS JOIN (VALUES (0.01e0), (0.02e0), (0.05e0), (0.1e0), (0.2e0)) p(prevalence))""")
def prevalence_recalibration(s: Study):
    return evaluation.at_prevalences(evaluation.operating_metrics(s.decided))


@query("prevalence_shifted_scores", "hadm_id:l model:s shifted:d", "PRJ21",
       """SELECT hadm_id, model, score * 0.02e0 / ps / (score * 0.02e0 / ps + (1 - score) * 0.98e0 / (1 - ps)) AS shifted
          FROM (SELECT *, avg(label) OVER (PARTITION BY model) AS ps FROM probabilities)""")
def prevalence_shifted_scores(s: Study):
    probabilities = s.probabilities
    study = probabilities.groupBy("model").agg(F.avg("label").alias("_ps"))
    rows = join_parameters(probabilities, study, ["model"])
    return rows.select("hadm_id", "model", stats.prevalence_shift(F.col("score"), F.col("_ps"), F.lit(0.02)).alias("shifted"))


@query("pu_corrected_metrics",
       "model:s auprc_pu:d auprc_pu_clipped:l auroc_pu:d sensitivity_pu:d specificity_pu:d precision_pu:d", "EV10",
       f"""SELECT r.model, least(auprc / a, 1) AS auprc_pu, CASE WHEN auprc / a > 1 THEN 1 ELSE 0 END AS auprc_pu_clipped,
                  least(greatest((auroc - 0.5e0 * a) / (1 - a), 0.5e0), 1) AS auroc_pu, sensitivity AS sensitivity_pu,
                  least(greatest(1 - greatest(0, (1 - specificity) - a * sensitivity) / (1 - a), 0), 1) AS specificity_pu,
                  least(CASE WHEN precision > 0 THEN precision / (precision + (1 - precision) * (1 - a)) ELSE 0 END, 1) AS precision_pu
           FROM ({_RANK}) r JOIN ({_CONF}) c ON r.model = c.model CROSS JOIN (SELECT 0.196e0 AS a)""")
def pu_corrected_metrics(s: Study):
    metrics = evaluation.full_metrics(s.scores, s.thresholds)
    return evaluation.pu_metrics(metrics, F.lit(0.196))


# ── calibration ─────────────────────────────────────────────────────────────


@query("equal_width_bins", "model:s bin:l bin_label:s n:l mean_predicted:d observed_rate:d", "EV11",
       """SELECT m.model, b.i AS bin, printf('%.1f-%.1f', b.i / 10e0, b.i / 10e0 + 0.1e0) AS bin_label, count(s.score) AS n,
                 avg(s.score) AS mean_predicted, avg(s.label) AS observed_rate
          FROM (SELECT DISTINCT model FROM scores) m CROSS JOIN (SELECT i FROM range(0, 10) r(i)) b
          LEFT JOIN scores s ON s.model = m.model AND s.score >= b.i * 0.1e0
               AND (s.score < (b.i + 1) * 0.1e0 OR (b.i = 9 AND s.score <= 1)) AND s.score <= 1
          GROUP BY ALL""")
def equal_width_bins(s: Study):
    return calibration.equal_width_bins(s.scores)


_FREQ = """SELECT model, bin, n, mean_predicted, observed_fraction,
        greatest((observed_fraction + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) - 1.96e0 * sqrt((observed_fraction * (1 - observed_fraction) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n), 0) AS ci_lower,
        least((observed_fraction + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) + 1.96e0 * sqrt((observed_fraction * (1 - observed_fraction) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n), 1) AS ci_upper
    FROM (SELECT model, least((rn - 1) // (total // 10), 9) + 1 AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed_fraction
          FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, label) AS rn, count(*) OVER (PARTITION BY model) AS total FROM scores)
          GROUP BY ALL)"""


@query("equal_frequency_bins", "model:s bin:l n:l mean_predicted:d observed_fraction:d ci_lower:d ci_upper:d", "EV12 EV14", _FREQ)
def equal_frequency_bins(s: Study):
    return calibration.equal_frequency_bins(s.scores)


@query("calibration_error", "model:s ece:d", "EV13",
       f"SELECT model, sum(n * abs(mean_predicted - observed_fraction)) / sum(n) AS ece FROM ({_FREQ}) GROUP BY model")
def calibration_error(s: Study):
    bins = calibration.equal_frequency_bins(s.scores)
    return calibration.expected_calibration_error(bins, digits=None)


@query("labelled_probability", "model:s c:d", "ML7",
       "SELECT model, avg(score) AS c FROM scores WHERE split = 'val' AND label = 1 GROUP BY model")
def labelled_probability(s: Study):
    return calibration.labelled_probability(s.scores.where("split = 'val'"))


@query("elkan_noto_corrected", "model:s hadm_id:l corrected:d", "ML7 PRJ17",
       """SELECT s.model, hadm_id, least(greatest(score / c, 0), 1) AS corrected FROM scores s
          JOIN (SELECT model, avg(score) AS c FROM scores WHERE split = 'val' AND label = 1 GROUP BY model) v ON s.model = v.model""")
def elkan_noto_corrected(s: Study):
    c = calibration.labelled_probability(s.scores.where("split = 'val'"))
    return calibration.elkan_noto(s.scores.withColumn("calibrated", F.col("score")), c)


# ── decision curves ─────────────────────────────────────────────────────────

_CURVE = """SELECT s.model, d.tag AS deployment, (100 + 50 * g.i) / 10000e0 AS threshold,
        (count(*) FILTER (WHERE s.q >= (100 + 50 * g.i) / 10000e0 AND label = 1) - count(*) FILTER (WHERE s.q >= (100 + 50 * g.i) / 10000e0 AND label = 0)
            * ((100 + 50 * g.i) / 10000e0 / (1 - (100 + 50 * g.i) / 10000e0))) / count(*) AS net_benefit_model,
        max(ps) - (1 - max(ps)) * ((100 + 50 * g.i) / 10000e0 / (1 - (100 + 50 * g.i) / 10000e0)) AS net_benefit_treatall
    FROM (VALUES ('2pct', 0.02e0), ('5pct', 0.05e0)) d(tag, p)
    JOIN (SELECT model, label, ps, tag, score * p / ps / (score * p / ps + (1 - score) * (1 - p) / (1 - ps)) AS q
          FROM (SELECT * REPLACE (1 - label AS label), avg(1 - label) OVER (PARTITION BY model) AS ps FROM probabilities)
          CROSS JOIN (VALUES ('2pct', 0.02e0), ('5pct', 0.05e0)) x(tag, p)) s ON s.tag = d.tag
    CROSS JOIN (SELECT i FROM range(0, 79) r(i)) g GROUP BY s.model, d.tag, g.i"""


def _curve(s: Study):
    # The rare class is the one to find.
    rows = s.probabilities.withColumn("label", 1 - F.col("label"))
    return decision.decision_curve(rows)


@query("decision_curves", "model:s deployment:s threshold:d net_benefit_model:d net_benefit_treatall:d", "EV15 PRJ21", _CURVE)
def decision_curves(s: Study):
    return _curve(s)


@query("decision_curves_wide", "model:s threshold:d net_benefit_model_2pct:d net_benefit_treatall_2pct:d net_benefit_model_5pct:d net_benefit_treatall_5pct:d",
       "EV15 JN12",
       "SELECT model, threshold, " + ", ".join(
           f"max({c}) FILTER (WHERE deployment = '{t}') AS {c}_{t}" for t in ("2pct", "5pct") for c in ("net_benefit_model", "net_benefit_treatall")
       ) + f" FROM ({_CURVE}) GROUP BY ALL")
def decision_curves_wide(s: Study):
    return decision.wide_curve(_curve(s))


@query("dominance_ranges", "model:s deployment:s range_start:d range_end:d", "EV16",
       f"""SELECT model, deployment, min(threshold) AS range_start, max(threshold) AS range_end FROM (
               SELECT *, i - row_number() OVER (PARTITION BY model, deployment ORDER BY i) AS island FROM (
                   SELECT *, row_number() OVER (PARTITION BY model, deployment ORDER BY threshold) AS i FROM ({_CURVE}))
               WHERE round(net_benefit_model, 6) > round(net_benefit_treatall, 6)) GROUP BY model, deployment, island""")
def dominance_ranges(s: Study):
    return decision.dominance_ranges(_curve(s))


@query("peak_net_benefit", "model:s deployment:s peak_net_benefit:d peak_threshold:d", "EV16",
       f"""SELECT model, deployment, round(net_benefit_model, 6) AS peak_net_benefit, threshold AS peak_threshold FROM (
               SELECT *, row_number() OVER (PARTITION BY model, deployment ORDER BY round(net_benefit_model, 6) DESC, threshold) AS rn FROM ({_CURVE})) WHERE rn = 1""")
def peak_net_benefit(s: Study):
    return decision.peak_benefit(_curve(s))


# ── model comparison ────────────────────────────────────────────────────────

_PAIRS = """SELECT a.model AS model_a, b.model AS model_b, count(*)::DOUBLE AS n,
        count(*) FILTER (WHERE a.predicted = a.label AND b.predicted <> b.label) AS b_only_a_correct,
        count(*) FILTER (WHERE a.predicted <> a.label AND b.predicted = b.label) AS c_only_b_correct,
        count(*) FILTER (WHERE a.predicted = b.predicted)::DOUBLE AS e, sum(a.predicted)::DOUBLE AS pa, sum(b.predicted)::DOUBLE AS pb,
        corr(a.score, b.score) AS r
    FROM decided a JOIN decided b ON a.subject_id = b.subject_id AND a.hadm_id = b.hadm_id
    JOIN (VALUES ('kw', 0), ('kw_norm', 1), ('len', 2), ('hash', 3), ('grid', 4)) x(model, i) ON a.model = x.model
    JOIN (VALUES ('kw', 0), ('kw_norm', 1), ('len', 2), ('hash', 3), ('grid', 4)) y(model, i) ON b.model = y.model
    WHERE x.i < y.i GROUP BY ALL"""


_TESTS = f"""SELECT *, coalesce(pow(abs(b_only_a_correct - c_only_b_correct) - 1, 2) / nullif(b_only_a_correct + c_only_b_correct, 0), 0) AS chi2 FROM ({_PAIRS})"""


@query("model_pair_tests", "model_a:s model_b:s b_only_a_correct:l c_only_b_correct:l chi2:d agreement_pct:d cohens_kappa:d pearson_r:d",
       "EV17 EV18 JN11",
       f"""SELECT *, coalesce(pow(abs(b_only_a_correct - c_only_b_correct) - 1, 2) / nullif(b_only_a_correct + c_only_b_correct, 0), 0) AS chi2, e / n * 100 AS agreement_pct,
                  CASE WHEN (pa * pb + (n - pa) * (n - pb)) / (n * n) <> 1 THEN (e / n - (pa * pb + (n - pa) * (n - pb)) / (n * n)) / (1 - (pa * pb + (n - pa) * (n - pb)) / (n * n)) END AS cohens_kappa,
                  CASE WHEN isnan(r) THEN NULL ELSE r END AS pearson_r FROM ({_PAIRS})""")
def model_pair_tests(s: Study):
    return compare.pair_tests(s.decided, MODELS, p_value=False)


@query("mcnemar_p_values", "model_a:s model_b:s chi2:d mcnemar_p:d log10_p:d", "EV17",
       f"""SELECT *, CASE WHEN mcnemar_p > 0 THEN log10(mcnemar_p) END AS log10_p FROM (
               SELECT *, CASE WHEN b_only_a_correct + c_only_b_correct > 0 THEN {sq.erfc('root')} ELSE 1e0 END AS mcnemar_p
               FROM (SELECT *, sqrt(chi2 / 2) AS root FROM ({_TESTS})))""")
def mcnemar_p_values(s: Study):
    return compare.pair_tests(s.decided, MODELS).withColumn("log10_p", F.when(F.col("mcnemar_p") > 0, F.log10("mcnemar_p")))


_TOP = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, md5('42|' || subject_id || '|' || hadm_id)) AS rn,
        greatest(count(*) OVER (PARTITION BY model) // 5, 1) AS k FROM scores) WHERE rn <= k"""


@query("top_quintile_rows", "model:s subject_id:l hadm_id:l top_size:l", "EV19",
       f"SELECT model, subject_id, hadm_id, k AS top_size FROM ({_TOP})")
def top_quintile_rows(s: Study):
    return compare.top_share(s.scores)


@query("top_quintile_overlap", "model_a:s model_b:s top_size:l overlap_fraction:d overlap_jaccard:d", "EV19 JN11",
       f"""WITH top AS ({_TOP}), m AS (SELECT * FROM (VALUES ('kw', 0), ('kw_norm', 1), ('len', 2), ('hash', 3), ('grid', 4)) v(model, i)),
           ks AS (SELECT model, count(*) AS k FROM top GROUP BY 1)
           SELECT x.model AS model_a, y.model AS model_b, ka.k AS top_size, n / ka.k::DOUBLE AS overlap_fraction, n / (ka.k + kb.k - n)::DOUBLE AS overlap_jaccard
           FROM m x JOIN m y ON x.i < y.i JOIN ks ka ON ka.model = x.model JOIN ks kb ON kb.model = y.model
           CROSS JOIN LATERAL (SELECT count(*) AS n FROM top a JOIN top b ON a.subject_id = b.subject_id AND a.hadm_id = b.hadm_id WHERE a.model = x.model AND b.model = y.model)""")
def top_quintile_overlap(s: Study):
    return compare.top_overlap(s.scores, MODELS)


_PCT = """SELECT model, subject_id, hadm_id, label, (rank() OVER (PARTITION BY model ORDER BY score)
        + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model)::DOUBLE AS rank_pct FROM scores"""


@query("rank_normalised_scores", "model:s hadm_id:l rank_pct:d", "WIN3", _PCT)
def rank_normalised_scores(s: Study):
    return compare.rank_normalised(s.scores)


_WIDE_PCT = "SELECT subject_id, hadm_id, max(label) AS label, " + ", ".join(
    f"max(rank_pct) FILTER (WHERE model = '{m}') AS p_{m}" for m in MODELS) + f" FROM ({_PCT}) GROUP BY ALL"
_P = [f"p_{m}" for m in MODELS]
_ENS = f"""SELECT model, subject_id, hadm_id, label, score FROM scores
    UNION ALL SELECT 'ensemble_max', subject_id, hadm_id, label, greatest({', '.join(_P)}) FROM ({_WIDE_PCT})
    UNION ALL SELECT 'ensemble_mean', subject_id, hadm_id, label, ({' + '.join(_P)}) / 5e0 FROM ({_WIDE_PCT})"""


@query("rank_ensembles", "model:s auprc:d auroc:d best_individual:d beats_best:l", "ML8 WIN3",
       f"""WITH r AS ({rank_sql(f'({_ENS})', 'model')}), b AS (SELECT max(auprc) AS best FROM r WHERE model NOT LIKE 'ensemble%')
           SELECT model, auprc, auroc, best AS best_individual, CASE WHEN model LIKE 'ensemble%' AND auprc > best THEN 1 ELSE 0 END AS beats_best FROM r CROSS JOIN b""")
def rank_ensembles(s: Study):
    columns = ["model", "subject_id", "hadm_id", "label", "score"]
    everything = s.scores.select(*columns).unionByName(compare.rank_ensembles(s.scores, MODELS).select(*columns))
    return compare.beats_best(evaluation.rank_metrics(everything))


@query("aligned_scores", "model:s subject_id:l hadm_id:l score:d", "JN8 PRJ16",
       """SELECT m.model, g.subject_id, g.hadm_id, coalesce(s.score, 0) AS score FROM (SELECT subject_id, hadm_id FROM admissions) g
          CROSS JOIN (SELECT DISTINCT model FROM scores) m
          LEFT JOIN scores s ON s.subject_id = g.subject_id AND s.hadm_id = g.hadm_id AND s.model = m.model""")
def aligned_scores(s: Study):
    grain = s.admissions.select("subject_id", "hadm_id")
    return compare.align_scores(grain, s.scores, MODELS)


@query("alignment_report", "model:s scored_rows:l duplicate_keys:l matched_keys:l stray_keys:l", "JN8",
       """SELECT model, count(*) AS scored_rows, count(*) - count(DISTINCT hadm_id) AS duplicate_keys,
                 count(*) FILTER (WHERE split = 'test') AS matched_keys, count(*) FILTER (WHERE split <> 'test') AS stray_keys FROM scores GROUP BY model""")
def alignment_report(s: Study):
    return compare.alignment_report(s.scores.where("split = 'test'").select("subject_id", "hadm_id").distinct(), s.scores)


_SUBJECT_SCORES = "SELECT subject_id, avg(score) AS score FROM scores WHERE model = 'hash' GROUP BY 1"


@query("subject_score_lookup", "n_rows:l n_scored:l complete:l", "JN9",
       f"""SELECT count(*) AS n_rows, count(x.score) AS n_scored, CASE WHEN bool_and(x.score IS NOT NULL) THEN 1 ELSE 0 END AS complete
           FROM patients p LEFT JOIN ({_SUBJECT_SCORES}) x ON p.subject_id = x.subject_id""")
def subject_score_lookup(s: Study):
    lookup = s.scores.where("model = 'hash'").groupBy("subject_id").agg(F.avg("score").alias("score"))
    return compare.lookup_complete(s.patients, lookup)


@query("subject_scores_all_or_nothing", "subject_id:l score:d", "JN9",
       f"""SELECT p.subject_id, CASE WHEN (SELECT bool_and(y.score IS NOT NULL) FROM patients q LEFT JOIN ({_SUBJECT_SCORES}) y ON q.subject_id = y.subject_id)
                  THEN x.score END AS score FROM patients p LEFT JOIN ({_SUBJECT_SCORES}) x ON p.subject_id = x.subject_id""")
def subject_scores_all_or_nothing(s: Study):
    lookup = s.scores.where("model = 'hash'").groupBy("subject_id").agg(F.avg("score").alias("score"))
    return compare.lookup_scores(s.patients.select("subject_id"), lookup)


# ── subgroups and fairness ──────────────────────────────────────────────────


@query("evaluation_demographics", "model:s hadm_id:l gender:s race_cat:s age_group:s is_emergency:l race_binary:s", "JN10 PRJ15",
       "SELECT * FROM decided_demo")
def evaluation_demographics(s: Study):
    return s.decided_demo


_GROUP_KEYS = 'model, "group", value'


@query("subgroup_metrics", "model:s group:s value:s n:l n_pos:l auprc:d auroc:d", "EV20",
       rank_sql("grouped", _GROUP_KEYS))
def subgroup_metrics(s: Study):
    return fairness.subgroup_metrics(s.decided_demo)


_WILSON = """greatest((o + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) - 1.96e0 * sqrt((o * (1 - o) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n), 0) AS cal_ci_lo,
    least((o + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) + 1.96e0 * sqrt((o * (1 - o) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n), 1) AS cal_ci_hi"""
_FAIR = f"""SELECT {_GROUP_KEYS}, n, n_pos, CASE WHEN mixed THEN cal END AS calibration_in_large, CASE WHEN mixed THEN cal_ci_lo END AS cal_ci_lo,
        CASE WHEN mixed THEN cal_ci_hi END AS cal_ci_hi, CASE WHEN mixed THEN recall END AS recall_at_threshold, auprc FROM (
    SELECT f.*, {_WILSON}, n_pos > 0 AND n_pos < n AS mixed FROM (
        SELECT {_GROUP_KEYS}, count(*) AS n, sum(label) AS n_pos, avg(score) - avg(label) AS cal, avg(label) AS o,
               coalesce(count(*) FILTER (WHERE predicted = 1 AND label = 1) / nullif(sum(label), 0)::DOUBLE, 0) AS recall
        FROM grouped GROUP BY ALL) f)
    JOIN (SELECT {_GROUP_KEYS}, auprc FROM ({rank_sql('grouped', _GROUP_KEYS)})) USING ({_GROUP_KEYS})"""


@query("fairness_table", "model:s group:s value:s n:l n_pos:l calibration_in_large:d cal_ci_lo:d cal_ci_hi:d recall_at_threshold:d auprc:d", "EV21 EV14", _FAIR)
def fairness_table(s: Study):
    return fairness.fairness_table(s.decided_demo)


@query("equal_opportunity_difference", "model:s group:s n_values:l eo_diff:d", "EV23",
       """SELECT model, "group", count(*) AS n_values, max(recall) - min(recall) AS eo_diff FROM (
              SELECT model, "group", value, count(*) FILTER (WHERE predicted = 1 AND label = 1) / sum(label)::DOUBLE AS recall
              FROM grouped GROUP BY ALL HAVING sum(label) > 0 AND sum(label) < count(*)) GROUP BY ALL HAVING count(*) >= 2""")
def equal_opportunity_difference(s: Study):
    return fairness.equal_opportunity(fairness.fairness_table(s.decided_demo))


_LIMITS = fairness.poisson_limits()
_POISSON = "CASE " + " ".join(f"WHEN x <= {limit} THEN {k}" for k, limit in enumerate(_LIMITS)) + f" ELSE {len(_LIMITS)} END"
_BOOT = f"""WITH RECURSIVE jumps(r, m) AS (
        SELECT 0, {fairness.MULTIPLIER}::BIGINT UNION ALL SELECT r + 1, m * {fairness.MULTIPLIER} % {fairness.MODULUS} FROM jumps WHERE r + 1 < {fairness.N_BOOTSTRAP}),
    started AS (
        SELECT {_GROUP_KEYS}, score, label, 1 + ('0x' || substr(md5('42|' || model || '|' || "group" || '|' || value || '|' || hadm_id), 1, 8))::BIGINT % {fairness.MODULUS - 1} AS x0
        FROM grouped),
    drawn AS (SELECT {_GROUP_KEYS}, r, score, label, {_POISSON} AS d FROM (SELECT *, x0 * m % {fairness.MODULUS} AS x FROM started CROSS JOIN jumps)),
    cells AS (SELECT {_GROUP_KEYS}, r, score, sum(d * label) AS pos, sum(d * (1 - label)) AS neg FROM drawn WHERE d > 0 GROUP BY ALL),
    ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM cells WINDOW w AS (PARTITION BY {_GROUP_KEYS}, r ORDER BY score DESC)),
    replicated AS (SELECT {_GROUP_KEYS}, r, sum(pos * tp / seen::DOUBLE) / sum(pos) AS auprc FROM ranked GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0)
    SELECT {_GROUP_KEYS}, len(v) AS n_valid, v[floor(len(v) * 0.025e0)::INT + 1] AS auprc_ci_lo, v[floor(len(v) * 0.975e0)::INT + 1] AS auprc_ci_hi
    FROM (SELECT {_GROUP_KEYS}, list_sort(list(auprc)) AS v FROM replicated GROUP BY ALL)"""


@query("bootstrap_intervals", "model:s group:s value:s n_valid:l auprc_ci_lo:d auprc_ci_hi:d", "EV22", _BOOT)
def bootstrap_intervals(s: Study):
    return fairness.bootstrap_auprc(fairness.by_subgroup(s.decided_demo))


@query("fairness_with_intervals", "model:s group:s value:s auprc:d auprc_ci_lo:d auprc_ci_hi:d auprc_ci_width:d auprc_reliable:l", "EV21 EV22",
       f"""SELECT {_GROUP_KEYS}, auprc, auprc_ci_lo, auprc_ci_hi, auprc_ci_hi - auprc_ci_lo AS auprc_ci_width,
                  coalesce(auprc_ci_hi - auprc_ci_lo < {fairness.RELIABLE_WIDTH}e0, false) AS auprc_reliable
           FROM ({_FAIR}) LEFT JOIN ({_BOOT}) USING ({_GROUP_KEYS})""")
def fairness_with_intervals(s: Study):
    intervals = fairness.bootstrap_auprc(fairness.by_subgroup(s.decided_demo))
    return fairness.with_intervals(fairness.fairness_table(s.decided_demo), intervals)


_NNS_KEYS = _GROUP_KEYS
_NNS = ", ".join(
    f"1 / (sensitivity * {p}e0 / (sensitivity * {p}e0 + (1 - specificity) * (1 - {p}e0) + 1e-9)) AS nns_{int(p * 100)}pct" for p in (0.01, 0.02, 0.05, 0.10)
)


@query("subgroup_nns", "model:s group:s value:s n:l n_pos:l sensitivity:d specificity:d nns_1pct:d nns_2pct:d nns_5pct:d nns_10pct:d", "EV24",
       f"""SELECT {_NNS_KEYS}, tp + fp + tn + fn AS n, tp + fn AS n_pos, sensitivity, specificity, {_NNS.replace('1 / (', 'CASE WHEN sensitivity > 0 THEN 1 / (').replace(' AS nns', " ELSE 'inf'::DOUBLE END AS nns")}
           FROM ({confusion_sql('grouped', _NNS_KEYS)}) WHERE tp + fn > 0 AND fp + tn > 0 AND "group" <> 'race'""")
def subgroup_nns(s: Study):
    groupings = {k: v for k, v in fairness.GROUPINGS.items() if k != "race"}
    grouped = fairness.by_subgroup(s.decided_demo, groupings)
    return compare.subgroup_nns(grouped, fairness.SUBGROUP)


# ── rank test and distributions ─────────────────────────────────────────────

_MWU = """SELECT model, n1, n2, u, u / (n1 * n2) AS auc,
        (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
    SELECT r.model, n1, n2, rs - n1 * (n1 + 1) / 2 AS u, ties FROM (
        SELECT model, sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n2, sum(rnk) FILTER (WHERE label = 1) AS rs FROM (
            SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rnk FROM scores) GROUP BY model) r
    JOIN (SELECT model, sum(t * t * t - t) AS ties FROM (SELECT model, count(*)::DOUBLE AS t FROM scores GROUP BY model, score) GROUP BY model) t ON r.model = t.model)"""


@query("rank_sum_test", "model:s n1:l n2:l u:d auc:d z:d", "EV25", _MWU)
def rank_sum_test(s: Study):
    return evaluation.mann_whitney(s.scores, p_value=False)


@query("rank_sum_p_values", "model:s u:d p_value:d log10_p:d", "EV25",
       f"""SELECT *, CASE WHEN p_value > 0 THEN log10(p_value) END AS log10_p FROM (
               SELECT *, 0.5e0 * {sq.erfc('root')} AS p_value FROM (SELECT *, z / sqrt(2e0) AS root FROM ({_MWU})))""")
def rank_sum_p_values(s: Study):
    return evaluation.mann_whitney(s.scores).withColumn("log10_p", F.when(F.col("p_value") > 0, F.log10("p_value")))


@query("score_distributions", "model:s label:l n:l mean_score:d q25:d median_score:d q75:d n_above:l frac_above:d", "EV26",
       f"""SELECT model, label, count(*) AS n, avg(score) AS mean_score, {sq.percentile('score', 0.25)} AS q25, {sq.percentile('score', 0.5)} AS median_score,
                  {sq.percentile('score', 0.75)} AS q75, sum(predicted) AS n_above, avg(predicted) AS frac_above FROM decided GROUP BY ALL""")
def score_distributions(s: Study):
    return evaluation.score_distribution(s.decided, ["model", "label"])


@query("score_density", "model:s label:l bin:l n:l density:d", "EV27",
       """SELECT model, label, bin, count(*) AS n, count(*) * 30e0 / sum(count(*)) OVER (PARTITION BY model, label) AS density FROM (
              SELECT *, least(floor(score * 30) + 1, 30) AS bin FROM scores WHERE score BETWEEN 0 AND 1) GROUP BY model, label, bin""")
def score_density(s: Study):
    return evaluation.score_density(s.scores, ["model", "label"])


_EXTERNAL = f"""n AS (SELECT e.*, j.note_text FROM (SELECT subject_id, hadm_id, "group" FROM notes_raw) e JOIN all_joined j ON e.hadm_id = j.hadm_id),
           g AS (SELECT hadm_id, note_text, 1 AS label FROM n WHERE "group" = 'proxy'
                 UNION ALL (SELECT hadm_id, note_text, 0 FROM (
                     SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY hadm_id) AS rn FROM n WHERE "group" = 'unlabeled') WHERE rn = 1
                     ORDER BY md5('42|' || subject_id), subject_id LIMIT 500)),
           s AS (SELECT label, {sq.lexicon_score('folded', tx.PHRASE_LEXICON)} AS score FROM (SELECT label, {sq.folded('note_text')} AS folded FROM g))"""
# The weight of one strong phrase: a threshold frozen before the external groups are seen.
_FROZEN = 3.0


def _external_scores(s: Study):
    groups = controls.external_groups(s.corpus, corpus.proxy_notes(s.notes))
    scored = tx.with_lexicon_scores(groups, "note_text").select(F.lit("kw").alias("model"), "label", F.col("score_raw").alias("score"))
    return materialise(scored, "external")


@query("external_cohort_validation", "n1:l n2:l u:d auc:d", "ML10 EV25 SMP5",
       f"""WITH {_EXTERNAL}
           SELECT n1, n2, u, u / nullif(n1 * n2, 0) AS auc FROM (SELECT sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n2,
               sum(rnk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0 AS u FROM (
               SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk FROM s))""")
def external_cohort_validation(s: Study):
    return evaluation.mann_whitney(_external_scores(s), p_value=False)


@query("external_score_table", "model:s label:l n:l mean_score:d q25:d median_score:d q75:d n_above:l frac_above:d", "ML10 EV26",
       f"""WITH {_EXTERNAL}
           SELECT 'kw' AS model, label, count(*) AS n, avg(score) AS mean_score, {sq.percentile('score', 0.25)} AS q25, {sq.percentile('score', 0.5)} AS median_score,
                  {sq.percentile('score', 0.75)} AS q75, count(*) FILTER (WHERE score >= {_FROZEN}e0) AS n_above, avg(CASE WHEN score >= {_FROZEN}e0 THEN 1 ELSE 0 END) AS frac_above
           FROM s GROUP BY label""")
def external_score_table(s: Study):
    rows = _external_scores(s).withColumn("predicted", (F.col("score") >= _FROZEN).cast("int"))
    return evaluation.score_distribution(rows, ["model", "label"])


# ── errors ──────────────────────────────────────────────────────────────────

_WORDS = tx.CLINICAL_TERMS


def _decided_notes(s: Study, fact: str):
    """Decisions of all models next to one fact of the whole note, which is taken from its text once."""
    facts = errors.note_facts(s.discharge, "text", terms=_WORDS).select("hadm_id", fact)
    return s.decided_demo.join(materialise(facts, "note-facts"), "hadm_id")


_NOTED = "(SELECT d.*, x.text AS note_text FROM decided_demo d JOIN discharge x ON x.hadm_id = d.hadm_id)"
_ERR = f"""(SELECT *, 'overall_test' AS error_group FROM {_NOTED}
    UNION ALL SELECT *, 'false_positive' FROM {_NOTED} WHERE predicted = 1 AND label = 0
    UNION ALL SELECT *, 'false_negative' FROM {_NOTED} WHERE predicted = 0 AND label = 1)"""
_PROFILE = {
    "pct_female": "gender = 'F'", "pct_male": "gender = 'M'",
    **{f"pct_age_{a}": f"age_group = '{a}'" for a in demographics.AGE_BUCKETS},
    **{f"pct_race_{r}": f"race_cat = '{r}'" for r in demographics.RACE_LABELS_SHORT.values()},
    "pct_emergency": "is_emergency",
}


@query("error_profile", "model:s error_group:s n:l mean_score:d mean_length:d median_score:d median_length:d " + " ".join(f"{k}:d" for k in _PROFILE), "EV28 PRJ20",
       "SELECT model, error_group, count(*) AS n, avg(score) AS mean_score, avg(length(note_text)) AS mean_length, "
       f"{sq.percentile('score', 0.5)} AS median_score, {sq.percentile('length(note_text)', 0.5)} AS median_length, "
       + ", ".join(f'count(*) FILTER (WHERE {c}) / count(*)::DOUBLE * 100 AS "{k}"' for k, c in _PROFILE.items())
       + f" FROM {_ERR} GROUP BY model, error_group")
def error_profile(s: Study):
    return errors.error_profile(_decided_notes(s, "note_length"))


_RATES = "SELECT model, term, " + ", ".join(
    f"coalesce(avg(h) FILTER (WHERE {c}), 0) AS {n}" for n, c in
    (("fp_rate", "predicted = 1 AND label = 0"), ("fn_rate", "predicted = 0 AND label = 1"), ("overall_rate", "true"))
) + " FROM (" + " UNION ALL ".join(
    f"SELECT hadm_id, {sq.q(t)} AS term, CASE WHEN regexp_matches({sq.folded('text')}, {sq.q('(?i)' + p)}) THEN 1 ELSE 0 END AS h FROM discharge" for t, p in _WORDS.items()
) + ") x JOIN decided_demo d ON d.hadm_id = x.hadm_id GROUP BY model, term"
_OVER = f"""SELECT *, coalesce(fp_rate / nullif(overall_rate, 0), 0) AS fp_over_overall, coalesce(fn_rate / nullif(overall_rate, 0), 0) AS fn_over_overall FROM ({_RATES})"""


@query("term_over_representation", "model:s term:s fp_rate:d fn_rate:d overall_rate:d fp_over_overall:d fn_over_overall:d", "EV29 TXT11", _OVER)
def term_over_representation(s: Study):
    return errors.term_rates(_decided_notes(s, "note_terms"), list(_WORDS))


@query("top_error_terms", "model:s side:s term:s ratio:d place:l", "TOP3",
       f"""SELECT * FROM (SELECT model, side, term, ratio, row_number() OVER (PARTITION BY model, side ORDER BY round(ratio, 9) DESC, term) AS place FROM (
               SELECT model, 'fp' AS side, term, fp_over_overall AS ratio FROM ({_OVER}) UNION ALL SELECT model, 'fn', term, fn_over_overall FROM ({_OVER}))) WHERE place <= 3""")
def top_error_terms(s: Study):
    return errors.top_terms(errors.term_rates(_decided_notes(s, "note_terms"), list(_WORDS)), 3)


@query("false_negative_sparsity", "model:s n_fn:l n_below_q1:l n_short:l share_below_q1:d share_short:d", "EV30",
       f"""SELECT *, coalesce(n_below_q1 / nullif(n_fn, 0)::DOUBLE, 0) AS share_below_q1, coalesce(n_short / nullif(n_fn, 0)::DOUBLE, 0) AS share_short FROM (
               SELECT n.model, count(*) FILTER (WHERE fn) AS n_fn, count(*) FILTER (WHERE fn AND length(note_text) < q1) AS n_below_q1,
                      count(*) FILTER (WHERE fn AND length(note_text) < 500) AS n_short
               FROM (SELECT *, predicted = 0 AND label = 1 AS fn FROM {_NOTED}) n
               JOIN (SELECT model, {sq.percentile('length(note_text)', 0.25)} AS q1 FROM {_NOTED} GROUP BY model) q ON q.model = n.model GROUP BY n.model)""")
def false_negative_sparsity(s: Study):
    return errors.false_negative_sparsity(_decided_notes(s, "note_length"))


@query("trauma_term_share", "model:s error_group:s n:l pct_with_term:d", "TXT11 EV28",
       f"SELECT model, error_group, count(*) AS n, avg(CASE WHEN {sq.any_substring('note_text', tx.TRAUMA_SUBSTRINGS)} THEN 1 ELSE 0 END) * 100 AS pct_with_term FROM {_ERR} GROUP BY 1, 2")
def trauma_term_share(s: Study):
    return errors.trauma_term_share(_decided_notes(s, "note_trauma"))


_CRIT = ["A", "B", "C", "D", "E"]


@query("criterion_signal", "criterion:s pos_mean:d neg_mean:d ratio:d", "EV31 TXT9",
       "SELECT *, CASE WHEN neg_mean > 0 THEN pos_mean / neg_mean ELSE 'inf'::DOUBLE END AS ratio FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS criterion, avg(x) FILTER (WHERE label = 1) AS pos_mean, avg(x) FILTER (WHERE label = 0) AS neg_mean FROM "
           f"(SELECT label, {sq.lexicon_score('folded', [e for e in standins.STOPWORD_LEXICON if e[2] == c])} AS x FROM scored_docs)" for c in _CRIT) + ")")
def criterion_signal(s: Study):
    docs = standins.labelled_docs(s.spark, s.sf_dir)
    scored = tx.with_lexicon_scores(docs, "text", standins.STOPWORD_LEXICON)
    return errors.criterion_signal(scored, _CRIT)


# ── training risks, weights, experiment tables ──────────────────────────────

_Z = "ln((0.001e0 + score) / (1.001e0 - score))"


@query("pu_risk", "model:s positive_risk:d unlabeled_risk:d positive_as_negative:d pu_risk:d", "EV32 AGG15",
       f"""SELECT *, 0.3e0 * positive_risk + greatest(unlabeled_risk - 0.3e0 * positive_as_negative, 0) AS pu_risk FROM (
               SELECT model, avg(ln(1 + exp(-z))) FILTER (WHERE label = 1) AS positive_risk, avg(ln(1 + exp(z))) FILTER (WHERE label = 0) AS unlabeled_risk,
                      avg(ln(1 + exp(z))) FILTER (WHERE label = 1) AS positive_as_negative FROM (SELECT *, {_Z} AS z FROM probabilities) GROUP BY model)""")
def pu_risk(s: Study):
    z = F.log((F.lit(0.001) + F.col("score")) / (F.lit(1.001) - F.col("score")))
    return evaluation.pu_risk(s.probabilities.withColumn("logit", z), F.lit(0.3))


@query("weighted_pu_risk", "model:s positive_risk:d unlabeled_risk:d positive_as_negative:d pu_risk:d", "EV33",
       f"""SELECT *, 0.3e0 * positive_risk + greatest(unlabeled_risk - 0.3e0 * positive_as_negative, 0) AS pu_risk FROM (
               SELECT model, avg(ln(1 + exp(-z)) * w / m) FILTER (WHERE label = 1) AS positive_risk, avg(ln(1 + exp(z))) FILTER (WHERE label = 0) AS unlabeled_risk,
                      avg(ln(1 + exp(z)) * w / m) FILTER (WHERE label = 1) AS positive_as_negative FROM (
                   SELECT *, avg(w) FILTER (WHERE label = 1) OVER (PARTITION BY model) AS m FROM (
                       SELECT *, {_Z} AS z, 1 / (0.05e0 + 0.9e0 * {sq.uniform("'e'", 'subject_id')}) AS w FROM probabilities)) GROUP BY model)""")
def weighted_pu_risk(s: Study):
    z = F.log((F.lit(0.001) + F.col("score")) / (F.lit(1.001) - F.col("score")))
    e = F.lit(0.05) + F.lit(0.9) * standins.md5_uniform("e", F.col("subject_id"))
    rows = s.probabilities.withColumn("logit", z).withColumn("propensity", e)
    return evaluation.pu_risk(rows, F.lit(0.3), "propensity")


@query("class_weights", "label:l n_class:l class_weight:d class_fraction:d", "AGG15",
       """SELECT quality AS label, count(*) AS n_class, sum(count(*)) OVER () / (2e0 * count(*)) AS class_weight,
                 count(*) / sum(count(*)) OVER ()::DOUBLE AS class_fraction FROM labels GROUP BY quality""")
def class_weights(s: Study):
    labels = standins.table(s.spark, s.sf_dir, "labels").withColumnRenamed("quality", "label")
    return evaluation.class_weights(labels)


_CONDITIONS = f"""SELECT condition, quality AS label, CASE WHEN n_words > 0 THEN raw / n_words ELSE 0e0 END AS score FROM (
        SELECT condition, hadm_id, {sq.lexicon_score('folded', tx.PHRASE_LEXICON)} AS raw, {sq.hits('x', chr(92) + 'S+')} AS n_words
        FROM (SELECT *, {sq.folded('x')} AS folded FROM (
            SELECT 'baseline' AS condition, hadm_id, note_text AS x FROM all_joined
            UNION ALL SELECT 'masked', hadm_id, regexp_replace(note_text, {sq.q(sq.MASK_REGEX)}, {sq.q(tx.MASK_TOKEN)}, 'g') FROM all_joined
            UNION ALL SELECT 'section_removed', j.hadm_id, coalesce(n.note_text, j.note_text) FROM all_joined j LEFT JOIN nopmh_joined n ON j.hadm_id = n.hadm_id)))
        JOIN labels ON doc_id = hadm_id"""


def _conditions(s: Study):
    """The same labelled notes plain, masked and without one section, scored by the same lexicon."""
    plain = tx.with_sections(s.discharge, "text").select("hadm_id", tx.joined_sections(F.col("sections")).alias("note_text"))
    plain = materialise(plain.where("note_text IS NOT NULL"), "sections")
    masked = plain.select("hadm_id", tx.mask(F.col("note_text")).alias("note_text"))
    removed = corpus.without_section(s.discharge, plain)
    versions = {"baseline": plain, "masked": masked, "section_removed": removed}
    notes = None
    for name, version in versions.items():
        version = version.select(F.lit(name).alias("condition"), "hadm_id", "note_text")
        notes = version if notes is None else notes.unionByName(version)
    scored = tx.with_lexicon_scores(notes, "note_text").select("condition", "hadm_id", F.col("score_norm").alias("score"))
    labels = standins.table(s.spark, s.sf_dir, "labels").select(F.col("doc_id").alias("hadm_id"), F.col("quality").alias("label"))
    return materialise(scored.join(labels, "hadm_id"), "conditions")


@query("ablation_table", "condition:s auprc:d auroc:d auprc_delta:d sensitivity_fixed:d sensitivity_retuned:d", "EV34",
       f"""WITH c AS ({_CONDITIONS}), r AS ({rank_sql('c', 'condition')}),
           t AS (SELECT condition, coalesce(max(t) FILTER (WHERE recall >= 0.85e0), 0) AS t FROM (
               SELECT condition, g.t, count(*) FILTER (WHERE score >= g.t AND label = 1) / sum(label)::DOUBLE AS recall FROM c CROSS JOIN ({_GRID}) g GROUP BY ALL) GROUP BY 1),
           b AS (SELECT t AS t0 FROM t WHERE condition = 'baseline')
           SELECT r.condition, auprc, auroc, auprc - (SELECT auprc FROM r WHERE condition = 'baseline') AS auprc_delta, sensitivity_fixed, sensitivity_retuned
           FROM r JOIN (SELECT c.condition, count(*) FILTER (WHERE score >= t0 AND label = 1) / sum(label)::DOUBLE AS sensitivity_fixed,
                               count(*) FILTER (WHERE score >= t.t AND label = 1) / sum(label)::DOUBLE AS sensitivity_retuned
                        FROM c JOIN t ON c.condition = t.condition CROSS JOIN b GROUP BY c.condition) x ON r.condition = x.condition""")
def ablation_table(s: Study):
    rows = _conditions(s)
    keys = ["condition"]
    table = evaluation.ablation_table(evaluation.rank_metrics(rows, keys), "baseline")
    retuned = evaluation.threshold_on_grid(rows, keys)
    fixed = retuned.where("condition = 'baseline'").select("threshold").scalar()
    own = evaluation.operating_metrics(evaluation.with_threshold(rows, retuned, keys), keys)
    frozen = rows.withColumn("predicted", (F.col("score") >= fixed).cast("int"))
    base = evaluation.operating_metrics(frozen, keys)
    return table.join(base.select("condition", F.col("sensitivity").alias("sensitivity_fixed")), "condition").join(
        own.select("condition", F.col("sensitivity").alias("sensitivity_retuned")), "condition"
    )


_TERM_FLAGS = " UNION ALL ".join(
    f"SELECT subject_id, hadm_id, label, {i} AS term, CASE WHEN regexp_matches(folded, {sq.q('(?i)' + p)}) THEN 1 ELSE 0 END AS f FROM scored_docs"
    for i, (p, _, _) in enumerate(standins.STOPWORD_LEXICON)
)


@query("temporal_generalisation", "delta_auprc:d delta_auroc:d generalization_penalty:d", "EV35 SMP2 SMP3",
       f"""WITH t AS MATERIALIZED ({_TERM_FLAGS}),
           sp AS (SELECT 'random' AS kind, subject_id, split FROM ({RANDOM_SPLIT}) UNION ALL SELECT 'temporal', subject_id, split FROM ({TEMPORAL_SPLIT})),
           w AS (SELECT kind, term, ln((sum(f * label) + 1) / (sum(label) + 2e0)) - ln((sum(f * (1 - label)) + 1) / (sum(1 - label) + 2e0)) AS w
                 FROM t JOIN sp USING (subject_id) WHERE split = 'train' GROUP BY 1, 2),
           s AS (SELECT a AS trained_on, b AS tested_on, hadm_id, max(label) AS label, round(sum(f * w), 6) AS score
                 FROM (VALUES ('temporal', 'temporal'), ('random', 'temporal'), ('random', 'random')) c(a, b)
                 JOIN sp ON sp.kind = b AND split = 'test' JOIN t USING (subject_id) JOIN w ON w.kind = a AND w.term = t.term GROUP BY 1, 2, 3),
           r AS ({rank_sql('s', 'trained_on, tested_on')}),
           c AS (SELECT max(auprc) FILTER (WHERE trained_on = 'temporal') AS tp, max(auroc) FILTER (WHERE trained_on = 'temporal') AS tr,
                        max(auprc) FILTER (WHERE trained_on = 'random' AND tested_on = 'temporal') AS rp, max(auroc) FILTER (WHERE trained_on = 'random' AND tested_on = 'temporal') AS rr,
                        max(auprc) FILTER (WHERE tested_on = 'random') AS bp FROM r)
           SELECT tp - rp AS delta_auprc, tr - rr AS delta_auroc, bp - rp AS generalization_penalty FROM c""")
def temporal_generalisation(s: Study):
    """A term model is fitted on the training part of either split and scored on the held-out parts."""
    docs = tx.with_lexicon_scores(standins.labelled_docs(s.spark, s.sf_dir), "text", standins.STOPWORD_LEXICON)
    flags = docs.select("subject_id", "hadm_id", "label", F.posexplode("lexicon_hits").alias("term", "hits"))
    flags = materialise(flags.select("subject_id", "hadm_id", "label", "term", (F.col("hits") > 0).cast("int").alias("present")), "terms")
    subjects = flagged_subjects(s)
    splits = {"random": sampling.stratified_split(subjects), "temporal": sampling.temporal_split(subjects, s.patients)}
    parts = {k: flags.join(v.select("subject_id", "split"), "subject_id") for k, v in splits.items()}
    weights = {k: models.term_odds(v.where("split = 'train'")) for k, v in parts.items()}
    cells = None
    for trained, tested in (("temporal", "temporal"), ("random", "temporal"), ("random", "random")):
        scored = models.term_scores(parts[tested].where("split = 'test'"), weights[trained], ["hadm_id", "label"])
        scored = scored.select(F.lit(trained).alias("trained_on"), F.lit(tested).alias("tested_on"), "label", F.round("score", 6).alias("score"))
        cells = scored if cells is None else cells.unionByName(scored)
    return evaluation.temporal_comparison(evaluation.rank_metrics(cells, ["trained_on", "tested_on"]))


@query("sweep_leaderboard", "model:s auprc:d place:l is_best:l", "EV36",
       f"""SELECT *, CASE WHEN place = 1 THEN 1 ELSE 0 END AS is_best FROM (SELECT model, auprc, row_number() OVER (ORDER BY auprc DESC, model) AS place FROM ({_RANK}))""")
def sweep_leaderboard(s: Study):
    return evaluation.leaderboard(evaluation.rank_metrics(s.scores), "auprc", "model")


@query("top_decile_rows", "model:s hadm_id:l score:d", "WIN6",
       """SELECT s.model, hadm_id, score FROM scores s
          JOIN (SELECT model, quantile_cont(score, 0.9) AS cut FROM scores WHERE label = 1 GROUP BY model) c ON c.model = s.model WHERE label = 1 AND score >= cut""")
def top_decile_rows(s: Study):
    return top_decile(s.scores.where("label = 1"))


@query("top_unlabeled_rows", "model:s patient_number:l subject_id:l hadm_id:l model_score:d reviewer_rating:s reviewer_notes:s", "TOP1 SNK5",
       """SELECT model, patient_number, subject_id, hadm_id, score AS model_score, NULL AS reviewer_rating, NULL AS reviewer_notes FROM (
              SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, subject_id, hadm_id) AS patient_number FROM scores WHERE label = 0)
          WHERE patient_number <= 50""")
def top_unlabeled_rows(s: Study):
    return review_form(s.scores.where("label = 0"), by=["model"])


@query("sampled_errors_sorted", "model:s error_side:s hadm_id:l score:d", "TOP4 SMP5",
       """SELECT model, error_side, hadm_id, score FROM (
              SELECT *, row_number() OVER (PARTITION BY model, error_side ORDER BY md5('42|' || subject_id || '|' || hadm_id), subject_id, hadm_id) AS rn
              FROM (SELECT *, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_side FROM decided WHERE predicted <> label)) WHERE rn <= 25""")
def sampled_errors_sorted(s: Study):
    """Both error sides of every model, most confident errors first."""
    wrong = s.decided.where("predicted <> label").withColumn("error_side", F.when(F.col("label") == 1, "FN").otherwise("FP"))
    sample = sampling.sample_per_group(wrong, ["model", "error_side"], 25, ["subject_id", "hadm_id"])
    gap = F.when(F.col("label") == 1, F.col("score")).otherwise(-F.col("score"))
    return sample.orderBy("model", "error_side", gap, "hadm_id")
