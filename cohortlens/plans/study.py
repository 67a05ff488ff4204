"""One study over the stand-in tables.

Stages that several later plans read (subjects, admission extract, profile,
notes, scores) are written once to the shared scratch folder and read back, so
their work is not repeated and a lost executor costs no recomputation. All
other stages are lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import demographics
from cohortlens.operators import (
    calibration,
    characteristics,
    cohort,
    corpus,
    evaluation,
    fairness,
    sampling,
)
from cohortlens.plans import standins
from cohortlens.session import materialise


class Study:
    """Cohort, corpus and decisions over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _make(self, build) -> DataFrame:
        return build(self.spark, self.sf_dir)

    # source tables
    @cached_property
    def patients(self) -> DataFrame:
        return self._make(standins.patients)

    @cached_property
    def admissions(self) -> DataFrame:
        return self._make(standins.admissions)

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self._make(standins.diagnoses)

    @cached_property
    def prescriptions(self) -> DataFrame:
        return self._make(standins.prescriptions)

    @cached_property
    def discharge(self) -> DataFrame:
        return self._make(standins.discharge)

    # cohort
    @cached_property
    def positives(self) -> DataFrame:
        return cohort.target_subjects(self.diagnoses)

    @cached_property
    def proxies(self) -> DataFrame:
        return cohort.proxy_subjects(self.diagnoses, self.prescriptions)

    @cached_property
    def pool(self) -> DataFrame:
        """Subject table, stored once: every later stage starts from it."""
        return materialise(
            cohort.subject_pool(self.admissions, self.patients, self.diagnoses, self.prescriptions),
            "subjects",
        )

    @cached_property
    def cases(self) -> DataFrame:
        return self.pool.where("is_positive")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.pool.where("NOT is_positive AND NOT is_proxy")

    @cached_property
    def unlabeled(self) -> DataFrame:
        return sampling.matched_sample(self.cases, self.candidates, 3).select("subject_id")

    @cached_property
    def members(self) -> DataFrame:
        proxies = self.pool.where("is_proxy")
        return cohort.group_members(self.cases, proxies, self.unlabeled)

    @cached_property
    def extract(self) -> DataFrame:
        coded = cohort.target_admissions(self.diagnoses)
        rows = cohort.admission_extract(self.admissions, self.patients, coded, self.members)
        return materialise(rows, "admissions")

    @cached_property
    def index(self) -> DataFrame:
        columns = [
            "group", "hadm_id", "admittime", "dischtime", "gender", "age_at_admission", "race",
            "admission_type", "insurance", "index_admittime",
        ]
        return cohort.index_rows(self.extract, columns)

    @cached_property
    def profile(self) -> DataFrame:
        """Index rows with admission counts, length of stay and prior flags."""
        flags = cohort.prior_flags(self.extract, self.index, self.diagnoses, self.prescriptions)
        counts = cohort.admission_counts(self.admissions)
        stay = demographics.days_between(F.col("admittime"), F.col("dischtime"))
        rows = (
            self.index.join(counts, "subject_id", "left")
            .join(flags, "subject_id")
            .withColumn("los_days", stay)
        )
        return materialise(rows, "profile")

    @cached_property
    def characteristics(self) -> DataFrame:
        return characteristics.group_characteristics(self.profile)

    # notes
    @cached_property
    def notes(self) -> DataFrame:
        return materialise(corpus.notes_raw(self.discharge, self.extract), "notes")

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus.corpus(self.notes)

    @cached_property
    def subject_labels(self) -> DataFrame:
        return sampling.key_labels(self.corpus, "subject_id", "label", "hadm_id")

    # scores
    @cached_property
    def scores(self) -> DataFrame:
        """Scored once and stored, as the evaluation jobs all read them."""
        return materialise(self._make(standins.scores), "scores")

    @cached_property
    def platt(self) -> list:
        """One calibration per model, fitted on the validation rows in the same passes."""
        return calibration.fit_platt(self.scores.where("split = 'val'"))

    @cached_property
    def probabilities(self) -> DataFrame:
        """Scores of all models as probabilities: the raw lexicon score, which is not one, by its calibration."""
        calibrated = calibration.apply_platt(self.platt, self.scores)
        score = F.when(F.col("model") == "kw", F.col("calibrated")).otherwise(F.col("score"))
        return materialise(calibrated.withColumn("score", score).drop("calibrated"), "probabilities")

    @cached_property
    def thresholds(self) -> DataFrame:
        """Frozen on the validation rows."""
        return evaluation.threshold_over_scores(self.scores.where("split = 'val'"))

    @cached_property
    def decided(self) -> DataFrame:
        return evaluation.with_threshold(self.scores, self.thresholds)

    @cached_property
    def aged_admissions(self) -> DataFrame:
        return cohort.with_age(self.admissions, self.patients)

    @cached_property
    def decided_demo(self) -> DataFrame:
        return materialise(fairness.attach_demographics(self.decided, self.aged_admissions), "decided")
