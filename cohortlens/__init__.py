"""Cohort construction and classifier evaluation as lazy Spark plans."""
