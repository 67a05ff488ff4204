"""Imports every query module so that the registry is complete."""

from cohortlens.plans import (  # noqa: F401
    cohort_queries,
    io_queries,
    metric_queries,
    model_queries,
    text_queries,
)
from cohortlens.plans.registry import QUERIES

__all__ = ["QUERIES"]
