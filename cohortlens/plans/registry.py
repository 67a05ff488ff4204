"""Registry of queries: a Spark plan, its output columns and an optional SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans import sql as sq
from cohortlens.plans.study import Study
from cohortlens.session import tune

_CASTS = {"s": "string", "l": "bigint", "d": "double", "t": "timestamp_ntz"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    build: Callable[[Study], DataFrame]
    sql: str | None
    covers: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Study(tune(spark), sf_dir))

        def output(name: str, kind: str):
            column = F.col(f"`{name}`").cast(_CASTS[kind])
            # Nine decimals hide the summation order; adding 0 removes a negative zero.
            return (F.round(column, 9) + F.lit(0.0) if kind == "d" else column).alias(name)

        return df.select(*[output(n, k) for n, k in self.columns.items()])

    def oracle(self) -> str | None:
        return None if self.sql is None else sq.assemble(self.sql, self.columns)


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, covers: str, sql: str | None = None):
    """Register a plan. ``columns`` lists "name:kind" with kind s, l, d or t."""
    parsed = dict(part.rsplit(":", 1) for part in columns.split())

    def add(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, parsed, build, sql, tuple(covers.split()))
        return build

    return add
