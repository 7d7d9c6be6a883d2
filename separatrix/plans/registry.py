"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name; ``operators`` are inventory numbers."""

    def add(run: Run) -> Run:
        if run.__name__ in QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        QUERIES[run.__name__] = Query(run.__name__, operators, run, sql)
        return run

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round double columns to 6 digits, all of them unless some are named."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: six(F.col(c)) for c in names})


def six(column: Column) -> Column:
    # Adding zero turns -0.0 into 0.0.
    return F.round(column, 6) + F.lit(0.0)
