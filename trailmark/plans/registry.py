"""Registry of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import configure, scale_to

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()) -> Callable[[Plan], Plan]:
    """Register a plan; without ``sql`` only its rows are checked.

    ``doubles`` names whole-number columns that may be null. They are returned
    as doubles, so that a missing value looks the same from both engines.
    """

    def add(plan: Plan) -> Plan:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = plan(scale_to(configure(spark), folder), folder)
            return result.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else result

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        check = sql
        if sql is not None and doubles:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles)
            check = f"SELECT * REPLACE ({casts}) FROM ({sql})"
        QUERIES[name] = Query(run, check)
        return plan

    return add
