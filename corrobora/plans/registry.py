"""Named queries over the standard tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL equivalent where SQL can say it."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            # naive timestamps of the tables are read as UTC wall time
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep
