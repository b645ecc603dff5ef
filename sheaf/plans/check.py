"""A registered query with its oracle in DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.plans.fixtures import Inputs, with_views
from sheaf.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Registers a function of ``Inputs`` under a name, with the SQL that must agree with it."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(tune(spark), folder))
        if sql:
            ORACLES[name] = with_views(sql, "duckdb")
        return build

    return register
