"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.mesh import Mesh
from gridloom.plans import fixtures as X
from gridloom.session import joins_by_size, shuffles_end

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            joins_by_size(spark)
            shuffles_end(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def on_mesh(name: str, result: str, *more: str) -> Callable[[Callable[[Mesh], DataFrame]], None]:
    """Register a query on the mixed mesh alone."""

    def add(build: Callable[[Mesh], DataFrame]) -> None:
        register(name, X.sql(X.MESH, *more, select=result))(lambda spark, sf_dir: build(X.mixed_mesh(spark, sf_dir)))

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]
