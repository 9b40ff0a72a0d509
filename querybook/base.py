"""Registration of a query and its SQL counterpart under one name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmill.plans.lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Reads the test tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def scratch(self) -> str:
        """A new folder that all executors see."""
        return f"{shared_folder(self.spark)}/rowmill-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables, with the equivalent SQL."""

    def register(build):
        key = name or build.__name__
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
