"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourceloom.plans import corpus_queries, log_queries, stream_queries, symbol_queries  # noqa: F401  they fill the registry
from sourceloom.plans.common import REGISTRY, Inputs, prepare


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return REGISTRY[name][0](Inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: run(name, spark, sf_dir) for name in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
