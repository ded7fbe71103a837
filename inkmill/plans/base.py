"""Loading of the driver's tables and a decorator that fills a module's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_from(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Rows of an SQL text that DuckDB reads too, over the named tables."""
    text = text.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
