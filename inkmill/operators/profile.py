"""Profiles of tables: numeric statistics and categorical values per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def column_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_numeric, min, max, mean, sum over an unpivot of the columns as doubles."""
    wide = table.select(*(F.col(c).cast("double").alias(c) for c in columns))
    long = wide.unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(
        F.count("*").alias("n"), F.count("value").alias("n_numeric"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.sum("value").alias("sum")
    )


def categorical(table: DataFrame, columns: list[str], most: int = 40, width: int = 24) -> DataFrame:
    """Columns of at most `most` distinct short values, fewer than rows: their values, sorted."""
    long = table.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    # Values are gathered only for columns that pass the tests, so a group has at most `most`.
    tests = counts.groupBy("column").agg(F.count("*").alias("n_distinct"), F.max(F.length("value")).alias("widest"), F.sum("n").alias("n"))
    good = tests.where((F.col("n_distinct") <= most) & (F.col("n_distinct") < F.col("n")) & (F.col("widest") <= width))
    kept = counts.join(good.select("column", "n_distinct"), "column")
    return kept.groupBy("column", "n_distinct").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values"))


def dominant(rows: DataFrame, key: str, value: str, least_rows: int = 10, share: float = 0.8) -> DataFrame:
    """Groups where one value has `share` of at least `least_rows` rows (ties: the lesser value)."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n"), F.col(value)))["n"].alias("n"), F.min(F.struct(-F.col("n"), F.col(value)))[value].alias("value"))
    return out.where((F.col("total") >= least_rows) & (F.col("n") >= share * F.col("total")))
