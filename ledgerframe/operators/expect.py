"""Expectations: named violations, counted in one audit table."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    name: str
    violations: DataFrame


def audit(expectations: list[Expectation]) -> DataFrame:
    """A row for each expectation: name, violations, passed."""
    rows = [e.violations.agg(F.count("*").alias("violations")).select(F.lit(e.name).alias("name"), "violations", (F.col("violations") == 0).alias("passed")) for e in expectations]
    return functools.reduce(DataFrame.unionByName, rows)


def required_columns(df: DataFrame, names: list[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that come more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have."""
    return a.select(key).intersect(b.select(key))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows, with repeats, that one has and the other lacks."""
    b = b.select(*a.columns)
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def lacking(df: DataFrame, names: list[str]) -> DataFrame:
    """The required columns that df lacks, as rows."""
    return df.sparkSession.createDataFrame([(n,) for n in sorted(set(names) - set(df.columns))], "name string")


def absent(df: DataFrame, column: str, values: list) -> DataFrame:
    """The values that no row has."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return wanted.join(df.select(column), column, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The rows whose key no parent has."""
    return rows.join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def broken_sequence(df: DataFrame, keys: list[str], number: str, first: int) -> DataFrame:
    """The keys whose numbers don't run from `first` on, each once."""
    return df.groupBy(*keys).agg(F.min(number).alias("least"), F.max(number).alias("greatest"), F.count("*").alias("n")).where((F.col("least") != first) | (F.col("greatest") - F.col("least") + 1 != F.col("n")))


def gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The keys whose numbers leave one out between the least and the greatest."""
    return df.groupBy(*keys).agg((F.max(number) - F.min(number) + 1).alias("span"), F.count_distinct(number).alias("n")).where("span <> n")


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def mixed(df: DataFrame, group: str, value: str) -> DataFrame:
    """The groups that have more than one value."""
    return df.groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("greatest")).where("least <> greatest")
