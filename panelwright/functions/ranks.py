"""Ranks that Spark has no function for, and aggregates with other libraries' null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import c


def first_rank(value: Column | str, by: Sequence[str | Column], ties: Sequence[str], descending: bool = True) -> Column:
    """Places 1, 2, 3 without gaps; ties in the order of the tie columns."""
    order = c(value).desc_nulls_last() if descending else c(value).asc_nulls_last()
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties))


def lowest_rank(value: Column | str, by: Sequence[str | Column], descending: bool = True) -> Column:
    """Ties share their first place; null stays unranked."""
    order = c(value).desc_nulls_last() if descending else c(value).asc_nulls_last()
    return F.when(c(value).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)))


def total_of(value: Column | str, by: Sequence[str | Column]) -> Column:
    return F.sum(c(value)).over(Window.partitionBy(*by))


def others_total(value: Column | str, by: Sequence[str | Column]) -> Column:
    return total_of(value, by) - F.coalesce(c(value), F.lit(0))


def with_others_max(df: DataFrame, value: str, by: Sequence[str], key: str, name: str) -> DataFrame:
    """df with the largest value among the group's other rows (null if there is none known)."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(key))
    place = df.withColumn("__place", F.row_number().over(order))
    w = Window.partitionBy(*by)
    first = F.max(F.when(F.col("__place") == 1, F.col(value))).over(w)
    second = F.max(F.when(F.col("__place") == 2, F.col(value))).over(w)
    return place.withColumn(name, F.when(F.col("__place") == 1, second).otherwise(first)).drop("__place")


def known_sum(value: Column | str) -> Column:
    """Sum with an empty sum of 0."""
    return F.coalesce(F.sum(c(value)), F.lit(0))


def last_known(value: Column | str, order: Column | str) -> Column:
    """The value of the last row that has one."""
    return F.max_by(F.when(c(value).isNotNull(), c(value)), F.when(c(value).isNotNull(), c(order)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Over rows with a known value and a weight above 0."""
    ok = c(value).isNotNull() & (c(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, c(value) * c(weight))), F.sum(F.when(ok, c(weight))))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over complete pairs; null where either has no variance."""
    ok = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(ok, c(x).cast("double")), F.when(ok, c(y).cast("double"))
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(a, b) / F.nullif(sx * sy, F.lit(0.0)))


def sample_skew(x: Column | str) -> Column:
    """Bias-corrected skewness; null below three values or without variance."""
    n = F.count(c(x)).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c(x)) > 1e-12), F.skewness(c(x)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
