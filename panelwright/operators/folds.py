"""Expanding-window folds as rows: training data lies strictly before the fold's period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanding_folds(data: DataFrame, period: str, segment: str, least_train: int = 50) -> DataFrame:
    """(segment, fold, n_train, n_valid) of every fold with enough history. From counts by period, not from rows."""
    counts = data.groupBy(segment, period).agg(F.count("*").alias("n_valid"))
    before = Window.partitionBy(segment).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("n_train", F.coalesce(F.sum("n_valid").over(before), F.lit(0))).filter(F.col("n_train") >= least_train).select(segment, F.col(period).alias("fold"), "n_train", "n_valid")


def with_roles(data: DataFrame, folds: DataFrame, period: str, segment: str) -> DataFrame:
    """data once a fold, role train (before it) or valid (in it). Each row is repeated for all later folds; sums don't need that, see linear.fold_sums."""
    f = folds.select(F.col(segment).alias("__segment"), "fold")
    both = data.join(f, (F.col(segment) == F.col("__segment")) & (F.col(period) <= F.col("fold")))
    return both.withColumn("role", F.when(F.col(period) < F.col("fold"), "train").otherwise("valid")).drop("__segment")


def evaluation_start(folds: DataFrame, segment: str, preferred: int) -> DataFrame:
    """The first period from the preferred one on that has a fold in every segment."""
    n = folds.select(segment).distinct().agg(F.count("*").alias("n"))
    by_fold = folds.filter(F.col("fold") >= preferred).groupBy("fold").agg(F.count_distinct(segment).alias("k"))
    return by_fold.join(n, F.col("k") == F.col("n")).agg(F.min("fold").alias("start"))


def inner_periods(folds: DataFrame, segment: str, last: int = 5, least: int = 3) -> DataFrame:
    """(segment, fold, inner_fold): the last inner folds strictly before each fold, where there are at least so many."""
    inner = folds.select(F.col(segment).alias("__segment"), F.col("fold").alias("inner_fold"))
    both = folds.join(inner, (F.col(segment) == F.col("__segment")) & (F.col("inner_fold") < F.col("fold"))).drop("__segment")
    w = Window.partitionBy(segment, "fold")
    placed = both.withColumn("__place", F.row_number().over(w.orderBy(F.desc("inner_fold")))).filter(F.col("__place") <= last)
    return placed.withColumn("__n", F.count("*").over(w)).filter(F.col("__n") >= least).select(segment, "fold", "inner_fold")


def mean_baseline(data: DataFrame, period: str, segment: str, target: str) -> DataFrame:
    """(segment, period) -> mean of the target over all earlier periods."""
    by = data.groupBy(segment, period).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    before = Window.partitionBy(segment).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return by.select(segment, period, F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("baseline"))


def modal_recent(choices: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], last: int = 5) -> DataFrame:
    """The most frequent choice of the last periods, the one seen first on ties."""
    recent = choices.withColumn("__p", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(period)))).filter(F.col("__p") <= last)
    counted = recent.groupBy(*keys, *columns).agg(F.count("*").alias("n"), F.min(period).alias("__first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "__first", *columns)
    return counted.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__first")


def chosen_inside(scores: DataFrame, inner: DataFrame, by: Sequence[str], setting: Sequence[str], simplicity: Sequence[Column]) -> DataFrame:
    """For every fold the setting with the least mean error over its inner folds (to 9 places, then the simplest), and its score on the fold itself.

    scores has by, fold, the setting's columns and mae.
    """
    keys = [*by, "fold"]
    past = inner.join(scores.select(*by, F.col("fold").alias("inner_fold"), *setting, "mae"), [*by, "inner_fold"]).groupBy(*keys, *setting).agg(F.avg("mae").alias("inner_mae"))
    order = Window.partitionBy(*keys).orderBy(F.round("inner_mae", 9), *simplicity)
    return past.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r").join(scores, [*keys, *setting])
