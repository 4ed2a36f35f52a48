"""Entity-period targets and leakage-safe history.

A lag is a value range of the period, not a row offset: a period without rows gives null.
All lags and means of an entity come from windows over one exchange on the entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import score
from ..functions.ranks import known_sum, last_known


def range_window(entity: str | Sequence[str], period: str, back: int, until: int = 1):
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(period).rangeBetween(-back, -until)


def exact_lag(value: str, entity: str | Sequence[str], period: str, k: int) -> Column:
    """The value of exactly k periods before."""
    return F.max(value).over(range_window(entity, period, k, k))


def recent_mean(value: str, entity: str, period: str, k: int) -> Column:
    """Mean over what there is of the last k periods."""
    return F.avg(value).over(range_window(entity, period, k))


def prior_count(entity: str, period: str) -> Column:
    return F.row_number().over(Window.partitionBy(entity).orderBy(period)) - 1


def weighted_history(value: str, entity: str, period: str, weights: Sequence[float]) -> Column:
    """Weighted mean of the lags 1..n, the weights of missing ones shared by the rest."""
    total = known = F.lit(0.0)
    for k, w in enumerate(weights, 1):
        lag = exact_lag(value, entity, period, k)
        total = total + F.coalesce(lag * w, F.lit(0.0))
        known = known + F.when(lag.isNotNull(), w).otherwise(0.0)
    return F.try_divide(total, known)


def targets(
    stats: DataFrame, entity: str, period: str, segment: str, sub: str, occurrence: str, group: str,
    weights: Mapping[str, float], sums: Sequence[str], *more: Column,
) -> DataFrame:
    """Entity-period rows: n occurrences, sums (missing counts 0), last group and segment, total and per-occurrence score, and more aggregates.

    A row of zeros still counts as an occurrence. One exchange on (entity, period).
    """
    return (
        stats.filter(F.col(entity).isNotNull())
        .withColumn("__score", score(weights))
        .groupBy(entity, period)
        .agg(
            F.count_distinct(occurrence).alias("n_occ"),
            *(known_sum(x).alias(x) for x in sums),
            last_known(segment, F.struct(sub, occurrence)).alias(segment),
            last_known(group, F.struct(sub, occurrence)).alias(group),
            known_sum("__score").alias("total_score"),
            *more,
        )
        .withColumn("target", F.col("total_score") / F.col("n_occ"))
    )


def eligible(panel: DataFrame, least: int, target: str = "target", occurrences: str = "n_occ") -> DataFrame:
    """Rows with enough occurrences and a finite target."""
    t = F.col(target)
    return panel.filter((F.col(occurrences) >= least) & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))


def first_row(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row a key under an order that decides every tie."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def top_rows(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def checked_targets(stats: DataFrame, entity: str, period: str, segment: str, sub: str, occurrence: str, group: str, weights: Mapping[str, float], sums: Sequence[str]) -> DataFrame:
    """targets(), after a gate that refuses repeated rows of an entity and occurrence."""
    from .contracts import assert_unique

    return targets(assert_unique(stats, [entity, period, occurrence]), entity, period, segment, sub, occurrence, group, weights, sums)


def target_audit(stats: DataFrame, built: DataFrame, keys: Sequence[str], least: int, *more: Column) -> DataFrame:
    """One row: stat rows, keys and repeated ones among them, targets built and those with enough occurrences."""
    per = stats.groupBy(*keys).agg(F.count("*").alias("n"))
    a = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"))
    b = built.agg(F.count("*").alias("n_targets"), F.count_if(F.col("n_occ") >= least).alias("n_eligible"), *more)
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")
