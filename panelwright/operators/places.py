"""Ranks, running sums and weighted medians in groups of any size.

A window by group sorts each group in one task, so a handful of groups keeps a handful of
cores busy. Here rows are dealt by ranges of (group, order) and written; every range is
sorted by itself, and only the ranges' totals, one a range and group, meet in a window.
Ranks need no order of rows, only of values: equal values are counted before the exchange,
so that a hot value costs one row a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import correlation
from ..sources.scratch import held


class Rank(NamedTuple):
    """The rank of a value. Kinds: average (ties share their mean place), percent (that over the known values), low (ties share
    their first place), first (1, 2, 3 without gaps, nulls last) and tier (1 to 4 by place, the edges at equal steps)."""

    value: str
    kind: str = "average"
    descending: bool = False


def same_keys(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet, too."""
    renamed = other.withColumnsRenamed({x: f"__right_{x}" for x in keys})
    on = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"__right_{x}")) for x in keys))
    return rows.join(renamed, on, how).drop(*(f"__right_{x}" for x in keys))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], amount: str, name: str) -> DataFrame:
    """rows with the sum of amount over their group up to themselves. The order has to tell all rows of a group apart."""
    parts = held(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    totals = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = same_keys(parts.withColumn("__inside", F.sum(amount).over(inside)), totals, [*by, "__part"])
    return both.withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def with_ranks(rows: DataFrame, by: Sequence[str], ranks: Mapping[str, Rank]) -> DataFrame:
    """rows with one column a rank, none of kind first or tier; a null value stays unranked.

    rows is written once. Values of one type share an exchange.
    """
    rows = out = held(rows, "ranked")
    kinds: dict[str, list[str]] = {}
    for value in dict.fromkeys(r.value for r in ranks.values()):
        kinds.setdefault(rows.schema[value].dataType.simpleString(), []).append(value)
    for values in kinds.values():
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(x).alias("v")) for i, x in enumerate(values))))
        counts = rows.select(*by, each.alias("__e")).filter("__e.v is not null").groupBy(*by, F.col("__e.of").alias("__of"), F.col("__e.v").alias("__v")).agg(F.count("*").alias("__n"))
        placed = running(counts, [*by, "__of"], ["__v"], "__n", "__upto")
        known = placed.groupBy(*by, "__of").agg(F.max("__upto").alias("__known"))
        placed = same_keys(placed, known, [*by, "__of"])
        for i, value in enumerate(values):
            mine = {name: rank_of(r.kind, r.descending).alias(name) for name, r in ranks.items() if r.value == value}
            out = same_keys(out, placed.filter(F.col("__of") == i).select(*by, F.col("__v").alias(value), *mine.values()), [*by, value], "left")
    return out.select(*rows.columns, *ranks)


def rank_of(kind: str, descending: bool) -> Column:
    """From __upto (known values up to this one, ascending), __n (equal ones) and __known (all)."""
    low = (F.col("__known") - F.col("__upto") if descending else F.col("__upto") - F.col("__n")) + 1
    average = low + (F.col("__n") - 1) / F.lit(2.0)
    return {"low": low, "average": average, "percent": average / F.col("__known")}[kind]


def with_places(rows: DataFrame, by: Sequence[str], value: str, ties: Sequence[str], ranks: Mapping[str, Rank]) -> DataFrame:
    """rows with ranks of one value, of any kind. ties, columns that tell a group's rows apart, order equal values (and nulls).

    One exchange orders the rows; all kinds follow from the ascending place and its largest by value.
    """
    placed = held(running(rows.withColumn("__one", F.lit(1)), by, [F.asc_nulls_last(value), *ties], "__one", "__place").drop("__one"), "placed")
    groups = placed.groupBy(*by).agg(F.count("*").alias("__size"), F.count(value).alias("__known"))
    equal = placed.groupBy(*by, value).agg(F.max("__place").alias("__upto"), F.count("*").alias("__n"))
    out = same_keys(same_keys(placed, equal, [*by, value]), groups, by)
    known, inside = F.col(value).isNotNull(), F.col("__place") - F.col("__upto") + F.col("__n")
    step = F.ceil((F.col("__place") - 1) * 4 / F.nullif(F.col("__size") - 1, F.lit(0)))
    for name, (_, kind, descending) in ranks.items():
        if kind == "first":
            rank = F.when(known & F.lit(descending), F.col("__known") - F.col("__upto") + inside).otherwise(F.col("__place"))
        elif kind == "tier":
            rank = F.when(F.col("__size") == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), step)).cast("int")
        else:
            rank = F.when(known, rank_of(kind, descending))
        out = out.withColumn(name, rank)
    return out.select(*rows.columns, *ranks)


def weighted_median(rows: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """The first value, in order, at which the running weight reaches half of all."""
    sums = held(rows.groupBy(*by, value).agg(F.sum(weight).alias("__w")), "weights")
    run = running(sums, by, [value], "__w", "__run")
    total = sums.groupBy(*by).agg(F.sum("__w").alias("__all"))
    return same_keys(run, total, by).filter(F.col("__run") * 2 >= F.col("__all")).groupBy(*by).agg(F.min(value).alias(name))


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """n and spearman by group; null below so many rows or without variance."""
    ranked = with_ranks(rows.select(*by, x, y), by, {"__x": Rank(x), "__y": Rank(y)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation("__x", "__y")).alias("spearman"))
