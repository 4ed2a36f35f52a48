"""Exact medians of groups of any size, and of every fold, by radix selection on the bits of the value.

A double's bits, put in order, are chosen 16 at a time from the top: a pass counts the rows
that share the prefix found so far by their next 16 bits, and the digit at which the count
reaches the median's place joins the prefix. Four passes, each a count with map-side
sums; no group's values meet in one task, only counts of at most 65,536 digits. A fold takes
the counts of the periods before it, so rows are not repeated for folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..sources.scratch import held
from .places import same_keys

DIGIT = 16


@F.pandas_udf(LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """The bits of doubles as longs in the same order; both zeros are one."""
    bits = (v.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(DoubleType())
def value_of_bits(b: pd.Series) -> pd.Series:
    bits = b.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(float))


def medians(rows: DataFrame, by: Sequence[str], values: Sequence[str], period: str | None = None, folds: DataFrame | None = None) -> DataFrame:
    """by (and fold) and med_<value> of every value: the median of its known values, the mean of the middle two where they are even in number; null without any.

    With folds (by, fold) the rows of a fold are those with an earlier period. NaN is not a value. Null keys are a group.
    """
    keys = [*by, "fold"] if period else list(by)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values))))
    when = [F.col(period).alias("__period")] if period else []
    long = rows.select(*by, *when, each.alias("e")).filter(F.col("e.v").isNotNull() & ~F.isnan("e.v"))
    bits = held(long.select(*by, *(["__period"] if period else []), F.col("e.of").alias("__of"), ordered_bits("e.v").alias("__bits")), "bits")
    counts = bits.groupBy(*by, *(["__period"] if period else []), "__of").agg(F.count("*").alias("n"))

    def of_folds(counted: DataFrame, wanted: DataFrame, on: Sequence[str], more: Sequence[str]) -> DataFrame:
        """Counts of each wanted row's periods, summed."""
        both = same_keys(wanted, counted, on)
        return (both.filter(F.col("__period") < F.col("fold")) if period else both).groupBy(*wanted.columns, *more).agg(F.sum("n").alias("n"))

    if period:
        sizes = of_folds(counts, folds.select(*by, "fold").distinct(), by, ["__of"])
    else:
        sizes = counts
    targets = sizes.select(*keys, "__of", F.posexplode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("__which", "__rank")).withColumn("__prefix", F.lit(0).cast("long"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        targets = held(targets, "targets")
        prefix = F.lit(0).cast("long") if shift == 64 - DIGIT else F.shiftright("__bits", shift + DIGIT)
        place = [*by, "__of", "__prefix"]
        asked = targets.select(*place).distinct()
        now = same_keys(bits.withColumn("__prefix", prefix), asked, place, "left_semi")
        counted = now.groupBy(*place, *(["__period"] if period else []), F.shiftright("__bits", shift).alias("__next")).agg(F.count("*").alias("n"))
        run = of_folds(counted, targets, place, ["__next"])
        own = [*keys, "__of", "__which"]
        w = Window.partitionBy(*own).orderBy("__next").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 digits at most
        reached = run.withColumn("__run", F.sum("n").over(w)).filter((F.col("__run") > F.col("__rank")) & (F.col("__run") - F.col("n") <= F.col("__rank")))
        targets = reached.select(*own, (F.col("__rank") - F.col("__run") + F.col("n")).alias("__rank"), F.col("__next").alias("__prefix"))
    found = targets.withColumn("__v", value_of_bits("__prefix"))
    mean = lambda i: F.avg(F.when(F.col("__of") == i, F.col("__v")))
    return found.groupBy(*keys).agg(*(mean(i).alias(f"med_{v}") for i, v in enumerate(values)))


def with_medians(rows: DataFrame, summary: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """summary, a row a group of rows, with the median of value."""
    found = medians(rows.withColumn("__x", value), by, ["__x"]).withColumnRenamed("med___x", name)
    return same_keys(summary, found, by, "left")

