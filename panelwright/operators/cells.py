"""Binned cells: rows summed to statistics of bounded size, from which trees of every fold and setting grow.

A tree on binned features sees of its rows only how many fall into a cell of bins and what
their targets sum to. So rows are summed once by (group, period, cell of features, bin
of the target), and a fold trains on the cells of the periods before it. There are at most
MOST_CELLS of them in a group and period whatever the number of rows: the more
features, the fewer bins each. Squared error needs no more than these sums, so it gives the
tree that all rows would give; absolute error and bagging take a cell for points at its mean,
which the bins of the target keep narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a group and period at most, bins of the target, and of a feature at most.
MOST_CELLS, TARGET_BINS, MOST_BINS = 1 << 17, 16, 64


def bins_of(n_features: int) -> int:
    """Bins a feature: as many as keep the cells bounded, two at least."""
    bins = MOST_BINS
    while bins > 2 and bins**n_features * TARGET_BINS > MOST_CELLS:
        bins -= 1
    if bins**n_features * TARGET_BINS > MOST_CELLS:
        raise ValueError(f"{n_features} features have more than {MOST_CELLS} cells even at two bins; choose fewer")
    return bins


def edges(rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str, folds: DataFrame) -> DataFrame:
    """by, edges (ascending, an array a feature) and target_edges: quantiles of the rows before a group's first fold, which every fold may know."""
    first = folds.groupBy(*by).agg(F.min("fold").alias("__first"))
    early = rows.join(first, list(by)).filter(F.col(period) < F.col("__first"))
    cuts = lambda x, n: F.array_distinct(F.coalesce(F.percentile_approx(F.col(x).cast("double"), [i / n for i in range(1, n)], 10_000), F.array().cast("array<double>")))
    return early.groupBy(*by).agg(F.array(*(cuts(x, bins_of(len(features))) for x in features)).alias("edges"), cuts(target, TARGET_BINS).alias("target_edges"))


def bin_of(value: Column, cuts: Column) -> Column:
    """How many cuts lie below the value; what is missing counts as the middle cut, the median of the early rows."""
    known = F.coalesce(value.cast("double"), F.get(cuts, F.floor(F.size(cuts) / 2).cast("int")))
    return F.size(F.filter(cuts, lambda e: known > e))


def binned(rows: DataFrame, by: Sequence[str], features: Sequence[str], cuts: DataFrame) -> DataFrame:
    """rows with x, the number of their cell of features, and target_edges. Groups without a fold have no cuts and are left out."""
    b = bins_of(len(features))
    x = sum((bin_of(F.col(f), F.get("edges", F.lit(i))).cast("long") * b**i for i, f in enumerate(features)), F.lit(0).cast("long"))
    return rows.join(cuts, list(by)).withColumn("x", x).drop("edges")


def cells(rows: DataFrame, by: Sequence[str], period: str, target: str) -> DataFrame:
    """by, period, x, y_bin, n and s (of the target) of binned rows."""
    return rows.groupBy(*by, period, "x", bin_of(F.col(target), F.col("target_edges")).alias("y_bin")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("s"))
