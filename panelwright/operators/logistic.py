"""Cross-fitted class probabilities: every fold's balanced logistic regression at once.

A Newton step needs the gradient and the Hessian of each fold's training rows, which are
sums that Spark makes for all folds in one pass; the step itself is a small solve. Only
coefficients, a row a fold, come to the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear


def standard(features: Sequence[str]) -> list[Column]:
    """1 and the standardized, imputed features of a row joined with its fold's statistics (arrays med, mean and std)."""
    at = lambda c, i: F.get(c, F.lit(i))
    return [F.lit(1.0), *(F.when(at("std", i) > 0, (F.coalesce(F.col(x).cast("double"), at("med", i)) - at("mean", i)) / at("std", i)).otherwise(0.0) for i, x in enumerate(features))]


def crossfit(rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str], label: str, least: int = 100, least_class: int = 20, penalty: float = 1.0, rounds: int = 10) -> DataFrame:
    """rows with probability, from a fit on earlier periods only; null where these have too few rows or too few of a class, or the label of the past is unknown.

    Classes weigh alike. The penalty is on the squares of the standardized coefficients / 2.
    """
    spark, keys = rows.sparkSession, [*by, "fold"]
    known = rows.filter(F.col(label).isNotNull())
    sums = linear.fold_sums(known, by, period, features, label, least)
    wide = linear.statistics(sums, keys, features).groupBy(*keys).agg(
        F.first("n").alias("n"), *(F.map_from_entries(F.collect_list(F.struct("feature", c))).alias(f"__{c}") for c in ("med", "mean", "std"))  # as many as features
    )
    arrays = wide.select(*keys, "n", *(F.array(*(F.element_at(f"__{c}", F.lit(x)) for x in features)).alias(c) for c in ("med", "mean", "std")))
    positives = sums.select(*keys, F.element_at("s", -1).alias("n_1"))
    folds = arrays.join(positives, keys).filter((F.col("n_1") >= least_class) & (F.col("n") - F.col("n_1") >= least_class))
    kinds = linear.key_kinds(folds, keys)
    held = [r.asDict() for r in folds.collect()]  # a row a fold
    table = lambda coefs: spark.createDataFrame([(*(r[k] for k in keys), float(r["n"]), float(r["n_1"]), r["med"], r["mean"], r["std"], c) for r, c in zip(held, coefs, strict=True)], f"{kinds}, n double, n_1 double, med array<double>, mean array<double>, std array<double>, beta array<double>")
    k = len(features) + 1
    beta = {tuple(r[x] for x in keys): np.zeros(k) for r in held}
    x = standard(features)
    dot = reduce(add, (F.get("beta", F.lit(i)) * v for i, v in enumerate(x)))
    p = 1 / (1 + F.exp(-dot))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    ridge = penalty * np.diag([0.0] + [1.0] * (k - 1))
    for _ in range(rounds):
        if not held:
            break
        now = table([beta[tuple(r[c] for c in keys)].tolist() for r in held])
        train = known.join(now.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in now.columns if c not in by)), reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in by)) & (F.col(period) < F.col("fold")))
        y = F.col(label).cast("double")
        w = F.col("n") / 2 / F.when(y > 0, F.col("n_1")).otherwise(F.col("n") - F.col("n_1"))
        got = train.select(*(F.col(f"__{c}").alias(c) for c in by), "fold", F.array(*x).alias("x"), (w * (y - p)).alias("g"), (w * p * (1 - p)).alias("h"))
        at = lambda i: F.get("x", F.lit(i))
        steps = got.groupBy(*keys).agg(F.array(*(F.sum(F.col("g") * at(i)) for i in range(k))).alias("g"), F.array(*(F.sum(F.col("h") * at(i) * at(j)) for i, j in pairs)).alias("h")).collect()
        most = 0.0
        for r in steps:
            key = tuple(r[c] for c in keys)
            full = np.zeros((k, k))
            full[np.triu_indices(k)] = r["h"]
            full = full + np.triu(full, 1).T + ridge
            step = np.linalg.lstsq(full, np.array(r["g"]) - ridge @ beta[key], rcond=None)[0]
            beta[key] = beta[key] + step
            most = max(most, np.abs(step).max())
        if most < 1e-10:
            break
    final = table([beta[tuple(r[c] for c in keys)].tolist() for r in held])
    out = rows.withColumn("fold", F.col(period)).join(final.drop("n", "n_1"), keys, "left").withColumn("probability", p)
    return out.drop("fold", "med", "mean", "std", "beta")
