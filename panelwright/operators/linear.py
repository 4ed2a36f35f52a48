"""Linear models from sufficient statistics.

Folds expand: what a fold trains on is what the fold before trained on, and the periods in
between. So data is summed once by (segment, period), and a running sum over the periods
gives every fold's counts, means, deviations and Gram matrix; no row is repeated. Missing
values are summed beside the known ones, so the fold's median can be put in afterwards.
Every specification, least squares, every ridge and every elastic net of a grid then cost
one small solve a fold on executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Penalties of the grids.
RIDGE = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
NET_ALPHA, NET_L1 = (0.001, 0.01, 0.1, 1.0, 10.0), (0.05, 0.25, 0.5, 0.75, 0.95)
SETTING = ["spec", "method", "alpha", "l1"]
COEF = "spec string, n_inputs int, method string, alpha double, l1 double, intercept double, coef array<double>, coef_z array<double>, med array<double>"


def period_sums(rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str) -> DataFrame:
    """n, s and p by group and period: sums and products (upper triangle, by rows) of v = (known features or 0, missing flags, target)."""
    v = [*(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in features), *(F.isnull(x).cast("double") for x in features), F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    return rows.groupBy(*by, period).agg(F.count("*").alias("n"), F.array(*(F.sum(x) for x in v)).alias("s"), F.array(*(F.sum(v[i] * v[j]) for i, j in pairs)).alias("p"))


def fold_sums(rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str, least: int = 50) -> DataFrame:
    """by, fold, n, s and p over all periods before each fold, with n_valid rows in it, where there are `least` to train on; and med."""
    m = 2 * len(features) + 1
    sums = period_sums(rows, by, period, features, target)
    before = Window.partitionBy(*by).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    past = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))).over(before) for i in range(k)))
    out = sums.select(*by, F.col(period).alias("fold"), F.col("n").alias("n_valid"), F.sum("n").over(before).alias("n"), past("s", m).alias("s"), past("p", m * (m + 1) // 2).alias("p")).filter(F.col("n") >= least)
    return with_medians(out, rows, by, period, features)


def all_sums(rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str) -> DataFrame:
    """As fold_sums, over all periods, for a final fit: a row a group."""
    m = 2 * len(features) + 1
    total = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k)))
    out = period_sums(rows, by, period, features, target).groupBy(*by).agg(F.sum("n").alias("n"), (F.max(period) + 1).alias("fold"), total("s", m).alias("s"), total("p", m * (m + 1) // 2).alias("p"))
    return with_medians(out, rows, by, period, features)


def with_medians(sums: DataFrame, rows: DataFrame, by: Sequence[str], period: str, features: Sequence[str]) -> DataFrame:
    """sums with med, the exact training medians where a feature misses values; 0 elsewhere, which need none.

    Only where some fold misses a value are rows looked at again, for all such folds at once.
    """
    from .medians import medians

    k = len(features)
    lacks = lambda i: F.get("s", F.lit(k + i)) > 0
    need = sums.filter(reduce(lambda a, b: a | b, map(lacks, range(k)))).select(*by, "fold")
    zero = F.array(*(F.lit(0.0) for _ in features))
    if need.isEmpty():
        return sums.withColumn("med", zero)
    found = medians(rows, by, features, period, need)
    found = found.select(*by, "fold", F.array(*(F.coalesce(F.col(f"med_{x}"), F.lit(0.0)) for x in features)).alias("med"))
    return sums.join(found, [*by, "fold"], "left").withColumn("med", F.coalesce("med", zero))


def net(a: np.ndarray, b: np.ndarray, n: float, alpha: float, l1: float, rounds: int = 1000, within: float = 1e-9) -> np.ndarray:
    """Coordinate descent on a Gram matrix for squared error / 2n + alpha * (l1 |w| + (1 - l1) w^2 / 2)."""
    w, lasso, ridge = np.zeros(len(b)), alpha * l1 * n, alpha * (1 - l1) * n
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            if a[j, j] + ridge <= 0:
                continue
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - lasso, 0) / (a[j, j] + ridge)
            most, w[j] = max(most, abs(new - w[j])), new
        if most < within:
            break
    return w


def design(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """x'x and x'y of imputed, standardized features about their means, these means and deviations, and the mean of y. A feature without variance is 0."""
    s, med, n = np.asarray(row["s"]), np.asarray(row["med"]), row["n"]
    k, m = len(med), len(s)
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = row["p"]
    full = full + np.triu(full, 1).T
    put = np.hstack([np.eye(k), np.diag(med)])  # known value, or the median where it is missing
    mean, my = put @ s[: 2 * k] / n, s[-1] / n
    xx, xy = put @ full[: 2 * k, : 2 * k] @ put.T - n * np.outer(mean, mean), put @ full[: 2 * k, -1] - n * mean * my
    std = np.sqrt(np.maximum(np.diag(xx), 0) / n)
    std[std <= 1e-12 * np.maximum(1, np.abs(mean))] = 0
    scale = np.divide(1, std, out=np.zeros(k), where=std > 0)
    return xx * np.outer(scale, scale), xy * scale, mean, std, my


def key_kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fits(sums: DataFrame, keys: Sequence[str], specs: Mapping[str, Sequence[int]], ridge: Sequence[float] = RIDGE, net_alpha: Sequence[float] = (), net_l1: Sequence[float] = ()) -> DataFrame:
    """Coefficients of every specification (places of its features), method and penalty, a row each.

    intercept and coef are in the features' own units, coef_z in deviations; features that
    are not in a specification have 0. med is what missing values count as.
    """
    def solve(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                a, b, mean, std, my = design(row)
                for spec, at in specs.items():
                    sub, rhs = a[np.ix_(at, at)], b[list(at)]
                    found = [("ols", 0.0, 0.0, np.linalg.lstsq(sub, rhs, rcond=1e-10)[0])]
                    found += [("ridge", r, 0.0, np.linalg.solve(sub + r * np.eye(len(rhs)), rhs)) for r in ridge]
                    found += [("net", al, l1, net(sub, rhs, row["n"], al, l1)) for al in net_alpha for l1 in net_l1]
                    for method, al, l1, w in found:
                        z = np.zeros(len(b))
                        z[list(at)] = w
                        units = np.divide(z, std, out=np.zeros(len(z)), where=std > 0)
                        out.append((*(row[k] for k in keys), spec, len(at), method, float(al), float(l1), float(my - units @ mean), units.tolist(), z.tolist(), list(row["med"])))
            yield pd.DataFrame(out, columns=[*keys, *(c.split()[0] for c in COEF.split(", "))])

    return sums.mapInPandas(solve, f"{key_kinds(sums, keys)}, {COEF}")


def predicted(features: Sequence[str]) -> Column:
    """The prediction of a row joined with a row of coefficients."""
    value = lambda i, x: F.coalesce(F.col(x).cast("double"), F.get("med", F.lit(i)))
    return F.col("intercept") + reduce(add, (F.get("coef", F.lit(i)) * value(i, x) for i, x in enumerate(features)))


def scored(rows: DataFrame, coefficients: DataFrame, by: Sequence[str], period: str, features: Sequence[str]) -> DataFrame:
    """The rows of each fold's own period, once for each of its coefficient rows, with the prediction."""
    return rows.withColumn("fold", F.col(period)).join(coefficients, [*by, "fold"]).withColumn("predicted", predicted(features))


def errors(rows: DataFrame, coefficients: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str) -> DataFrame:
    """by, fold, setting, n_inputs, mae and n over the rows of each fold's own period, of all its coefficient rows.

    Tasks have the coefficients, a row a fold and setting, and add up every setting's errors of
    their rows; no row is repeated for its settings.
    """
    keys, k, kinds = [*by, "fold"], len(features), key_kinds(rows, by)
    found = coefficients.select(*keys, *SETTING, "n_inputs", "intercept", "coef", "med").toPandas()  # a row a fold and setting
    fits_of = {key: (t["intercept"].to_numpy(float), np.stack(t["coef"]).astype(float), np.array(t["med"].iloc[0], dtype=float)) for key, t in found.groupby(keys, dropna=False, sort=False)}
    found["place"] = found.groupby(keys, dropna=False, sort=False).cumcount()
    names = rows.sparkSession.createDataFrame(found[[*keys, "place", *SETTING, "n_inputs"]], f"{kinds}, fold {rows.schema[period].dataType.simpleString()}, place int, spec string, method string, alpha double, l1 double, n_inputs int")

    def run(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            for key, part in batch.groupby([*by, "fold"], dropna=False, sort=False):
                if key not in fits_of:
                    continue
                intercept, coef, med = fits_of[key]
                lacks = part["__lacks"].to_numpy()
                x, y = part[list(features)].to_numpy(float), part["__y"].to_numpy(float)
                for i in range(k):
                    x[(lacks >> i) & 1 == 1, i] = med[i]
                known = (lacks >> k) & 1 == 0
                mine = sums.setdefault(key, [0, 0, np.zeros(len(intercept))])
                mine[0], mine[1] = mine[0] + len(part), mine[1] + int(known.sum())
                for at in range(0, len(part), 4096):
                    few = slice(at, at + 4096)
                    said = intercept + sum(x[few, i, None] * coef[:, i] for i in range(k))
                    mine[2] += np.abs(said - y[few, None])[known[few]].sum(axis=0)
        yield pd.DataFrame([(*key, n, m, e.tolist()) for key, (n, m, e) in sums.items()], columns=[*keys, "__n", "__known", "__e"])

    lacking = reduce(add, (F.isnull(x).cast("int") * (1 << i) for i, x in enumerate([*features, target])))
    read = rows.select(*by, F.col(period).alias("fold"), *(F.col(x).cast("double").alias(x) for x in features), F.col(target).cast("double").alias("__y"), lacking.alias("__lacks"))
    parts = read.mapInPandas(run, f"{kinds}, fold {rows.schema[period].dataType.simpleString()}, __n long, __known long, __e array<double>")
    each = parts.select(*keys, "__n", "__known", F.posexplode("__e").alias("place", "__e")).groupBy(*keys, "place").agg(F.try_divide(F.sum("__e"), F.sum("__known")).alias("mae"), F.sum("__n").alias("n"))
    return each.join(names, [*keys, "place"]).select(*keys, *SETTING, "n_inputs", "mae", "n")


def original_units(coefficients: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """feature, coefficient and intercept by key and setting."""
    named = F.array(*(F.struct(F.lit(x).alias("feature"), F.get("coef", F.lit(i)).alias("coefficient")) for i, x in enumerate(features)))
    return coefficients.select(*keys, *SETTING, "intercept", F.inline(named))


def statistics(sums: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """feature, n, n_missing, med, mean and std (population) of the imputed training values, by key."""
    def run(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                _, _, mean, std, _ = design(row)
                out += [(*(row[k] for k in keys), x, int(row["n"]), int(row["s"][len(features) + i]), float(row["med"][i]), float(mean[i]), float(std[i])) for i, x in enumerate(features)]
            yield pd.DataFrame(out, columns=[*keys, "feature", "n", "n_missing", "med", "mean", "std"])

    return sums.mapInPandas(run, f"{key_kinds(sums, keys)}, feature string, n long, n_missing long, med double, mean double, std double")


def rank_audit(sums: DataFrame, keys: Sequence[str], within: float = 1e-10) -> DataFrame:
    """n_features, matrix rank, deficiency and condition number of the standardized design, by key."""
    def run(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                values = np.linalg.eigvalsh(design(row)[0])[::-1]
                top = max(values[0], 0.0)
                rank = int((values > within * max(top, 1e-300)).sum())
                low = values[-1]
                out.append((*(row[k] for k in keys), len(values), rank, len(values) - rank, float(np.sqrt(top / low)) if low > within * top else None))
            yield pd.DataFrame(out, columns=[*keys, "n_features", "matrix_rank", "deficiency", "condition"])

    return sums.mapInPandas(run, f"{key_kinds(sums, keys)}, n_features int, matrix_rank int, deficiency int, condition double")


def correlations(sums: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """feature_a, feature_b and r of every pair a < b, by key; null where either has no variance."""
    def run(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                a, n = design(row)[0], row["n"]
                out += [(*(row[k] for k in keys), features[i], features[j], float(a[i, j] / n) if a[i, i] > 0 and a[j, j] > 0 else None) for i in range(len(features)) for j in range(i + 1, len(features))]
            yield pd.DataFrame(out, columns=[*keys, "feature_a", "feature_b", "r"])

    return sums.mapInPandas(run, f"{key_kinds(sums, keys)}, feature_a string, feature_b string, r double")


def nested(rows: DataFrame, sums: DataFrame, coefficients: DataFrame, by: Sequence[str], period: str, features: Sequence[str], target: str, inner: DataFrame, choose: Sequence[str] = ("spec",), all_ranks: bool = True) -> DataFrame:
    """For every fold and value of choose the setting that did best on the fold's inner folds, and what it does on the fold itself.

    inner has by, fold and inner_fold, all before the fold: a fit of an inner fold knows
    nothing later. The mean absolute error decides, then the mean rank correlation, then fewer
    inputs and more shrinkage. Rank correlations are made for settings of the least error only;
    without all_ranks, which a caller who doesn't read inner_spearman can do, only where several have it.
    """
    from .evaluate import tuned
    from .places import spearman

    keys = [*by, "fold"]
    from ..sources.scratch import held

    coefficients = held(coefficients, "coefficients")
    mae = held(errors(rows, coefficients, by, period, features, target), "errors")
    past = inner.join(mae.withColumnRenamed("fold", "inner_fold"), [*by, "inner_fold"]).groupBy(*keys, *SETTING, "n_inputs").agg(F.avg("mae").alias("mae"))
    least = F.min("mae").over(Window.partitionBy(*keys, *choose))
    even = past.withColumn("__least", least).filter(F.col("mae") <= F.col("__least") + 1e-12).drop("__least")
    if not all_ranks:
        several = even.withColumn("__k", F.count("*").over(Window.partitionBy(*keys, *choose))).filter("__k > 1").drop("__k")
    tied = even if all_ranks else several
    among = inner.join(tied.select(*keys, *SETTING), keys).select(*by, F.col("inner_fold").alias("fold"), *SETTING).distinct()
    if not all_ranks and tied.isEmpty():
        ranked = even.withColumn("spearman", F.lit(None).cast("double"))
    else:
        ranks = spearman(scored(rows, coefficients.join(among, [*keys, *SETTING], "left_semi"), by, period, features), [*keys, *SETTING], "predicted", target)
        ranks = inner.join(ranks.select(*by, F.col("fold").alias("inner_fold"), *SETTING, "spearman"), [*by, "inner_fold"]).groupBy(*keys, *SETTING).agg(F.avg("spearman").alias("spearman"))
        ranked = even.join(ranks, [*keys, *SETTING], "left")
    best = tuned(ranked, [*keys, *choose], [F.col("n_inputs"), F.desc("alpha"), F.desc("l1"), F.col("method"), F.col("spec")])
    best = best.select(*keys, *SETTING, F.col("mae").alias("inner_mae"), F.col("spearman").alias("inner_spearman"))
    return best.join(mae.drop("n_inputs"), [*keys, *SETTING])
