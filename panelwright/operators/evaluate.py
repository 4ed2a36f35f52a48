"""Metrics, comparisons, intervals and decisions over tables of predictions.

A predictions table has segment, period, entity, actual and one or more predictions.
Everything is grouped aggregation over ranked rows; bootstraps run on sums by period, or on sums by replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..functions.ranks import correlation
from .places import Rank, with_ranks


def diagnosed(rows: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Errors and average ranks of actual and predicted values within each group."""
    error = F.col(predicted) - F.col(actual)
    with_errors = rows.withColumns({"signed_error": error, "absolute_error": F.abs(error)})
    return with_ranks(with_errors, by, {"actual_rank": Rank(actual, descending=True), "predicted_rank": Rank(predicted, descending=True)})


def metrics(ranked: DataFrame, by: Sequence[str], top: int, actual: str = "actual") -> DataFrame:
    """n, mae, rmse, r2, spearman, rank_mae and top-n overlap by group of diagnosed rows."""
    a, e = F.col(actual), F.col("signed_error")
    both = F.count_if((F.col("actual_rank") <= top) & (F.col("predicted_rank") <= top))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(a))).alias("r2"),
        correlation("actual_rank", "predicted_rank").alias("spearman"),
        F.avg(F.abs(F.col("actual_rank") - F.col("predicted_rank"))).alias("rank_mae"),
        F.try_divide(both, F.least(F.lit(top), F.count("*"))).alias("top_overlap"),
    )


def pooled_and_mean(fold_metrics: DataFrame, pooled: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics over all rows beside the means of the folds' metrics."""
    means = fold_metrics.groupBy(*by).agg(*(F.avg(x).alias(f"mean_{x}") for x in names), F.count("*").alias("n_folds"))
    return pooled.join(means, list(by))


def paired(rows: DataFrame, by: Sequence[str], period: str, candidate: str, reference: str, actual: str = "actual") -> DataFrame:
    """Candidate against reference on the same rows: both errors, improvement, and periods won, tied and lost."""
    both = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    ce, re_ = F.abs(F.col(candidate) - F.col(actual)), F.abs(F.col(reference) - F.col(actual))
    per = both.groupBy(*by, period).agg(F.count("*").alias("n"), F.sum(ce).alias("ce"), F.sum(re_).alias("re"))
    gain = (F.col("re") - F.col("ce")) / F.col("n")
    return per.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("ce"), F.sum("n")).alias("candidate_mae"),
        F.try_divide(F.sum("re"), F.sum("n")).alias("reference_mae"),
        F.try_divide(F.sum("re") - F.sum("ce"), F.sum("n")).alias("improvement"),
        F.count_if(gain > 1e-12).alias("wins"), F.count_if(F.abs(gain) <= 1e-12).alias("ties"), F.count_if(gain < -1e-12).alias("losses"),
    )


def leave_one_out(per: DataFrame, by: Sequence[str], gain: str, n: str) -> DataFrame:
    """Mean gain without each period, and the period's share of the whole gain. per has a row a period."""
    w = Window.partitionBy(*by)
    total, rows = F.sum(gain).over(w), F.sum(n).over(w)
    return per.withColumn("gain_without", F.try_divide(total - F.col(gain), rows - F.col(n))).withColumn("gain_share", F.when(total > 0, F.col(gain) / total))


def draw(replicate: Column, position: Column, n: Column, seed: int) -> Column:
    """A place from 1 to n that depends on its arguments only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), position.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), n) + 1


def block_bootstrap(per: DataFrame, by: Sequence[str], period: str, total: str, n: str, replicates: int, seed: int = 446) -> DataFrame:
    """95% intervals of a mean from resampled periods: pooled (rows of the drawn periods) and of period means.

    per has a row a period with the sum and the number of rows, so a replicate costs as
    many rows as there are periods. The draws are hashes: they don't depend on partitions.
    """
    w = Window.partitionBy(*by)
    placed = per.withColumn("__i", F.row_number().over(w.orderBy(period)).cast("long")).withColumn("__n", F.count("*").over(w))
    drawn = placed.select(*by, F.col("__i").alias("__position"), "__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("__i", draw(F.col("replicate"), F.col("__position"), F.col("__n"), seed))
    sums = drawn.join(placed.drop("__n"), [*by, "__i"]).groupBy(*by, "replicate").agg(
        F.try_divide(F.sum(total), F.sum(n)).alias("pooled"), F.avg(F.col(total) / F.col(n)).alias("of_means")
    )
    q = lambda x, p: F.percentile(x, F.lit(p))
    return sums.groupBy(*by).agg(
        q("pooled", 0.025).alias("pooled_low"), q("pooled", 0.975).alias("pooled_high"), q("of_means", 0.025).alias("means_low"), q("of_means", 0.975).alias("means_high")
    )


#: Rows of a task that meet all replicates at a time, and groups whose sums it holds.
BOOT_ROWS, BOOT_GROUPS = 16, 256
#: The field of the draws, and the places where a Poisson(1) count goes up.
FIELD = 2**31 - 1
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))


def least_above(cut: float) -> int:
    """The smallest x of the field with (x + 0.5) / FIELD above the cut."""
    x = max(0, int(cut * FIELD) - 4)
    while (x + 0.5) / FIELD <= cut:
        x += 1
    return x


#: POISSON in places of the field.
STEPS = tuple(least_above(c) for c in POISSON)


def reduced(x: np.ndarray, work: np.ndarray) -> None:
    """x, from 0 to 2^63 - 1, to something below 2^32 that is the same in the field of 2^31 - 1: its low 31 bits plus the rest, as 2^31 is 1 there."""
    np.right_shift(x, 31, out=work)
    np.bitwise_and(x, FIELD, out=x)
    np.add(x, work, out=x)


def poisson_draws(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row (a key from 0 to FIELD - 1) is in each replicate: hashes of key, replicate and seed in 64-bit integers, which any engine can repeat."""
    r, k = np.arange(1, replicates + 1, dtype=np.int64), keys[:, None]
    x = k * (r * 48271 % FIELD)
    x += r * 16807 + seed
    work = np.empty_like(x)
    reduced(x, work)
    reduced(x, work)  # at most FIELD + 2 from here on, so that a square fits
    for more in (r, k):
        np.multiply(x, x, out=x)
        np.add(x, more, out=x)
        reduced(x, work)
        reduced(x, work)
    x = x.astype(np.uint32)
    np.minimum(x, x - np.uint32(FIELD), out=x)  # wraps round below FIELD, so the lesser one is the rest
    out = np.zeros(x.shape, np.int8)
    for step in STEPS:
        out += x >= np.uint32(step) if step < FIELD else False
    return out


def row_bootstrap(rows: DataFrame, by: Sequence[str], key: str, value: str, replicates: int = 5000, seed: int = 446) -> DataFrame:
    """by, n, low and high: 95% interval of a mean from Poisson(1) row weights.

    The draws are hashes of a row's key, from 0 to 2^31 - 2, so that a rerun agrees. A task holds
    two sums a replicate and group and meets its rows in blocks; rows are never repeated.
    """
    cols = [*by, "__n", "__weights", "__sums"]
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for name, part in batch.groupby(list(by), dropna=False, sort=False):
                sums = held.setdefault(name, [0, np.zeros(replicates), np.zeros(replicates)])
                keys, values = part[key].to_numpy(np.int64), part[value].to_numpy(float)
                for at in range(0, len(part), BOOT_ROWS):
                    w = poisson_draws(keys[at : at + BOOT_ROWS], replicates, seed).astype(float)
                    both = np.stack([np.ones(len(w)), values[at : at + BOOT_ROWS]]) @ w
                    sums[0], sums[1], sums[2] = sums[0] + len(w), sums[1] + both[0], sums[2] + both[1]
            if len(held) > BOOT_GROUPS:
                yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=cols)
                held = {}
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=cols)

    known = rows.select(*by, F.col(key).cast("long").alias(key), F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    parts = known.mapInPandas(run, f"{kinds}, __n long, __weights array<double>, __sums array<double>")
    each = parts.select(*by, "__n", F.posexplode(F.arrays_zip("__weights", "__sums")).alias("replicate", "__e"))
    means = each.groupBy(*by, "replicate").agg(F.sum("__n").alias("__n"), F.try_divide(F.sum("__e.__sums"), F.sum("__e.__weights")).alias("m"))
    return means.groupBy(*by).agg(F.max("__n").alias("n"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def slices(rows: DataFrame, by: Sequence[str], dimensions: Sequence[str], error: str, reference_error: str, signed: str) -> DataFrame:
    """n, both errors, improvement, share of improved rows and bias by slice and value. One aggregation for all slices."""
    long = rows.unpivot([*by, error, reference_error, signed], list(dimensions), "slice", "value")
    return long.groupBy(*by, "slice", "value").agg(
        F.count("*").alias("n"), F.avg(error).alias("mae"), F.avg(reference_error).alias("reference_mae"),
        F.avg(F.col(reference_error) - F.col(error)).alias("improvement"),
        F.avg((F.col(error) < F.col(reference_error)).cast("double")).alias("improved_rate"), F.avg(signed).alias("bias"),
    )


def top_status(actual_rank: Column | str, predicted_rank: Column | str, top: int) -> Column:
    a, p = c(actual_rank) <= top, c(predicted_rank) <= top
    return F.when(a & p, "correct").when(p, "false_in").when(a, "missed").otherwise("outside")


def stability(coefficients: DataFrame, by: Sequence[str], order: str, value: str = "coefficient") -> DataFrame:
    """mean, deviation, extremes, changes of sign between successive non-zero folds with their rate, and an unstable flag.

    Unstable: a quarter of the successive pairs change sign, or the deviation is above the mean's size.
    """
    sign = F.signum(value)
    before = F.lag("__sign").over(Window.partitionBy(*by).orderBy(order))
    changes = coefficients.filter(F.col(value) != 0).withColumn("__sign", sign).withColumn("__before", before).groupBy(*by).agg(F.count_if(F.col("__sign") != F.col("__before")).alias("sign_changes"), F.count("__before").alias("__pairs"))
    spread = coefficients.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = spread.join(changes, list(by), "left").withColumn("sign_changes", F.coalesce("sign_changes", F.lit(0)))
    out = out.withColumn("change_rate", F.coalesce(F.try_divide("sign_changes", "__pairs"), F.lit(0.0))).drop("__pairs")
    return out.withColumn("unstable", (F.col("change_rate") >= 0.25) | (F.coalesce("std", F.lit(0.0)) > F.abs("mean")))


def auc(rows: DataFrame, by: Sequence[str], label: str, probability: str) -> DataFrame:
    """Area under the ROC curve from average ranks, and Brier score, by group; null for a single class."""
    ranked = with_ranks(rows.select(*by, label, probability), by, {"__rank": Rank(probability)})
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    area = F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("__rank"))) - pos * (pos + 1) / 2, pos * neg)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), area.alias("auc"), F.avg(F.pow(F.col(probability) - F.col(label), 2)).alias("brier"))


def decided(rows: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str, name: str = "decision") -> DataFrame:
    """The first rule that holds; unknown counts as not holding."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for label, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(label))
    return rows.withColumn(name, out.otherwise(otherwise))


# Fixed values of the rule sets below: least gains and periods, and how much ranking or bias may lose.
def adaptive_rules() -> list[tuple[str, Column]]:
    """Accept with a full rank, a gain that most periods or the interval back, and no loss in ranking."""
    gain = F.col("improvement") > 0
    backed = (F.col("wins") >= 8) | (F.col("low") > 0)
    safe = (F.col("spearman_change") >= -0.01) & (F.col("overlap_change") >= -0.02) & (F.col("largest_share") <= 0.5)
    return [("ACCEPT", F.col("full_rank") & gain & backed & safe), ("PROMISING_NOT_CONFIRMED", gain)]


def promotion_rules() -> list[tuple[str, Column]]:
    """Promote with a gain, a positive interval, half the periods, and neither ranking nor tier bias worse."""
    return [(
        "PROMOTE",
        (F.col("improvement") > 0) & (F.col("low") > 0) & (F.col("wins") >= F.ceil(F.col("n_folds") / 2)) & (F.col("spearman_change") >= 0) & (F.col("low_bias_change") <= 0) & (F.col("high_bias_change") >= 0),
    )]


def tree_rules() -> list[tuple[str, Column]]:
    return [("PROMOTE", (F.col("improvement") > 0) & (F.col("wins") >= F.ceil(F.col("n_folds") / 2)) & (F.col("spearman_change") >= -0.005))]


def role_rules() -> list[tuple[str, Column]]:
    backed = (F.col("improvement") > 0) & (F.col("low") > 0)
    return [("ADVANCE", backed & (F.col("n_folds") >= 7)), ("PROMISING_LIMITED_HISTORY", backed)]


def screen_rules() -> list[tuple[str, Column]]:
    return [("PASS", (F.col("improvement") >= 0.005) & (F.col("spearman_change") >= -0.005) & (F.col("low_bias_change") <= 0.02) & (F.col("high_bias_change") >= -0.05))]


def success_rules() -> list[tuple[str, Column]]:
    gain = F.col("improvement")
    return [
        ("Successful", (gain > 0) & (F.col("wins") > F.col("losses")) & (F.col("spearman_change") >= 0)),
        ("Unsuccessful", (gain < 0) & (F.col("losses") > F.col("wins"))),
    ]


def tuned(scores: DataFrame, keys: Sequence[str], simplicity: Sequence[Column]) -> DataFrame:
    """The best setting a key: lowest mean error, highest mean rank correlation, then the simplest."""
    order = Window.partitionBy(*keys).orderBy("mae", F.col("spearman").desc_nulls_last(), *simplicity)
    return scores.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def selected(predictions: DataFrame, keys: Sequence[str], model: str, name: str) -> DataFrame:
    """One model's rows of a long table, keys and prediction, renamed."""
    return predictions.filter(F.col("model") == model).select(*keys, F.col("predicted").alias(name))


def pairing_audit(predictions: DataFrame, keys: Sequence[str], by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """By group of a long table: entities, those that lack a model or have one twice, and predictions that aren't finite numbers."""
    p = F.col("predicted")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    per = predictions.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count("*").alias("rows"), F.count_distinct("model").alias("models"), F.count_if(~finite).alias("bad"))
    return per.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("models") < len(models)).alias("n_unpaired"), F.count_if(F.col("rows") > F.col("models")).alias("n_repeated"), F.sum("bad").alias("n_not_finite")
    )


def present(tables: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """keys with a column a table: its value; and the bitsets __in (which tables, the first being 1, have the key) and __finite (where its value is a finite number).

    All tables meet in one aggregation of a tagged union, however many they are; each has a key once.
    """
    long = None
    for i, (name, t) in enumerate(tables.items()):
        v = F.col(value).cast("double")
        fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        one = t.select(*keys, F.lit(1 << i).cast("long").alias("__bit"), F.when(fine, F.lit(1 << i)).otherwise(F.lit(0)).cast("long").alias("__fine"), *(v.alias(x) if x == name else F.lit(None).cast("double").alias(x) for x in tables))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(*keys).agg(F.bit_or("__bit").alias("__in"), F.bit_or("__fine").alias("__finite"), *(F.max(x).alias(x) for x in tables))


def same_cohort(tables: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """keys and a column a model, of the keys for which every model has a finite value."""
    return present(tables, keys, value).filter(F.col("__finite") == (1 << len(tables)) - 1).drop("__in", "__finite")
