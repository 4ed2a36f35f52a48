"""Contracts on tables and joins: what must hold, checked by one aggregate each."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import compact_key


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class TableContract:
    """Columns by meaning, keys, and the periods and segments that must be there."""

    columns: Mapping[str, str]
    keys: Sequence[str] = ()
    periods: Sequence[int] = ()
    segments: Sequence[str] = ()
    period_col: str = "period"
    segment_col: str = "segment"
    forbidden: Sequence[str] = field(default_factory=tuple)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with columns renamed to their meaning, looked up without regard to case."""
        have = {x.lower(): x for x in df.columns}
        missing = sorted(x for x in self.columns.values() if x.lower() not in have)
        if missing:
            raise ContractError(f"missing columns: {', '.join(missing)}")
        found = sorted(x for x in self.forbidden if x.lower() in have)
        if found:
            raise ContractError(f"forbidden columns: {', '.join(found)}")
        return df.select(*(F.col(have[physical.lower()]).alias(name) for name, physical in self.columns.items()))

    def gaps(self, df: DataFrame) -> DataFrame:
        """kind and value of every required column, period or segment that df lacks, and a row of kind rows if it is empty."""
        spark = df.sparkSession
        have = {x.lower() for x in df.columns}
        lacking = [("column", x) for x in self.columns.values() if x.lower() not in have] + ([("rows", "none")] if df.isEmpty() else [])
        out = spark.createDataFrame(lacking, "kind string, value string")
        for kind, col, wanted in (("period", self.period_col, self.periods), ("segment", self.segment_col, self.segments)):
            if wanted:
                need = spark.createDataFrame([(str(x),) for x in wanted], "value string")
                out = out.union(need.join(df.select(F.col(col).cast("string").alias("value")).distinct(), "value", "left_anti").select(F.lit(kind), "value"))
        return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"{', '.join(keys)} is not a key")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join that keeps the number of rows of left: right's key must be unique."""
    return left.join(assert_unique(right, on), list(on), how)


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], status: str = "status") -> DataFrame:
    """Full outer join with a column that says both, left_only or right_only."""
    a, b = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    label = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, list(on), "full").withColumn(status, label).drop("__l", "__r")


def overridden(base: DataFrame, override: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with override's rows in place of its own of the same keys."""
    return base.join(override.select(*keys).distinct(), list(keys), "left_anti").unionByName(override)


def preferred(base: DataFrame, corrected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """base with corrected's value where there is one."""
    better = corrected.select(*keys, F.col(value).alias("__better"))
    return base.join(better, list(keys), "left").withColumn(value, F.coalesce("__better", value)).drop("__better")


def without(df: DataFrame, flagged: DataFrame, keys: Sequence[str], segment: str) -> tuple[DataFrame, DataFrame]:
    """df without the flagged keys, and rows before, removed and after by segment."""
    marked = df.join(flagged.select(*keys).distinct().withColumn("__flag", F.lit(1)), list(keys), "left")
    kept = marked.filter("__flag is null").drop("__flag")
    audit = marked.groupBy(segment).agg(F.count("*").alias("n_before"), F.count("__flag").alias("n_removed"), (F.count("*") - F.count("__flag")).alias("n_after"))
    return kept, audit


@dataclass(frozen=True)
class Check:
    """A data-quality check: rows where `bad` holds are affected."""

    category: str
    name: str
    bad: Column
    severity: str = "error"


def findings(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """One row a check: category, check_name, severity, status, affected, total, rate. One pass."""
    checks = list(checks)
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(x.bad).alias(f"c{i}") for i, x in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(x.category).alias("category"), F.lit(x.name).alias("check_name"), F.lit(x.severity).alias("severity"), F.col(f"c{i}").alias("affected"), F.col("total")) for i, x in enumerate(checks)))
    return counts.select(F.inline(rows)).select(
        "category", "check_name", "severity",
        F.when(F.col("affected") == 0, "pass").otherwise("fail").alias("status"),
        "affected", "total", F.try_divide("affected", "total").alias("rate"),
    )


def without_boundary(df: DataFrame, period: str, first: int, segment: str) -> tuple[DataFrame, DataFrame]:
    """df without its periods up to first, which remain as history only, and rows before, removed and after by segment."""
    kept = F.col(period) > first
    audit = df.groupBy(segment).agg(F.count("*").alias("n_before"), F.count_if(~kept).alias("n_removed"), F.count_if(kept).alias("n_after"))
    return df.filter(kept), audit


def browsed(df: DataFrame, equal: Mapping[str, object], name: str, part: str) -> DataFrame:
    """Rows of the given values whose name contains part, without regard to case."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df.filter(F.lower(name).contains(part.lower()))


def assert_inputs(features: Iterable[str], forbidden: Iterable[str]) -> None:
    """ContractError if a model would read what it may not know."""
    found = sorted(set(features) & set(forbidden))
    if found:
        raise ContractError(f"forbidden inputs: {', '.join(found)}")


def input_audit(df: DataFrame, features: Sequence[str], forbidden: Sequence[str], first: Column) -> DataFrame:
    """feature, forbidden and n_first: how many rows without a past have a value."""
    counts = df.agg(*(F.count(F.when(first, F.col(x))).alias(x) for x in features)).unpivot([], list(features), "feature", "n_first")
    return counts.withColumn("forbidden", F.col("feature").isin(*forbidden))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which every row of either side has exactly one partner; ContractError otherwise."""
    a, b = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    sides = a.select(*keys, "__l", F.lit(0).alias("__r")).unionByName(b.select(*keys, F.lit(0).alias("__l"), "__r"))
    if not sides.groupBy(*keys).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r")).filter("l != 1 or r != 1").isEmpty():
        raise ContractError(f"{', '.join(keys)} doesn't pair the rows one to one")
    return left.join(right, list(keys))


def group_counts(df: DataFrame, period: str, group: str, wanted: int, *more: Column) -> DataFrame:
    """Groups and rows a period, and whether there is one row for each of the wanted groups."""
    n, rows = F.count_distinct(group), F.count("*")
    return df.groupBy(period).agg(n.alias("n_groups"), rows.alias("n_rows"), ((n == wanted) & (rows == wanted)).alias("complete"), *more)


def name_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, on: Sequence[str] = ()) -> DataFrame:
    """Left join by normalised names within the columns on; a key that two rows of a side share is a ContractError."""
    key = [*on, "__key"]
    a = assert_unique(left.withColumn("__key", compact_key(left_name)), key)
    b = assert_unique(right.withColumn("__key", compact_key(right_name)).drop(right_name), key)
    return a.join(b, key, "left").drop("__key")


def ranking_audit(df: DataFrame, by: Sequence[str], rank: str, size: str, score: str) -> DataFrame:
    """n, missing entities of the full size, ranks out of bounds, ties, and scores (1 best, 0 last) that don't follow from the rank."""
    r, n = F.col(rank), F.col(size)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (F.max(n) - F.count("*")).alias("n_missing"), F.count_if((r < 1) | (r > n)).alias("n_out"), (F.count("*") - F.count_distinct(r)).alias("n_tied"),
        F.count_if(F.abs(1 + (1 - F.col(score)) * (n - 1) - r) > 1e-9).alias("n_inconsistent"), F.count_if(F.col(score).isNull()).alias("n_without_score"),
    )


def key_findings(df: DataFrame, key: str, segment: str) -> DataFrame:
    """check_name and affected: rows without a key, keys of several rows, keys of several segments."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(segment).alias("kinds"))
    counts = per.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("missing_key"),
        F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("duplicate_key"), F.count_if(F.col(key).isNotNull() & (F.col("kinds") > 1)).alias("segment_mismatch"),
    )
    return counts.unpivot([], ["missing_key", "duplicate_key", "segment_mismatch"], "check_name", "affected")


def assembled(base: DataFrame, sources: Mapping[str, DataFrame], keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """base with the columns of every source, one row a key each, and n_<source>, 1 where the source has the key.

    All tables meet in one exchange, as a tagged union that is collapsed by key, however many
    they are. A key that base or a source has twice fails the job. With parts the exchange has so
    many partitions, and rows are sorted behind it only.
    """
    tables = {"base": base, **sources}
    columns = {name: [c for c in t.columns if c not in keys] for name, t in tables.items()}
    kinds = {c: t.schema[c].dataType for name, t in tables.items() for c in columns[name]}
    if len(kinds) != sum(map(len, columns.values())):
        raise ContractError("two tables share a column that is no key")
    long = None
    for i, (name, t) in enumerate(tables.items()):
        one = t.select(*keys, F.lit(i).alias("__of"), *(F.col(c) if c in columns[name] else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
        long = one if long is None else long.unionByName(one)
    long = long.repartition(parts, *keys) if parts else long
    counts = [F.count_if(F.col("__of") == i).alias(f"n_{name}") for i, name in enumerate(tables)]
    met = long.groupBy(*keys).agg(*counts, *(F.max(c).alias(c) for c in kinds)).filter("n_base > 0")
    twice = F.greatest(*(F.col(f"n_{name}") for name in tables)) > 1
    sure = F.when(twice, F.raise_error(F.lit("a key has several rows in a table")).cast("long")).otherwise(F.col("n_base"))
    return met.withColumn("n_base", sure).filter("n_base = 1").drop("n_base")


def group_coverage(df: DataFrame, by: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """by, feature_group, n, n_complete, n_any, any_rate and omitted features, in one pass; a feature that df lacks is named there and is complete nowhere."""
    has = {g: [f for f in features if f in df.columns] for g, features in groups.items()}
    every = lambda fs: F.count_if(reduce(Column.__and__, (F.col(f).isNotNull() for f in fs))) if fs else F.lit(0).cast("long")
    some = lambda fs: F.count_if(reduce(Column.__or__, (F.col(f).isNotNull() for f in fs))) if fs else F.lit(0).cast("long")
    rows = [
        F.struct(F.lit(g).alias("feature_group"), F.col("n"), F.col(f"__c{i}").alias("n_complete"), F.col(f"__a{i}").alias("n_any"), F.lit(",".join(f for f in features if f not in df.columns)).alias("omitted"))
        for i, (g, features) in enumerate(groups.items())
    ]
    aggs = [x for i, (g, features) in enumerate(groups.items()) for x in (every(has[g] if len(has[g]) == len(features) else []).alias(f"__c{i}"), some(has[g]).alias(f"__a{i}"))]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *aggs).select(*by, F.inline(F.array(*rows)))
    return out.withColumn("any_rate", F.try_divide("n_any", "n"))


def leader_audit(projected: DataFrame, realised: DataFrame, group: str, period: str, entity: str, n_groups: int) -> DataFrame:
    """By period: groups with a projected leader, groups without, groups with several, how many have a realised leader and where that is another (the smallest projected counts)."""
    one = projected.groupBy(period, group).agg(F.count("*").alias("__k"), F.min(entity).alias("__projected"))
    both = one.join(realised.select(group, period, F.col(entity).alias("__realised")), [group, period], "left")
    return both.groupBy(period).agg(
        F.count("*").alias("n_groups"), (F.lit(n_groups) - F.count("*")).alias("n_missing"), F.count_if(F.col("__k") > 1).alias("n_duplicate"),
        F.count("__realised").alias("n_realised"), F.count_if(F.col("__realised") != F.col("__projected")).alias("n_differ"),
    )
