"""Joins in time: newest snapshot before a cutoff, validity intervals, folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import first_row


def latest_before(events: DataFrame, keys: Sequence[str], at: str, cutoff: Column, *ties: Column | str) -> DataFrame:
    """The newest row a key strictly before the cutoff."""
    return first_row(events.filter(F.col(at) < cutoff), keys, F.col(at).desc(), *ties)


def snapshot(rows: DataFrame, period: str, taken: str, cutoff: Column) -> DataFrame:
    """All rows of each period's newest snapshot up to its cutoff."""
    before = rows.filter(F.col(taken) <= cutoff)
    newest = before.groupBy(period).agg(F.max(taken).alias("__newest"))
    return before.join(newest, period).filter(F.col(taken) == F.col("__newest")).drop("__newest")


def valid_interval(context: DataFrame, intervals: DataFrame, key: str, period: str, start: str, years: str, best: Sequence[Column]) -> DataFrame:
    """Each context row with the interval that began before its period and lasts through it: the newest, then the first by `best`, ascending.

    Adds n_same_period: intervals that began in the period itself and were left out. An interval
    of start and years lasts through start + years - 1.

    Intervals that a key has of one start and end collapse to the best before any exchange, and
    periods to one question each. Starts and questions of a key then pass in order of time, one
    by one: a stack holds the intervals that may still answer, the newest on top and each
    outlasting those above it. So a key costs its distinct times, not intervals times periods.
    """
    payload = [x for x in intervals.columns if x != key]
    end = (F.col(start) + F.col(years) - 1).cast("long")
    offers = intervals.filter(F.col(start).isNotNull() & F.col(years).isNotNull()).groupBy(key, F.col(start).cast("long").alias("__t"), end.alias("__end")).agg(F.min(F.struct(*(c.alias(f"__b{i}") for i, c in enumerate(best)), F.struct(*payload).alias("row"))).alias("__o"))
    n_same = intervals.groupBy(key, F.col(start).alias(period)).agg(F.count("*").alias("n_same_period"))
    asked = context.select(key, F.col(period).cast("long").alias("__t")).distinct()
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    events = asked.select(key, "__t", F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__end"), none("__o", offers)).unionByName(offers.select(key, "__t", F.lit(1).alias("__kind"), "__end", "__o"))
    # Questions of a time come before its starts; of several starts the best comes last and lies on top.
    swept = events.repartition(key).sortWithinPartitions(key, "__t", "__kind", F.desc("__o")).select(key, "__t", "__kind", "__end", F.col("__o.row").alias("row"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            at, rows = [], []
            for i, (k, t, kind, last) in enumerate(zip(*(batch[c].to_pylist() for c in (key, "__t", "__kind", "__end")), strict=True)):
                if k != now:
                    now, stack = k, []
                if kind:
                    while stack and stack[-1][0] <= last:
                        stack.pop()
                    stack.append((last, batch["row"][i]))
                else:
                    while stack and stack[-1][0] < t:
                        stack.pop()
                    if stack:
                        at.append(i)
                        rows.append(stack[-1][1])
            picked = batch.select([key, "__t"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array([r.as_py() for r in rows], batch.schema.field("row").type)], [key, "__t", "row"])

    kinds = f"`{key}` {context.schema[key].dataType.simpleString()}, `__t` long, row {swept.schema['row'].dataType.simpleString()}"
    found = swept.filter(F.col(key).isNotNull()).mapInArrow(sweep, kinds).select(key, F.col("__t").alias(period), *(F.col(f"row.{x}").alias(x) for x in payload))
    return context.join(n_same, [key, period], "left").withColumn("n_same_period", F.coalesce("n_same_period", F.lit(0))).join(found, [key, period], "left")
