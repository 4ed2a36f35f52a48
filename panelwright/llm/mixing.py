"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each row gets a key that is uniform and depends on its id only. Uniform keys need no
sampling to be range-sorted: the top bits of the key are the range, so each source is
cut into `ranges` even ranges. Words are summed by (source, range), a running sum over
those few totals gives every range its offset, and a window inside each range finishes
the prefix sum. A source that holds a third of all rows is thus spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_scan, row_number, text_of, unused, written

#: Bits of the key, and of them how many choose the range.
KEY_BITS, RANGE_BITS = 60, 10
#: Weights of the sources in order, repeating; and how often a document may be taken.
WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key(id_col: Column) -> Column:
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source_no, source_size -> target: shares by weight, at most `most` times a source.

    sizes has one row a source, numbered from 0 in order. Sorted by cap over weight, a
    source is capped when the level that the rest would get is above its own; what the
    capped ones leave is shared by weight among the others. The table is as long as
    there are sources, so a window without keys is bounded.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.col("capped")
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("capped", (F.col("all_words") - F.col("cap_before")).cast("double") * F.col("w") >= F.col("cap").cast("double") * (F.col("all_w") - F.col("w_before")))
        .withColumn("cap_sum", F.coalesce(F.sum(F.when(capped, F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("w_sum", F.coalesce(F.sum(F.when(capped, F.col("w"))).over(everything), F.lit(0)))
        .select(
            "source_no", "source", "source_size",
            F.when(capped, F.col("cap").cast("double"))
            .otherwise(F.try_divide((F.col("all_words") - F.col("cap_sum")).cast("double") * F.col("w"), (F.col("all_w") - F.col("w_sum")).cast("double")))
            .alias("target"),
        )
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a document: row, id, size, source_no, source_size, target and taken.

    taken is in words: whole epochs of the source, then, in key order, whole documents
    up to the exact budget; the document at the cut gives the rest of the budget. Null
    and empty texts have size 0 and give nothing; a null source is one source, ordered
    last; a source without words has target 0. Rows of one id share a key and are taken
    by size, so a rerun agrees. An empty table gives an empty result.
    """
    docs = as_scan(docs)
    rows = written(
        docs.select(
            row_number(docs).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words_in(text_of(text_col)).alias("size"),
            hash_key(F.col(id_col)).alias("key"),
        ),
        "sizes",
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1), weights, most)
    plan = written(plan, "targets")
    ranged = rows.withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS)).alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).drop("source")
    starts = (
        ranged.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
        .select("source_no", "range", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("source_no", "range").orderBy("key", F.col("id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    return (
        ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_no", "range"])
        .withColumn("before", F.col("start") + F.col("inside"))
        .select(
            "row", "id", "size", "source_no", "source_size", "target",
            (epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left - F.col("before")))).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, rounded to whole documents.

    A document at a cut stays whole if at least half of it fits; one of size 0 goes.
    """
    docs = as_scan(docs)
    copies = F.expr("cast((2 * taken + size) div (2 * size) as int)")
    row, copies_, copy = (unused(docs, x) for x in ("__row", "__copies", "__copy"))
    chosen = mix(docs, id_col, text_col, source_col).filter("size > 0").select(F.col("row").alias(row), copies.alias(copies_)).filter(F.col(copies_) > 0)
    kept = docs.withColumn(row, row_number(docs)).join(chosen, row)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_)))).select(*docs.columns)
