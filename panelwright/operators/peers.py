"""Shares of a group, pools of competitors, rooms and what leaves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ranks import first_rank, known_sum, lowest_rank, others_total, total_of, with_others_max


def matched_share(rows: DataFrame, totals: DataFrame, at: Sequence[str], keys: Sequence[str], value: str, name: str) -> DataFrame:
    """An entity's sum over its groups' sums in the same sub-periods, so that a move in between counts right."""
    both = rows.join(totals.select(*at, F.col(value).alias("__total")), list(at))
    return both.groupBy(*keys).agg(known_sum(value).alias(value), known_sum("__total").alias("__total")).withColumn(name, ratio(value, "__total")).drop("__total")


def pool(focal: DataFrame, on: Sequence[str], entity: str, carry: Sequence[str], allowed: Column | None = None) -> DataFrame:
    """Every entity with each other one of its group, renamed other_*; allowed is a condition on both."""
    other = focal.select(*on, *(F.col(x).alias(f"other_{x}") for x in (entity, *carry)))
    both = focal.join(other, list(on)).filter(F.col(entity) != F.col(f"other_{entity}"))
    return both.filter(allowed) if allowed is not None else both


def masked(rows: DataFrame, on: Sequence[str], entity: str, value: str, mask: Column, name: str) -> DataFrame:
    """rows with name_max and n_name: the largest value and the number of the group's other rows for which mask holds. No pairs."""
    inside = F.coalesce(mask, F.lit(False))
    marked = rows.withColumn("__v", F.when(inside, F.col(value))).withColumn("__in", inside.cast("long"))
    out = with_others_max(marked, "__v", on, entity, f"{name}_max")
    return out.withColumn(f"n_{name}", total_of("__in", on) - F.col("__in")).drop("__v", "__in")


def pool_audit(members: DataFrame, on: Sequence[str], entity: str, place: str, value: str) -> DataFrame:
    """n, n_repeated, n_gaps (in places) and n_tied of every pool."""
    n = F.count("*")
    return members.groupBy(*on).agg(n.alias("n"), (n - F.count_distinct(entity)).alias("n_repeated"), (F.max(place) - F.count_distinct(place)).alias("n_gaps"), (n - F.count_distinct(value)).alias("n_tied"))


def pool_faults(focal: DataFrame, listed: DataFrame, keys: Sequence[str], by: Sequence[str], competitor: str, place: str, wrong: Column) -> DataFrame:
    """By `by`: focal rows, listed competitors, those that are the focal entity (the last key) itself, of a wrong type, repeated; lists whose ranks are not 1 to n; focal rows without a list."""
    n = F.count("*")
    lists = listed.groupBy(*keys).agg(
        n.alias("__n"), F.count_if(F.col(competitor) == F.col(keys[-1])).alias("__self"), F.count_if(wrong).alias("__wrong"), (n - F.size(F.collect_set(competitor))).alias("__repeated"),
        ((F.min(place) != 1) | (F.max(place) != n) | (F.size(F.collect_set(place)) != n)).alias("__bad"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return focal.join(lists, list(keys), "left").groupBy(*by).agg(
        F.count("*").alias("n_focal"), total("__n", "n_rows"), total("__self", "n_self"), total("__wrong", "n_wrong_type"), total("__repeated", "n_repeated"),
        F.count_if("__bad").alias("n_bad_ranks"), F.count_if(F.col("__n").isNull()).alias("n_without_pool"),
    )


def top_two(members: DataFrame, on: Sequence[str], entity: str, value: str) -> DataFrame:
    """A group's two largest side by side, its size and how many have no value."""
    placed = members.withColumn("__place", first_rank(value, on, [entity]))
    best = lambda i, x: F.max(F.when(F.col("__place") == i, F.col(x)))
    return placed.groupBy(*on).agg(
        F.count("*").alias("pool_size"), F.count_if(F.col(value).isNull()).alias("n_unknown"),
        best(1, entity).alias("first_entity"), best(1, value).alias("first_value"),
        best(2, entity).alias("second_entity"), best(2, value).alias("second_value"),
    )


def room(rows: DataFrame, on: Sequence[str], entity: str, value: str) -> DataFrame:
    """count, known total, others' total, share, rank, others' maximum and the ratio to it. No self-join."""
    out = (
        rows.withColumn("room_count", total_of(F.lit(1), on))
        .withColumn("room_total", total_of(value, on))
        .withColumn("others_total", others_total(value, on))
        .withColumn("room_share", ratio(value, "room_total"))
        .withColumn("room_rank", lowest_rank(value, on))
    )
    return with_others_max(out, value, on, entity, "others_max").withColumn("to_others_max", ratio(value, "others_max"))


def effective(rows: DataFrame, on: Sequence[str], entity: str, probability: str, load: str) -> DataFrame:
    """rows with what the others of their group are: n_others, n_known, n_unknown, effective and burden (sums of probability and of probability * load), best, max_load, sum_load and n_ahead (of a higher probability)."""
    p, q = F.col(probability), F.col(load)
    w = Window.partitionBy(*on)
    rest = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0.0)) - F.coalesce(x, F.lit(0.0))
    out = with_others_max(with_others_max(rows, probability, on, entity, "best"), load, on, entity, "max_load")
    out = out.withColumn("n_others", total_of(F.lit(1), on) - 1).withColumn("n_known", F.count(p).over(w) - p.isNotNull().cast("int"))
    ahead = F.when(p.isNotNull(), F.rank().over(w.orderBy(p.desc_nulls_last())) - 1).otherwise(0)
    alone = F.col("n_others") == 0
    return out.withColumns({
        "n_unknown": F.col("n_others") - F.col("n_known"), "effective": F.when(F.col("n_known") == 0, 0.0).otherwise(rest(p)), "burden": F.when(F.col("n_known") == 0, 0.0).otherwise(rest(p * q)),
        "sum_load": F.when(~alone, others_total(load, on)), "n_ahead": ahead,
    })


def vacated(prior: DataFrame, present: DataFrame, group: Sequence[str], entity: str, value: str) -> DataFrame:
    """A group's share of prior measures that belongs to entities which are no longer in it."""
    here = present.select(*group, entity).distinct().withColumn("__here", F.lit(1))
    marked = prior.join(here, [*group, entity], "left")
    return marked.groupBy(*group).agg(
        known_sum(F.when(F.col("__here").isNull(), F.col(value))).alias("vacated"), known_sum(value).alias("prior_total")
    ).withColumn("vacated_share", ratio("vacated", "prior_total"))


def participation(plays: DataFrame, occurrence: str, group: str, members: Column, by: Sequence[str]) -> DataFrame:
    """Rate of the group's plays with an entity on the field, over the occurrences where it appeared."""
    each = plays.select(occurrence, group, *by, F.explode(members).alias("member"))
    per = each.groupBy(occurrence, group, *by, "member").agg(F.count("*").alias("on_field"))
    total = plays.groupBy(occurrence, group).agg(F.count("*").alias("plays"))
    return per.join(total, [occurrence, group]).groupBy(*by, "member").agg(F.sum("on_field").alias("on_field"), F.sum("plays").alias("plays")).withColumn("rate", ratio("on_field", "plays"))
