"""Group shares, pools, rooms and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions.exprs import flag, ratio
from ..operators import peers
from ..operators.medians import with_medians
from .base import PANEL, STATS, Query, held, panel, registered, scan, stats

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"""WITH {STATS}, t AS (SELECT grp, period, sub, sum(qty)::BIGINT AS total FROM stats GROUP BY ALL) SELECT entity, s.period, sum(qty)::BIGINT AS qty, round(sum(qty) / sum(total)::DOUBLE, 6) AS share FROM stats s JOIN t USING (grp, period, sub) GROUP BY entity, s.period""")
def d9_matched_share(spark, d):
    """An entity's share of its group, matched by sub-period."""
    s = stats(spark, d)
    t = s.groupBy("grp", "period", "sub").agg(F.sum("qty").alias("qty"))
    return peers.matched_share(s.select("entity", "grp", "period", "sub", "qty"), t, ["grp", "period", "sub"], ["entity", "period"], "qty", "share").withColumn("share", F.round("share", 6))


@query(f"""WITH {STATS} SELECT grp, period + 1 AS period, count(*) AS n, round(sum(qty) / count(DISTINCT sub)::DOUBLE, 6) AS qty_per_sub, CASE WHEN sum(price) > 0 THEN round(sum(disc) / sum(price)::DOUBLE, 6) END AS disc_rate FROM stats GROUP BY grp, period""")
def d8_group_environment(spark, d):
    """Rates of the group in the period before."""
    g = stats(spark, d).groupBy("grp", "period").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.count_distinct("sub").alias("subs"), F.sum("disc").alias("disc"), F.sum("price").alias("price"))
    return g.select("grp", (F.col("period") + 1).alias("period"), "n", F.round(ratio("qty", "subs"), 6).alias("qty_per_sub"), F.round(ratio("disc", "price"), 6).alias("disc_rate"))


@query(f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER w AS rn FROM panel WINDOW w AS (PARTITION BY segment, grp, period ORDER BY qty DESC NULLS LAST, entity))
SELECT segment, grp, period, count(*) AS pool_size, count(*) FILTER (qty IS NULL) AS n_unknown, max(entity) FILTER (rn = 1) AS first_entity, max(qty) FILTER (rn = 1) AS first_value, max(entity) FILTER (rn = 2) AS second_entity, max(qty) FILTER (rn = 2) AS second_value FROM r GROUP BY segment, grp, period""")
def d10_pool_top_two(spark, d):
    """D10, W6, W7."""
    return peers.top_two(panel(spark, d), ["segment", "grp", "period"], "entity", "qty")


@query(f"""WITH {PANEL} SELECT a.entity, a.period, count(*) AS n_others, max(b.qty) AS others_max, sum(CASE WHEN b.segment = a.segment THEN b.qty END)::BIGINT AS same_segment FROM panel a JOIN panel b ON a.grp = b.grp AND a.period = b.period AND a.segment = b.segment AND a.entity <> b.entity GROUP BY a.entity, a.period""")
def j5_pool_self_join(spark, d):
    """What each entity's competitors have, by leave-one-out windows instead of pairs."""
    r = peers.room(panel(spark, d).select("entity", "period", "grp", "segment", "qty"), ["period", "grp", "segment"], "entity", "qty")
    return r.filter("room_count > 1").select("entity", "period", (F.col("room_count") - 1).alias("n_others"), "others_max", F.col("others_total").alias("same_segment"))


@query(f"""WITH {PANEL} SELECT a.entity, a.period, a.segment, max(b.qty) FILTER (b.segment = 'BUILDING') AS building_max, count(b.entity) FILTER (b.segment = 'BUILDING') AS n_building, max(b.qty) FILTER (b.segment = 'MACHINERY') AS machinery_max, count(b.entity) FILTER (b.segment = 'MACHINERY') AS n_machinery
FROM panel a LEFT JOIN panel b ON a.grp = b.grp AND a.period = b.period AND a.entity <> b.entity GROUP BY ALL""")
def a23_peer_types(spark, d):
    """Largest value and number of the others of each peer type, whatever the entity's own type."""
    p = panel(spark, d).select("entity", "period", "segment", "grp", "qty")
    for kind in ("BUILDING", "MACHINERY"):
        p = peers.masked(p, ["grp", "period"], "entity", "qty", F.col("segment") == kind, kind.lower())
    return p.select("entity", "period", "segment", "building_max", "n_building", "machinery_max", "n_machinery")


@query(f"""WITH {PANEL}, r AS (SELECT entity, period, segment, grp, qty, count(*) OVER w AS room_count, (sum(qty) OVER w)::BIGINT AS room_total, row_number() OVER (PARTITION BY segment, grp, period ORDER BY qty DESC NULLS LAST, entity) AS place, rank() OVER (PARTITION BY segment, grp, period ORDER BY qty DESC) AS room_rank FROM panel WINDOW w AS (PARTITION BY segment, grp, period)),
m AS (SELECT *, max(qty) FILTER (place = 1) OVER w AS f, max(qty) FILTER (place = 2) OVER w AS s FROM r WINDOW w AS (PARTITION BY segment, grp, period))
SELECT entity, period, room_count, room_total, room_total - qty AS others_total, CASE WHEN room_total > 0 THEN round(qty / room_total::DOUBLE, 6) END AS room_share, room_rank, CASE WHEN place = 1 THEN s ELSE f END AS others_max,
  round(qty / (CASE WHEN (CASE WHEN place = 1 THEN s ELSE f END) > 0 THEN (CASE WHEN place = 1 THEN s ELSE f END) END)::DOUBLE, 6) AS to_others_max FROM m""")
def d24_room(spark, d):
    """Leave-one-out totals and maxima without a self-join."""
    r = peers.room(panel(spark, d).select("entity", "period", "segment", "grp", "qty"), ["segment", "grp", "period"], "entity", "qty")
    return r.select("entity", "period", "room_count", "room_total", "others_total", F.round("room_share", 6).alias("room_share"), "room_rank", "others_max", F.round("to_others_max", 6).alias("to_others_max"))


@query(f"""WITH {PANEL}, prior AS (SELECT entity, grp, segment, period + 1 AS period, qty FROM panel), marked AS (SELECT p.*, h.entity AS here FROM prior p LEFT JOIN panel h ON p.entity = h.entity AND p.grp = h.grp AND p.period = h.period AND p.segment = h.segment)
SELECT grp, segment, period, coalesce(sum(qty) FILTER (here IS NULL), 0)::BIGINT AS vacated, sum(qty)::BIGINT AS prior_total, round(coalesce(sum(qty) FILTER (here IS NULL), 0) / sum(qty)::DOUBLE, 6) AS vacated_share FROM marked GROUP BY grp, segment, period""")
def d17_vacated(spark, d):
    """D17."""
    p = panel(spark, d).select("entity", "grp", "segment", "period", "qty")
    return peers.vacated(p.withColumn("period", F.col("period") + 1), p, ["grp", "segment", "period"], "entity", "qty").withColumn("vacated_share", F.round("vacated_share", 6))


@query("""WITH plays AS (SELECT l_orderkey AS occ, l_returnflag AS grp, l_linenumber % 2 AS play, list(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY ALL), e AS (SELECT occ, grp, unnest(members) AS member FROM plays), per AS (SELECT occ, grp, member, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT occ, grp, count(*) AS plays FROM plays GROUP BY ALL)
SELECT member, sum(n)::BIGINT AS on_field, sum(plays)::BIGINT AS plays, round(sum(n) / sum(plays)::DOUBLE, 6) AS rate FROM per JOIN t USING (occ, grp) GROUP BY member""")
def d18_participation(spark, d):
    """D18, F28."""
    plays = scan(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("occ"), F.col("l_returnflag").alias("grp"), F.col("l_linenumber") % 2).agg(F.collect_set("l_suppkey").alias("members"))
    return peers.participation(plays, "occ", "grp", F.col("members"), []).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {STATS}, x AS (SELECT segment, period, entity, grp, sum(qty) FILTER (prio <= 2)::BIGINT AS urgent, sum(qty) FILTER (n_lines >= 5)::BIGINT AS deep, count(*) FILTER (sub <= 3) AS early FROM stats GROUP BY ALL)
SELECT entity, period, grp, coalesce(urgent, 0) AS urgent, coalesce(deep, 0) AS deep, early, CASE WHEN sum(urgent) OVER w > 0 THEN round(coalesce(urgent, 0) / (sum(urgent) OVER w)::DOUBLE, 6) END AS urgent_share, CASE WHEN sum(deep) OVER w > 0 THEN round(coalesce(deep, 0) / (sum(deep) OVER w)::DOUBLE, 6) END AS deep_share FROM x WINDOW w AS (PARTITION BY grp, period)""")
def d16_event_shares(spark, d):
    """Shares of flagged events by entity within its group."""
    x = stats(spark, d).groupBy("segment", "period", "entity", "grp").agg(R.known_sum(F.when(F.col("prio") <= 2, F.col("qty"))).alias("urgent"), R.known_sum(F.when(F.col("n_lines") >= 5, F.col("qty"))).alias("deep"), F.sum(flag(F.col("sub") <= 3)).alias("early"))
    by = ["grp", "period"]
    return x.select("entity", "period", "grp", "urgent", "deep", "early", F.round(ratio("urgent", R.total_of("urgent", by)), 6).alias("urgent_share"), F.round(ratio("deep", R.total_of("deep", by)), 6).alias("deep_share"))


@query(f"""WITH {STATS} SELECT segment, period, round(sum(prio * qty) FILTER (qty > 20) / sum(qty) FILTER (qty > 20)::DOUBLE, 6) AS weighted, sum(CASE WHEN prio = 1 AND sub = 2 AND grp < 3 THEN qty END)::BIGINT AS known, bool_or(prio = 1 AND sub = 2 AND grp < 2 AND n_lines >= 6) AS any_urgent, count(DISTINCT grp) AS n_groups,
  round(avg(CASE WHEN prio = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS urgent_rate, min_by(occ, qty * 1000000000 + occ) AS least_occ, max_by(occ, qty * 1000000000 + occ) AS most_occ FROM stats GROUP BY segment, period""")
def a7_grouped(spark, d):
    """Weighted mean, sum that stays null, any, rates, rows at the extremes."""
    s = stats(spark, d)
    at = F.col("qty") * 1000000000 + F.col("occ")
    return s.groupBy("segment", "period").agg(
        F.round(R.weighted_mean("prio", F.when(F.col("qty") > 20, F.col("qty"))), 6).alias("weighted"), F.sum(F.when((F.col("prio") == 1) & (F.col("sub") == 2) & (F.col("grp") < 3), F.col("qty"))).alias("known"), F.bool_or((F.col("prio") == 1) & (F.col("sub") == 2) & (F.col("grp") < 2) & (F.col("n_lines") >= 6)).alias("any_urgent"),
        F.count_distinct("grp").alias("n_groups"), F.round(F.avg((F.col("prio") == 1).cast("double")), 6).alias("urgent_rate"), F.min_by("occ", at).alias("least_occ"), F.max_by("occ", at).alias("most_occ"),
    )


@query(f"""WITH {PANEL} SELECT segment, count(*) AS n, round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(stddev_samp(target), 6) AS std, min(target) AS min, max(target) AS max, round(skewness(target), 5) AS skew, count(*) FILTER (target < 4000) AS n_low FROM panel GROUP BY segment""")
def a5_distribution(spark, d):
    """A5: summary with exact median and bias-corrected skewness."""
    p = held(panel(spark, d).select("segment", "target"), "targets")
    out = p.groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean"), F.round(F.stddev_samp("target"), 6).alias("std"), F.min("target").alias("min"), F.max("target").alias("max"),
        F.round(R.sample_skew("target"), 5).alias("skew"), F.count_if(F.col("target") < 4000).alias("n_low"),
    )
    return with_medians(p, out, ["segment"], F.col("target"), "median").withColumn("median", F.round("median", 6))


@query(f"""WITH {STATS}, n AS (SELECT entity, period, min(prio) AS v, count(DISTINCT prio) AS k FROM stats GROUP BY ALL) SELECT entity, period, CASE WHEN k <= 1 THEN v END AS value, k > 1 AS conflict FROM n""")
def a9_conflict(spark, d):
    """One value, or null where sources disagree."""
    n = stats(spark, d).groupBy("entity", "period").agg(F.min("prio").alias("v"), F.count_distinct("prio").alias("k"))
    return n.select("entity", "period", F.when(F.col("k") <= 1, F.col("v")).alias("value"), (F.col("k") > 1).alias("conflict"))


@query(f"""WITH {STATS} SELECT segment, count(*) FILTER (status = 'F') AS F, count(*) FILTER (status = 'O') AS O, count(*) FILTER (status = 'P') AS P FROM stats GROUP BY segment""")
def a22_cross_tab(spark, d):
    """Cross-tabulation with a fixed list, empty cells 0."""
    return stats(spark, d).groupBy("segment").pivot("status", ["F", "O", "P"]).count().na.fill(0)


@query(f"""WITH {PANEL} SELECT entity, period, measure, value FROM panel UNPIVOT (value FOR measure IN (qty, price, disc))""")
def a21_unpivot(spark, d):
    return panel(spark, d).unpivot(["entity", "period"], ["qty", "price", "disc"], "measure", "value")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def a4_duplicate_keys(spark, d):
    from ..operators.contracts import duplicate_keys

    return duplicate_keys(scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
