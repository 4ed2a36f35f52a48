"""Windows, ranks, sorts and top rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..operators import panel as P
from ..operators import places
from ..operators.places import Rank
from .base import PANEL, PREDICTIONS, STATS, Query, panel, predictions, registered, scan, stats

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"""WITH {PANEL} SELECT entity, period, segment, rank() OVER (PARTITION BY segment, period ORDER BY n_occ DESC) + (count(*) OVER (PARTITION BY segment, period, n_occ) - 1) / 2.0::DOUBLE AS average_rank,
  round((rank() OVER (PARTITION BY segment, period ORDER BY n_occ) + (count(*) OVER (PARTITION BY segment, period, n_occ) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY segment, period), 6) AS pct_rank,
  row_number() OVER (PARTITION BY segment, period ORDER BY n_occ DESC, entity) AS first_rank, rank() OVER (PARTITION BY segment, period ORDER BY n_occ DESC) AS min_rank,
  CASE WHEN count(*) OVER (PARTITION BY segment, period) = 1 THEN 1 ELSE greatest(1, ceil((row_number() OVER (PARTITION BY segment, period ORDER BY n_occ, entity) - 1) * 4 / nullif(count(*) OVER (PARTITION BY segment, period) - 1, 0)::DOUBLE))::INT END AS tier FROM panel""")
def w8_ranks(spark, d):
    """Average, percent, first and minimum ranks, equal-frequency tiers."""
    by = ["segment", "period"]
    p = panel(spark, d).select("entity", "period", "segment", "n_occ")
    kinds = {"average_rank": Rank("n_occ", descending=True), "pct_rank": Rank("n_occ", "percent"), "min_rank": Rank("n_occ", "low", True), "first_rank": Rank("n_occ", "first", True), "tier": Rank("n_occ", "tier")}
    return places.with_places(p, by, "n_occ", ["entity"], kinds).withColumn("pct_rank", F.round("pct_rank", 6)).drop("n_occ")


@query(f"""WITH {PREDICTIONS} SELECT segment, period, entity, place FROM (SELECT *, row_number() OVER (PARTITION BY segment, period ORDER BY abs(a - actual) DESC, entity) AS place FROM predictions) WHERE place <= 5""")
def w16_largest_errors(spark, d):
    """Top rows a group."""
    return P.top_rows(predictions(spark, d), ["segment", "period"], 5, F.abs(F.col("a") - F.col("actual")).desc(), "entity").select("segment", "period", "entity", "place")


@query(f"""WITH {STATS}, w AS (SELECT segment, period, price::DOUBLE / qty AS v, qty, sum(qty) OVER (PARTITION BY segment, period ORDER BY price::DOUBLE / qty RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(qty) OVER (PARTITION BY segment, period) AS total FROM stats)
SELECT segment, period, round(min(v), 6) AS weighted_median FROM w WHERE run * 2 >= total GROUP BY segment, period""")
def w17_weighted_median(spark, d):
    s = stats(spark, d).withColumn("v", F.col("price").cast("double") / F.col("qty"))
    return places.weighted_median(s, ["segment", "period"], "v", "qty", "weighted_median").withColumn("weighted_median", F.round("weighted_median", 6))


@query(f"""WITH {PANEL}, g AS (SELECT segment, grp, period, sum(qty)::BIGINT AS qty FROM panel GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY segment, period ORDER BY qty // 5 DESC) AS rn FROM g)
SELECT segment, period, min(rn) AS low, max(rn) AS high, count(DISTINCT rn) AS n_distinct, min(rn) = 1 AND max(rn) = count(*) AND count(DISTINCT rn) = count(*) AS contiguous FROM r GROUP BY segment, period""")
def w19_contiguous_ranks(spark, d):
    """Whether ranks that came from elsewhere run from 1 without gaps."""
    g = panel(spark, d).groupBy("segment", "grp", "period").agg(F.sum("qty").alias("qty"))
    r = g.withColumn("rn", R.lowest_rank(F.floor(F.col("qty") / 5), ["segment", "period"]))  # ties leave gaps
    low, high, n = F.min("rn"), F.max("rn"), F.count_distinct("rn")
    return r.groupBy("segment", "period").agg(low.alias("low"), high.alias("high"), n.alias("n_distinct"), ((low == 1) & (high == F.count("*")) & (n == F.count("*"))).alias("contiguous"))


@query(f"WITH {PANEL} SELECT entity, period, qty FROM panel ORDER BY qty DESC NULLS LAST, entity, period LIMIT 100")
def o2_global_head(spark, d):
    """O1, O2: mixed-direction order with nulls last, then the first rows (the limit is the operator)."""
    return panel(spark, d).select("entity", "period", "qty").orderBy(F.desc_nulls_last("qty"), "entity", "period").limit(100)


@query(f"""WITH {PANEL} SELECT entity, period, target FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS rn FROM panel) WHERE rn <= 2""")
def o4_tail_by_period(spark, d):
    return P.top_rows(panel(spark, d), ["entity"], 2, F.desc("period")).select("entity", "period", "target")


@query(f"""WITH {STATS}, c AS (SELECT entity, period, prio, status FROM stats), r AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY period DESC) AS p FROM c), k AS (SELECT entity, prio, status, count(*) AS n, min(period) AS first FROM r WHERE p <= 5 GROUP BY ALL)
SELECT entity, prio, status, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, first, prio, status) AS rn FROM k) WHERE rn = 1""")
def a11_modal_recent(spark, d):
    """The most frequent choice of the last five periods."""
    from ..operators.folds import modal_recent

    return modal_recent(stats(spark, d).select("entity", "period", "prio", "status"), ["entity"], "period", ["prio", "status"])


@query(f"""WITH {PANEL}, s AS (SELECT entity, period, sign(target - lag(target) OVER (PARTITION BY entity ORDER BY period)) AS s FROM panel), z AS (SELECT entity, s, lag(s) OVER (PARTITION BY entity ORDER BY period) AS b FROM s WHERE s <> 0) SELECT entity, count(*) FILTER (s <> b) AS sign_changes FROM z GROUP BY entity""")
def w18_sign_changes(spark, d):
    w = Window.partitionBy("entity").orderBy("period")
    s = panel(spark, d).withColumn("s", F.signum(F.col("target") - F.lag("target").over(w))).filter("s <> 0").withColumn("b", F.lag("s").over(w))
    return s.groupBy("entity").agg(F.count_if(F.col("s") != F.col("b")).alias("sign_changes"))


@query("""SELECT c_mktsegment AS segment, c_nationkey AS grp, c_custkey AS entity FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') ORDER BY c_acctbal DESC, entity""")
def p13_browser_filter(spark, d):
    """Equality, substring without regard to case, order."""
    c = scan(spark, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") & F.lower("c_name").contains("1"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("entity"))
