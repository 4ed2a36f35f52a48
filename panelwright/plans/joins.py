"""Joins in key and in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, contracts
from ..operators import panel as P
from .base import PANEL, STATS, Query, panel, predictions, PREDICTIONS, registered, scan, stats

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1_left_many_to_one(spark, d):
    """Differently named keys, unique right side checked, no fan-out."""
    nation = scan(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = scan(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    both = contracts.checked_join(scan(spark, d, "customer"), nation, ["c_nationkey"])
    return contracts.checked_join(both, region, ["n_regionkey"]).select("c_custkey", "n_name", "r_name")


@query(f"""WITH {STATS} SELECT s.period, s.sub, s.grp, s.entity, s.qty, t.total FROM stats s JOIN (SELECT period, sub, grp, sum(qty)::BIGINT AS total FROM stats GROUP BY ALL) t USING (period, sub, grp)""")
def j4_inner_by_sub_period(spark, d):
    s = stats(spark, d)
    return s.join(s.groupBy("period", "sub", "grp").agg(F.sum("qty").alias("total")), ["period", "sub", "grp"]).select("period", "sub", "grp", "entity", "qty", "total")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j6_anti(spark, d):
    return scan(spark, d, "customer").select("c_custkey").join(scan(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j17_semi(spark, d):
    return scan(spark, d, "customer").select("c_custkey").join(scan(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"""WITH {STATS}, a AS (SELECT entity, period, sum(qty)::BIGINT AS open_qty FROM stats WHERE status = 'O' GROUP BY ALL), b AS (SELECT entity, period, sum(qty)::BIGINT AS done_qty FROM stats WHERE status = 'F' GROUP BY ALL)
SELECT entity, period, open_qty, done_qty, CASE WHEN open_qty IS NULL THEN 'right_only' WHEN done_qty IS NULL THEN 'left_only' ELSE 'both' END AS status FROM a FULL JOIN b USING (entity, period)""")
def j8_outer_with_status(spark, d):
    """Full outer with coalesced keys and a match status."""
    s = stats(spark, d)
    side = lambda status, name: s.filter(F.col("status") == status).groupBy("entity", "period").agg(F.sum("qty").alias(name))
    return contracts.matched(side("O", "open_qty"), side("F", "done_qty"), ["entity", "period"]).select("entity", "period", "open_qty", "done_qty", "status")


@query(f"""WITH {PANEL}, i AS (SELECT entity, period AS start, prio AS years, price, occ FROM stats),
u AS (SELECT p.entity, p.period, i.start, i.years, i.price, count(*) FILTER (i.start = p.period) OVER w AS n_same_period, i.start <= p.period - 1 AND i.start + i.years - 1 >= p.period AS ok,
  row_number() OVER (PARTITION BY p.entity, p.period ORDER BY (i.start <= p.period - 1 AND i.start + i.years - 1 >= p.period) DESC, i.start DESC, i.price DESC, i.occ) AS rn FROM panel p LEFT JOIN i USING (entity) WINDOW w AS (PARTITION BY p.entity, p.period))
SELECT entity, period, n_same_period, CASE WHEN ok THEN start END AS start, CASE WHEN ok THEN years END AS years, CASE WHEN ok THEN price END AS price FROM u WHERE rn = 1""")
def j9_valid_interval(spark, d):
    """Newest, then largest interval signed before the period and still running."""
    i = stats(spark, d).select("entity", F.col("period").alias("start"), F.col("prio").alias("years"), "price", "occ")
    got = asof.valid_interval(panel(spark, d).select("entity", "period"), i, "entity", "period", "start", "years", [-F.col("price"), F.col("occ")])
    return got.select("entity", "period", "n_same_period", "start", "years", "price")


@query("""WITH e AS (SELECT *, ts::DATE AS day, month(ts)::INT AS period FROM events), n AS (SELECT user_id, max(day) AS day FROM e WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT e.user_id, strftime(e.day, '%Y-%m-%d') AS day, e.event_id, e.event_type FROM e JOIN n USING (user_id, day)""")
def j10_snapshot_before_cutoff(spark, d):
    """All rows of the newest dated snapshot before a cutoff."""
    e = scan(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).withColumn("day", F.to_date("ts"))
    whole = scan(spark, d, "events").withColumn("day", F.to_date("ts"))
    newest = e.groupBy("user_id").agg(F.max("day").alias("day"))
    return whole.join(newest, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "event_id", "event_type")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE rn = 1""")
def j11_asof_first(spark, d):
    """Newest row a key strictly before a cutoff."""
    got = asof.latest_before(scan(spark, d, "events"), ["user_id", "event_type"], "ts", F.lit("2024-01-15").cast("timestamp"), "event_id")
    return got.select("user_id", "event_type", "event_id", "value")


@query("""WITH base AS (SELECT c_nationkey AS grp, max(c_custkey) AS leader FROM customer GROUP BY 1), o AS (SELECT grp, leader - 1 AS leader FROM base WHERE grp % 5 = 0)
SELECT grp, leader, 'base' AS origin FROM base WHERE grp NOT IN (SELECT grp FROM o) UNION ALL SELECT grp, leader, 'override' FROM o""")
def j15_override_merge(spark, d):
    """J15, U1."""
    base = scan(spark, d, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.max("c_custkey").alias("leader")).withColumn("origin", F.lit("base"))
    better = base.filter("grp % 5 = 0").select("grp", (F.col("leader") - 1).alias("leader"), F.lit("override").alias("origin"))
    return contracts.overridden(base, better, ["grp"])


@query(f"""WITH {PREDICTIONS}, k AS (SELECT entity, period, m AS better FROM predictions WHERE entity % 3 = 0) SELECT entity, period, coalesce(better, a) AS predicted FROM predictions LEFT JOIN k USING (entity, period)""")
def j18_fallback(spark, d):
    p = predictions(spark, d)
    base = p.select("entity", "period", F.col("a").alias("predicted"))
    return contracts.preferred(base, p.filter("entity % 3 = 0").select("entity", "period", F.col("m").alias("predicted")), ["entity", "period"], "predicted")


@query(f"""WITH {PANEL}, f AS (SELECT entity, period FROM panel WHERE n_occ = 1 AND period % 2 = 0) SELECT segment, count(*) AS n_before, count(*) FILTER (f.entity IS NOT NULL) AS n_removed, count(*) FILTER (f.entity IS NULL) AS n_after FROM panel LEFT JOIN f USING (entity, period) GROUP BY segment""")
def p7_flagged_removed(spark, d):
    """Remove flagged keys with an audit."""
    p = panel(spark, d)
    return contracts.without(p, p.filter("n_occ = 1 and period % 2 = 0"), ["entity", "period"], "segment")[1]


@query(f"""WITH {STATS}, f AS (SELECT entity, period, grp, count(*) AS n, sum(qty)::BIGINT AS qty, max(sub) AS latest FROM stats GROUP BY ALL) SELECT entity, period + 1 AS period, grp FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY n DESC, qty DESC, latest DESC, grp) AS rn FROM f) WHERE rn = 1""")
def d5_primary_group(spark, d):
    """The group of the period before, by appearances, then measure, then the latest."""
    f = stats(spark, d).groupBy("entity", "period", "grp").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.max("sub").alias("latest"))
    return P.first_row(f, ["entity", "period"], F.desc("n"), F.desc("qty"), F.desc("latest"), "grp").select("entity", (F.col("period") + 1).alias("period"), "grp")


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS grp FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal < 0")
def u4_difference(spark, d):
    """U4, U5."""
    c = scan(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp"), "c_acctbal")
    return c.filter("c_acctbal > 0").drop("c_acctbal").distinct().join(c.filter("c_acctbal < 0").select("segment", "grp").distinct(), ["segment", "grp"], "left_anti")


@query("SELECT s_nationkey AS grp FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def u3_intersection(spark, d):
    return scan(spark, d, "supplier").select(F.col("s_nationkey").alias("grp")).intersect(scan(spark, d, "customer").filter("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def u2_relaxed_union(spark, d):
    c = scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(scan(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), allowMissingColumns=True)
