"""Cohorts: contracts, pairings, overrides, name joins, corrections and slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import ranks as R
from ..operators import asof, contracts, evaluate, peers, places
from ..operators import panel as P
from ..operators.medians import with_medians
from ..operators.places import Rank
from .base import PANEL, PREDICTIONS, STATS, Query, held, panel, parts_of, predictions, registered, scan, stats
from .panels import LAG

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"""WITH {PANEL}, l AS (SELECT *, {LAG.format('qty', 1)} AS q1 FROM panel) SELECT segment, count(*) AS n_before, count(*) FILTER (period <= 1995) AS n_removed, count(*) FILTER (period > 1995) AS n_after, count(*) FILTER (period = 1996 AND q1 IS NOT NULL) AS n_with_boundary FROM l GROUP BY segment""")
def p8_boundary(spark, d):
    """The first period goes as a target but stays as history, with an audit."""
    p = panel(spark, d).select("segment", "entity", "period", P.exact_lag("qty", "entity", "period", 1).alias("q1"))
    kept, audit = contracts.without_boundary(p, "period", 1995, "segment")
    uses = kept.groupBy("segment").agg(F.count_if((F.col("period") == 1996) & F.col("q1").isNotNull()).alias("n_with_boundary"))
    return audit.join(uses, "segment", "left").withColumn("n_with_boundary", E.filled("n_with_boundary"))


@query(f"""WITH {PANEL} SELECT entity, period, segment, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN qty ELSE qty + n_occ END::DOUBLE AS first_input, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN n_occ ELSE round(qty / nullif(qty + n_occ, 0)::DOUBLE, 6) END::DOUBLE AS second_input FROM panel""")
def p11_representation(spark, d):
    """By segment two components, or their total and mix."""
    first, second = E.represented(F.col("segment").isin("BUILDING", "MACHINERY"), "qty", "n_occ")
    return panel(spark, d).select("entity", "period", "segment", first.alias("first_input"), F.round(second, 6).alias("second_input"))


SORTS = {"amount": "c_acctbal DESC, c_custkey", "name": "c_name, c_custkey", "group": "c_nationkey, c_acctbal DESC, c_custkey", "id": "c_custkey"}


@query(" UNION ALL ".join(f"SELECT '{mode}' AS mode, c_custkey AS entity, row_number() OVER (ORDER BY {order}) AS place FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 7 AND contains(lower(c_name), '1')" for mode, order in SORTS.items()))
def p13_browser_modes(spark, d):
    """Segment, group and name filters under the four sort modes."""
    c, out = scan(spark, d, "customer"), None
    for mode, order in SORTS.items():
        one = contracts.browsed(c, {"c_mktsegment": "MACHINERY", "c_nationkey": 7}, "c_name", "1")
        place = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(*map(F.expr, (x for x in order.replace(" DESC", "").split(", ")))) if "DESC" not in order else Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(*(F.desc(x.split()[0]) if x.endswith("DESC") else F.col(x) for x in order.split(", "))))
        one = one.select(F.lit(mode).alias("mode"), F.col("c_custkey").alias("entity"), place.alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


FORBIDDEN = ("entity", "target", "qty", "price")


@query(f"""WITH {PANEL}, l AS (SELECT target, qty, price, {LAG.format('target', 1)} AS target_1, {LAG.format('qty', 1)} AS qty_1, row_number() OVER (PARTITION BY entity ORDER BY period) AS rn FROM panel)
SELECT feature, feature IN {FORBIDDEN} AS forbidden, v AS n_first FROM (SELECT count(target) FILTER (rn = 1) AS target, count(qty) FILTER (rn = 1) AS qty, count(target_1) FILTER (rn = 1) AS target_1, count(qty_1) FILTER (rn = 1) AS qty_1 FROM l) UNPIVOT (v FOR feature IN (target, qty, target_1, qty_1))""")
def p14_inputs(spark, d):
    """Each input of a manifest, whether a model may not read it, and how many first rows of an entity have it (0 for what comes from before)."""
    p = panel(spark, d).select("target", "qty", P.exact_lag("target", "entity", "period", 1).alias("target_1"), P.exact_lag("qty", "entity", "period", 1).alias("qty_1"), P.prior_count("entity", "period").alias("n_prior"))
    contracts.assert_inputs(["target_1", "qty_1"], FORBIDDEN)
    return contracts.input_audit(p, ["target", "qty", "target_1", "qty_1"], FORBIDDEN, F.col("n_prior") == 0)


@query("""SELECT 'period' AS kind, p::VARCHAR AS value FROM range(1990, 2005) r(p) WHERE p NOT IN (SELECT year(o_orderdate) FROM orders)
UNION ALL SELECT 'segment', s FROM (VALUES ('F'), ('O'), ('X')) v(s) WHERE s NOT IN (SELECT o_orderstatus FROM orders) UNION ALL SELECT 'column', 'team' UNION ALL SELECT 'rows', 'none' WHERE NOT EXISTS (SELECT 1 FROM orders)""")
def p15_contract_gaps(spark, d):
    """Periods, segments and columns that must be there and aren't, and an input without rows."""
    contract = contracts.TableContract({"period": "PERIOD", "segment": "segment", "team": "team"}, periods=range(1990, 2005), segments=("F", "O", "X"))
    return contract.gaps(scan(spark, d, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("segment")))


@query(f"""WITH {PREDICTIONS} SELECT segment, count(*) AS n, round(avg(abs(a - actual) - abs(b - actual)), 6) AS gain FROM predictions GROUP BY segment""")
def j3_pairing(spark, d):
    """One-to-one pairing of two models' tables; both keep their height."""
    p = held(predictions(spark, d), "predictions")
    side = lambda x: p.select("segment", "entity", "period", F.abs(F.col(x) - F.col("actual")).alias(f"e_{x}"))
    both = contracts.one_to_one(side("a"), side("b"), ["segment", "entity", "period"])
    return both.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg(F.col("e_a") - F.col("e_b")), 6).alias("gain"))


@query("""WITH e AS (SELECT event_id, user_id, hour(ts)::INT AS period, ts::DATE AS taken FROM events), c AS (SELECT *, DATE '2024-01-10' + (period % 7)::INT AS cutoff FROM e), n AS (SELECT period, max(taken) AS taken FROM c WHERE taken <= cutoff GROUP BY period)
SELECT event_id, user_id, c.period, strftime(c.taken, '%Y-%m-%d') AS taken FROM c JOIN n ON c.period = n.period AND c.taken = n.taken""")
def j10_snapshot_by_period(spark, d):
    """Each period's newest snapshot up to a cutoff of its own."""
    e = scan(spark, d, "events").select("event_id", "user_id", F.hour("ts").alias("period"), F.to_date("ts").alias("taken"))
    got = asof.snapshot(e, "period", "taken", F.date_add(F.lit("2024-01-10").cast("date"), F.col("period") % 7))
    return got.select("event_id", "user_id", "period", F.col("taken").cast("string").alias("taken"))


@query(f"""WITH {PANEL}, l AS (SELECT grp, period, arg_max(entity, qty * 1000000000 - entity) AS leader FROM panel WHERE NOT (grp = 3 AND period % 2 = 1) GROUP BY ALL), o AS (SELECT grp, period, leader + 1 AS leader FROM l WHERE grp % 5 = 0 AND period % 2 = 0), m AS (SELECT * FROM l WHERE (grp, period) NOT IN (SELECT (grp, period) FROM o) UNION ALL SELECT * FROM o)
SELECT period, count(DISTINCT grp) AS n_groups, count(*) AS n_rows, count(DISTINCT grp) = 25 AND count(*) = 25 AS complete, sum(leader)::BIGINT AS leaders FROM m GROUP BY period""")
def j15_group_counts(spark, d):
    """Leaders with overrides in place, and whether every group of a period has exactly one."""
    l = panel(spark, d).filter("not (grp = 3 and period % 2 = 1)").groupBy("grp", "period").agg(F.max_by("entity", F.col("qty") * 1000000000 - F.col("entity")).alias("leader"))  # noqa: E741
    better = l.filter("grp % 5 = 0 and period % 2 = 0").withColumn("leader", F.col("leader") + 1)
    merged = contracts.overridden(l, better, ["grp", "period"])
    return contracts.group_counts(merged, "period", "grp", 25, F.sum("leader").alias("leaders"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT c_custkey AS entity, n FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def j16_name_join(spark, d):
    """A table that knows names only, joined by their normalised key; both sides' keys are checked."""
    c = scan(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_name")
    n = scan(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"))
    market = held(c.join(n, "entity").select(F.concat(F.upper("c_name"), F.lit(" Jr.")).alias("name"), "n"), "market")
    return contracts.name_join(c, market, "c_name", "name").select("entity", "n")


@query(f"""WITH {STATS} SELECT entity, period, arg_min(prio, occ) AS first, round(avg(prio), 6) AS mean, min(prio) AS min, max(prio) AS max, count(*) AS n FROM stats GROUP BY ALL""")
def a13_collapsed(spark, d):
    """Several rows of one identity collapsed."""
    v = F.col("prio")
    return stats(spark, d).groupBy("entity", "period").agg(F.min_by(v, "occ").alias("first"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n"))


@query(f"""WITH {PANEL} SELECT period, count(*) AS n, round(median(target), 6) AS median, round(skewness(target), 5) AS skew, count(*) FILTER (target < 4000) AS n_low, count(*) FILTER (target >= 4000 AND target < 12000) AS n_mid, count(*) FILTER (target >= 12000) AS n_high FROM panel GROUP BY period""")
def a17_bands_by_period(spark, d):
    """Skewness, median and bands by period."""
    t = F.col("target")
    p = held(panel(spark, d).select("period", "target"), "targets")
    out = p.groupBy("period").agg(
        F.count("*").alias("n"), F.round(R.sample_skew("target"), 5).alias("skew"),
        F.count_if(t < 4000).alias("n_low"), F.count_if((t >= 4000) & (t < 12000)).alias("n_mid"), F.count_if(t >= 12000).alias("n_high"),
    )
    return with_medians(p, out, ["period"], t, "median").withColumn("median", F.round("median", 6))


@query(f"""WITH {PANEL} SELECT entity, {', '.join(f'max(target) FILTER (period = {y}) AS t{y}' for y in range(1995, 2002))} FROM panel GROUP BY entity""")
def a20_pivot(spark, d):
    """Values pivoted by a fixed list of periods."""
    years = list(range(1995, 2002))
    wide = panel(spark, d).groupBy("entity").pivot("period", years).agg(F.first("target"))
    return wide.select("entity", *(F.col(str(y)).alias(f"t{y}") for y in years))


@query(f"""WITH {PREDICTIONS}, k AS (SELECT segment, grp, period, rank() OVER (PARTITION BY segment, grp, period ORDER BY a) + (count(*) OVER (PARTITION BY segment, grp, period, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY segment, grp, period ORDER BY actual) + (count(*) OVER (PARTITION BY segment, grp, period, actual) - 1) / 2.0::DOUBLE AS y FROM predictions)
SELECT segment, grp, period, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) END AS spearman FROM k GROUP BY ALL""")
def a24_cohort_spearman(spark, d):
    """Rank correlation in sub-cohorts of three rows or more."""
    by = ["segment", "grp", "period"]
    return places.spearman(predictions(spark, d), by, "a", "actual", 3).withColumn("spearman", F.round("spearman", 6))


@query(f"""WITH {PANEL}, l AS (SELECT entity, period, segment, grp, {LAG.format('qty', 1)} AS q1, {LAG.format('target', 1)} AS t1 FROM panel)
SELECT segment, grp, period, entity, row_number() OVER (PARTITION BY segment, grp, period ORDER BY (q1 IS NOT NULL) DESC, q1 DESC NULLS LAST, t1 DESC NULLS LAST, entity) AS place, q1 AS prior_qty FROM l""")
def w6_competitor_order(spark, d):
    """The long pool: competitors with history first, then by prior measure and score, then by id."""
    p = panel(spark, d).select("entity", "period", "segment", "grp", P.exact_lag("qty", "entity", "period", 1).alias("q1"), P.exact_lag("target", "entity", "period", 1).alias("t1"))
    w = Window.partitionBy("segment", "grp", "period").orderBy(F.col("q1").isNotNull().desc(), F.desc_nulls_last("q1"), F.desc_nulls_last("t1"), "entity")
    return p.select("segment", "grp", "period", "entity", F.row_number().over(w).alias("place"), F.col("q1").alias("prior_qty"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, strftime(make_date(year(o_orderdate), 9, 1), '%Y-%m-%d') AS cutoff, date_diff('day', o_orderdate::DATE, make_date(year(o_orderdate), 9, 1)) AS to_cutoff, (o_orderkey % 5 = 0) AS unreadable FROM orders""")
def f4_dates(spark, d):
    """dates parsed from text (what can't be read is null), taken apart and put together."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = scan(spark, d, "orders").select("o_orderkey", text.alias("text"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(text).alias("dirty"))
    day = F.to_date("text", "yyyy-MM-dd")
    cutoff = F.make_date(F.year(day), F.lit(9), F.lit(1))
    return o.select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), cutoff.cast("string").alias("cutoff"), F.datediff(cutoff, day).alias("to_cutoff"), F.col("dirty").try_cast("date").isNull().alias("unreadable"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS period, month(o_orderdate)::INT AS sub, o_orderstatus AS grp FROM orders""")
def f21_period_of_id(spark, d):
    """period, sub-period and group out of an id such as 1995_03_F_17."""
    o = scan(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.date_format("o_orderdate", "yyyy_MM"), "o_orderstatus", F.col("o_orderkey").cast("string")).alias("id"))
    return o.select("o_orderkey", F.substring("id", 1, 4).cast("int").alias("period"), F.split_part("id", F.lit("_"), F.lit(2)).cast("int").alias("sub"), F.trim(F.split_part("id", F.lit("_"), F.lit(3))).alias("grp"))


BUCKETS = {
    "history": ("n_prior", (2, 4), ("new", "some", "old")), "games": ("n_occ", (2, 4), ("1", "2-3", "4+")), "group": ("grp", (8, 16), ("first", "second", "third")),
    "last": ("a", (4000, 12000), ("low", "mid", "high")), "mean": ("b", (4000, 12000), ("low", "mid", "high")), "change": ("step", (-2000, 2000), ("down", "even", "up")), "era": ("period", (1998, 2000), ("early", "middle", "late")),
}


def case(col, edges, names):
    return "CASE " + " ".join(f"WHEN {col} < {e} THEN '{n}'" for e, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


@query(f"""WITH {PREDICTIONS}, s AS (SELECT segment, abs(b - actual) AS e, abs(a - actual) AS r, b - actual AS signed, {', '.join(f'{case(c if c != "step" else "(a - b)", x, y)} AS "{k}"' for k, (c, x, y) in BUCKETS.items())}, 'q' || ((row_number() OVER (PARTITION BY segment, period ORDER BY b DESC, entity) - 1) * 4 // count(*) OVER (PARTITION BY segment, period)) AS quartile FROM predictions)
SELECT segment, slice, value, count(*) AS n, round(avg(e), 6) AS mae, round(avg(r), 6) AS reference_mae, round(avg((e < r)::INT::DOUBLE), 6) AS improved_rate, round(avg(signed), 6) AS bias FROM s UNPIVOT (value FOR slice IN ({', '.join(f'"{k}"' for k in BUCKETS)}, quartile)) GROUP BY segment, slice, value""")
def f14_eight_slices(spark, d):
    """Errors over eight dimensions, a floor-division quartile among them, after enrichment of the predictions."""
    p = predictions(spark, d).withColumn("step", F.col("a") - F.col("b"))
    by = Window.partitionBy("segment", "period")
    place = F.row_number().over(by.orderBy(F.desc("b"), "entity")) - 1
    quartile = F.concat(F.lit("q"), F.floor(place * 4 / F.count("*").over(by)).cast("string"))
    rows = p.select("segment", F.abs(F.col("b") - F.col("actual")).alias("e"), F.abs(F.col("a") - F.col("actual")).alias("r"), (F.col("b") - F.col("actual")).alias("signed"), quartile.alias("quartile"), *(E.buckets(c, x, y).alias(k) for k, (c, x, y) in BUCKETS.items()))
    got = evaluate.slices(rows, ["segment"], [*BUCKETS, "quartile"], "e", "r", "signed")
    return got.select("segment", "slice", "value", "n", *(F.round(x, 6).alias(x) for x in ("mae", "reference_mae", "improved_rate", "bias")))


@query(f"""WITH {STATS}, g AS (SELECT entity, period, arg_min(prio, sub::BIGINT * 1000000000000 + occ) AS first_prio, arg_max(prio, sub::BIGINT * 1000000000000 + occ) AS last_prio, min(prio) AS low, max(prio) AS high FROM stats GROUP BY ALL), c AS (SELECT entity, period, prio, sum(qty) AS q FROM stats GROUP BY ALL), t AS (SELECT entity, period, prio AS main_prio FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY q DESC, prio) AS rn FROM c) WHERE rn = 1)
SELECT entity, period, CASE WHEN first_prio <> last_prio AND abs(first_prio - last_prio) >= 3 THEN 'mismatch' ELSE 'first_disagrees' END AS rule FROM g JOIN t USING (entity, period) WHERE (first_prio <> last_prio AND abs(first_prio - last_prio) >= 3) OR first_prio <> main_prio""")
def d32_cohort_corrections(spark, d):
    """Rows to leave out: the class of the snapshot is far from the realised one, or the first class isn't the primary one."""
    s = stats(spark, d)
    at = F.struct("sub", "occ")
    g = s.groupBy("entity", "period").agg(F.min_by("prio", at).alias("first_prio"), F.max_by("prio", at).alias("last_prio"))
    t = P.first_row(s.groupBy("entity", "period", "prio").agg(F.sum("qty").alias("q")), ["entity", "period"], F.desc("q"), "prio").select("entity", "period", F.col("prio").alias("main_prio"))
    rules = [("mismatch", F.abs(F.col("first_prio") - F.col("last_prio")) >= 3), ("first_disagrees", F.col("first_prio") != F.col("main_prio"))]
    return evaluate.decided(g.join(t, ["entity", "period"]), rules, "kept", "rule").filter("rule != 'kept'").select("entity", "period", "rule")


@query(f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY segment, grp, period ORDER BY qty DESC, entity) AS place FROM panel), o AS (SELECT segment, grp, period, count(*) AS n, count(*) - count(DISTINCT entity) AS n_repeated, max(place) - count(DISTINCT place) AS n_gaps, count(*) - count(DISTINCT qty) AS n_tied FROM k GROUP BY ALL)
SELECT segment, period, count(*) AS n_pools, sum(n_repeated)::BIGINT AS n_repeated, sum(n_gaps)::BIGINT AS n_gaps, sum(n_tied)::BIGINT AS n_tied, count(*) FILTER (n = 1) AS n_alone, 25 - count(*) AS n_empty FROM o GROUP BY ALL""")
def q6_pool_audit(spark, d):
    """Q6: pools with repeated members, gaps in their ranks, ties, a single member or none at all."""
    by = ["segment", "grp", "period"]
    k = panel(spark, d).select(*by, "entity", "qty", R.first_rank("qty", by, ["entity"]).alias("place"))
    o = peers.pool_audit(k, by, "entity", "place", "qty")
    return o.groupBy("segment", "period").agg(F.count("*").alias("n_pools"), *(F.sum(x).alias(x) for x in ("n_repeated", "n_gaps", "n_tied")), F.count_if(F.col("n") == 1).alias("n_alone"), (25 - F.count("*")).alias("n_empty"))


@query(f"""WITH {PANEL}, k AS (SELECT segment, period, entity, rank() OVER (PARTITION BY segment, period ORDER BY qty DESC) AS r, count(*) OVER (PARTITION BY segment, period) AS n FROM panel), s AS (SELECT * REPLACE (CASE WHEN entity % 19 = 1 THEN r + n ELSE r END AS r), CASE WHEN entity % 17 = 1 THEN NULL WHEN n > 1 THEN (1 - (r - 1) / (n - 1)::DOUBLE) * (CASE WHEN entity % 13 = 1 THEN 0.5 ELSE 1 END)::DOUBLE END AS score FROM k WHERE entity % 7 > 0)
SELECT segment, period, count(*) AS n, max(n) - count(*) AS n_missing, count(*) FILTER (r < 1 OR r > n) AS n_out, count(*) - count(DISTINCT r) AS n_tied, count(*) FILTER (abs(1 + (1 - score) * (n - 1) - r) > 1e-9) AS n_inconsistent, count(*) FILTER (score IS NULL) AS n_without_score FROM s GROUP BY ALL""")
def q7_ranking_audit(spark, d):
    """Q7: a ranking's missing entities, bounds, ties and whether its score agrees with its rank; faults of each kind are put in."""
    by = ["segment", "period"]
    k = places.with_ranks(panel(spark, d).select(*by, "entity", "qty"), by, {"r": Rank("qty", "low", True)})
    k = k.join(k.groupBy(*by).agg(F.count("*").alias("n")), by)
    score = (1 - (F.col("r") - 1) / (F.col("n") - 1)) * F.when(F.col("entity") % 13 == 1, 0.5).otherwise(1.0)
    s = k.filter("entity % 7 > 0").withColumn("score", F.when((F.col("n") > 1) & (F.col("entity") % 17 != 1), score))
    s = s.withColumn("r", F.when(F.col("entity") % 19 == 1, F.col("r") + F.col("n")).otherwise(F.col("r")))
    return contracts.ranking_audit(s, by, "r", "n", "score")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer UNION ALL SELECT c_custkey, 'BUILDING', c_nationkey FROM customer WHERE c_custkey % 10 = 0), k AS (SELECT c_custkey, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds FROM c GROUP BY ALL)
SELECT 'missing_key' AS check_name, (SELECT count(*) FROM c WHERE c_custkey IS NULL) AS affected UNION ALL SELECT 'duplicate_key', count(*) FILTER (n > 1) FROM k UNION ALL SELECT 'segment_mismatch', count(*) FILTER (kinds > 1) FROM k""")
def q2_keys(spark, d):
    """Q2: missing and repeated keys, and segments that differ from a second table's."""
    c = scan(spark, d, "customer").select("c_custkey", "c_mktsegment")
    both = c.unionByName(c.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("BUILDING")))
    return contracts.key_findings(both, "c_custkey", "c_mktsegment")


POOLS = f"""{PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY grp, period ORDER BY qty DESC, entity) AS place FROM panel), t AS (SELECT grp, period, entity AS competitor, segment AS competitor_segment, place FROM k WHERE place <= 4),
l AS (SELECT p.segment, p.period, p.entity, competitor, competitor_segment, place FROM panel p JOIN t USING (grp, period) WHERE NOT (p.entity % 5 = 0 AND p.entity = competitor) AND p.entity % 29 > 0 UNION ALL SELECT p.segment, p.period, p.entity, competitor, competitor_segment, place FROM panel p JOIN t USING (grp, period) WHERE p.entity % 23 = 0 AND place = 1 AND p.entity % 29 > 0),
f AS (SELECT segment, period, entity, count(*) AS n, count(*) FILTER (competitor = entity) AS n_self, count(*) FILTER (competitor_segment <> segment) AS n_wrong, count(*) - count(DISTINCT competitor) AS n_repeated, min(place) <> 1 OR max(place) <> count(*) OR count(DISTINCT place) <> count(*) AS bad FROM l GROUP BY ALL)"""


@query(f"WITH {POOLS} SELECT p.segment, p.period, count(*) AS n_focal, coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(sum(n_self), 0)::BIGINT AS n_self, coalesce(sum(n_wrong), 0)::BIGINT AS n_wrong_type, coalesce(sum(n_repeated), 0)::BIGINT AS n_repeated, count(*) FILTER (bad) AS n_bad_ranks, count(*) FILTER (n IS NULL) AS n_without_pool FROM panel p LEFT JOIN f USING (segment, period, entity) GROUP BY p.segment, p.period")
def q6_pool_faults(spark, d):
    """Q6: lists of up to four competitors with themselves in it, of another segment, repeated, with gaps in their ranks, or without anyone."""
    p = held(panel(spark, d).select("entity", "period", "segment", "grp", "qty"), "panel")
    top = P.top_rows(p, ["grp", "period"], 4, F.desc("qty"), "entity").select("grp", "period", F.col("entity").alias("competitor"), F.col("segment").alias("competitor_segment"), "place")
    focal = p.filter("entity % 29 > 0").repartition(parts_of(spark, 4 * p.count()), "entity")
    both = focal.join(F.broadcast(top), ["grp", "period"])  # top has four rows a group and period
    copies = F.expr("int(not (entity % 5 = 0 and entity = competitor)) + int(entity % 23 = 0 and place = 1)")
    listed = both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("__copy")
    return peers.pool_faults(p, listed, ["segment", "period", "entity"], ["segment", "period"], "competitor", "place", F.col("competitor_segment") != F.col("segment"))


LEADERS = f"""{STATS}, {PANEL[PANEL.index("panel AS ("):]}, r AS (SELECT grp, period, entity FROM (SELECT p.*, row_number() OVER (PARTITION BY grp, period ORDER BY p.qty DESC, first_sub, entity) AS place FROM panel p JOIN (SELECT entity, period, min(sub) AS first_sub FROM stats GROUP BY ALL) USING (entity, period)) WHERE place = 1),
j AS (SELECT grp, period + 1 AS period, entity FROM r WHERE NOT (grp = 4 AND period % 2 = 0) UNION ALL SELECT grp, period + 1, entity + 1 FROM r WHERE grp = 6 AND period % 3 = 0)"""


@query(f"WITH {LEADERS}, g AS (SELECT period, grp, count(*) AS k, min(entity) AS projected FROM j GROUP BY ALL) SELECT g.period, count(*) AS n_groups, 25 - count(*) AS n_missing, count(*) FILTER (k > 1) AS n_duplicate, count(r.entity) AS n_realised, count(*) FILTER (r.entity IS NOT NULL AND r.entity <> projected) AS n_differ FROM g LEFT JOIN r USING (grp, period) GROUP BY g.period")
def q4_projected_leaders(spark, d):
    """Q4: the leader projected for each group, last period's, against the one who led: coverage of the groups, groups with two, and how many differ."""
    first = stats(spark, d).groupBy("entity", "period").agg(F.min("sub").alias("first_sub"))
    led = P.first_row(panel(spark, d).select("entity", "period", "grp", "qty").join(first, ["entity", "period"]), ["grp", "period"], F.desc("qty"), "first_sub", "entity").select("grp", "period", "entity")
    led = held(led, "leaders")
    later = (F.col("period") + 1).alias("period")
    projected = led.filter("not (grp = 4 and period % 2 = 0)").select("grp", later, "entity").unionByName(led.filter("grp = 6 and period % 3 = 0").select("grp", later, (F.col("entity") + 1).alias("entity")))
    n_groups = scan(spark, d, "nation").count()
    return contracts.leader_audit(projected, led, "grp", "period", "entity", n_groups)
