"""Composite feature jobs: contexts, environments, tracking, commitments and competitors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions.exprs import clip, filled, knots, log_amount, ratio
from ..operators import asof, contracts
from ..operators import panel as P
from ..operators.places import Rank, with_ranks
from ..operators.evaluate import row_bootstrap
from ..operators.medians import with_medians
from .base import PANEL, PREDICTIONS, STATS, Query, bootstrap_sql, held, panel, predictions, registered, scan, stats

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"""WITH {STATS}, s AS (SELECT entity, period, grp, segment FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY sub, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, occ) AS rn FROM stats) WHERE rn = 1),
g AS (SELECT entity, period + 1 AS period, grp AS prev_grp, n FROM (SELECT entity, period, grp, count(*) AS n, row_number() OVER (PARTITION BY entity, period ORDER BY count(*) DESC, grp) AS rn FROM stats GROUP BY entity, period, grp) WHERE rn = 1)
SELECT entity, period, segment, grp, prev_grp, (grp <> prev_grp)::INT AS changed_group, CASE WHEN prev_grp IS NULL THEN 'no_previous' WHEN n < 2 THEN 'few_rows' ELSE 'kept' END AS reason FROM s LEFT JOIN g USING (entity, period)""")
def d7_context(spark, d):
    """First-snapshot assignment, previous group, change flag and exclusion reason."""
    s = stats(spark, d)
    priority = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    first = P.first_row(s, ["entity", "period"], "sub", priority, "occ").select("entity", "period", "segment", "grp")
    before = P.first_row(s.groupBy("entity", "period", "grp").agg(F.count("*").alias("n")), ["entity", "period"], F.desc("n"), "grp")
    before = before.select("entity", (F.col("period") + 1).alias("period"), F.col("grp").alias("prev_grp"), "n")
    reason = F.when(F.col("prev_grp").isNull(), "no_previous").when(F.col("n") < 2, "few_rows").otherwise("kept")
    return first.join(before, ["entity", "period"], "left").select("entity", "period", "segment", "grp", "prev_grp", (F.col("grp") != F.col("prev_grp")).cast("int").alias("changed_group"), reason.alias("reason"))


@query(f"""WITH {PANEL}, l AS (SELECT grp, period, entity AS leader FROM (SELECT *, row_number() OVER (PARTITION BY grp, period ORDER BY qty DESC, entity) AS rn FROM panel) WHERE rn = 1), r AS (SELECT entity AS leader, period + 1 AS period, qty AS prior_qty FROM panel)
SELECT grp, l.period, l.leader, prior_qty, (prior_qty IS NOT NULL)::INT AS has_history FROM l LEFT JOIN r USING (leader, period)""")
def d11_leader_environment(spark, d):
    """A group's leader with its own rating of the period before."""
    p = panel(spark, d)
    leader = P.first_row(p, ["grp", "period"], F.desc("qty"), "entity").select("grp", "period", F.col("entity").alias("leader"))
    rating = p.select(F.col("entity").alias("leader"), (F.col("period") + 1).alias("period"), F.col("qty").alias("prior_qty"))
    return contracts.checked_join(leader, rating, ["leader", "period"]).select("grp", "period", "leader", "prior_qty", F.col("prior_qty").isNotNull().cast("int").alias("has_history"))


@query(f"""WITH {PANEL}, m AS (SELECT segment, period, entity, rank() OVER (PARTITION BY segment, period ORDER BY price DESC) AS market FROM panel WHERE n_occ >= 2)
SELECT p.entity, p.period, p.segment, market, (market IS NOT NULL)::INT AS matched, CASE WHEN market IS NOT NULL THEN least(market, 20) END AS before_apex, CASE WHEN market IS NOT NULL THEN greatest(market - 20, 0) END AS after_apex FROM panel p LEFT JOIN m ON p.segment = m.segment AND p.entity = m.entity AND m.period = p.period - 1""")
def d15_market_features(spark, d):
    """Market rank of the period before, match flag, knots."""
    p = panel(spark, d)
    k = p.filter("n_occ >= 2").select("segment", (F.col("period") + 1).alias("period"), "entity", "price")
    m = with_ranks(k, ["segment", "period"], {"market": Rank("price", "low", True)}).drop("price")
    below, above = knots("market", 20)
    return p.select("entity", "period", "segment").join(contracts.assert_unique(m, ["segment", "period", "entity"]), ["segment", "period", "entity"], "left").select(
        "entity", "period", "segment", "market", F.col("market").isNotNull().cast("int").alias("matched"), below.alias("before_apex"), above.alias("after_apex")
    )


@query(f"""WITH {STATS}, f AS (SELECT entity, period, sum(prio * qty) FILTER (status = 'F') / sum(qty) FILTER (status = 'F')::DOUBLE AS w FROM stats GROUP BY ALL), o AS (SELECT entity, period, sum(n_lines * price) FILTER (status = 'O') / sum(price) FILTER (status = 'O')::DOUBLE AS w FROM stats GROUP BY ALL)
SELECT entity, period, round(f.w, 6) AS done_metric, round(o.w, 6) AS open_metric, round(coalesce(f.w + o.w, o.w * 2), 6) AS preferred FROM f FULL JOIN o USING (entity, period) WHERE f.w IS NOT NULL OR o.w IS NOT NULL""")
def d19_weighted_tracking(spark, d):
    """Weighted metrics of two feeds, prefer-source rule."""
    g = stats(spark, d).groupBy("entity", "period").agg(
        R.weighted_mean("prio", F.when(F.col("status") == "F", F.col("qty"))).alias("f"), R.weighted_mean("n_lines", F.when(F.col("status") == "O", F.col("price"))).alias("o")
    ).filter("f is not null or o is not null")
    return g.select("entity", "period", F.round("f", 6).alias("done_metric"), F.round("o", 6).alias("open_metric"), F.round(F.coalesce(F.col("f") + F.col("o"), F.col("o") * 2), 6).alias("preferred"))


@query(f"""WITH {PANEL}, i AS (SELECT entity, period AS start, prio AS years, price, occ FROM stats), u AS (SELECT p.entity, p.period, p.segment, i.*  EXCLUDE (entity), row_number() OVER (PARTITION BY p.entity, p.period ORDER BY i.start DESC, i.price DESC, i.occ) AS rn FROM panel p JOIN i ON p.entity = i.entity AND i.start <= p.period - 1 AND i.start + i.years - 1 >= p.period),
c AS (SELECT entity, period, segment, price, start + years - period AS years_left, period - start AS years_in FROM u WHERE rn = 1)
SELECT entity, period, round(ln(1 + price::DOUBLE), 6) AS log_price, years_left, least(years_in, 3) AS years_in, round((rank() OVER w + (count(*) OVER (PARTITION BY segment, period, price) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY segment, period), 6) AS price_pct FROM c WINDOW w AS (PARTITION BY segment, period ORDER BY price)""")
def d23_commitment(spark, d):
    """The interval that holds, with log amount, remaining years and percentile."""
    i = stats(spark, d).select("entity", F.col("period").alias("start"), F.col("prio").alias("years"), "price", "occ")
    c = asof.valid_interval(panel(spark, d).select("entity", "period", "segment"), i, "entity", "period", "start", "years", [-F.col("price"), F.col("occ")]).filter("start is not null")
    c = with_ranks(c, ["segment", "period"], {"pct": Rank("price", "percent")})
    return c.select(
        "entity", "period", F.round(log_amount(F.col("price").cast("double")), 6).alias("log_price"), (F.col("start") + F.col("years") - F.col("period")).alias("years_left"),
        clip(F.col("period") - F.col("start"), high=3).alias("years_in"), F.round("pct", 6).alias("price_pct"),
    )


@query(f"""WITH {PANEL}, x AS (SELECT *, CASE WHEN entity % 4 > 0 THEN (entity % 4) / 4.0::DOUBLE END AS p FROM panel), w AS (SELECT a.entity, a.period, sum(b.p * b.qty) AS weighted, count(*) FILTER (b.p IS NOT NULL) AS n_known, count(*) FILTER (b.p IS NULL) AS n_unknown, max(b.p) AS best, sum(b.p) AS effective FROM x a JOIN x b ON a.grp = b.grp AND a.period = b.period AND a.segment = b.segment AND a.entity <> b.entity GROUP BY a.entity, a.period)
SELECT x.entity, x.period, round(weighted, 6) AS weighted, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown, round(effective, 6) AS effective FROM x LEFT JOIN w USING (entity, period)""")
def d25_weighted_competitors(spark, d):
    """Probability-weighted measures of the others by leave-one-out sums, unknown kept apart. No self-join."""
    room = ["grp", "segment", "period"]
    w = Window.partitionBy(*room)
    x = panel(spark, d).withColumn("p", F.when(F.col("entity") % 4 > 0, (F.col("entity") % 4) / F.lit(4.0)))
    known, amount = F.count("p").over(w) - F.col("p").isNotNull().cast("int"), F.col("p") * F.col("qty")
    rest = lambda v: F.when(F.col("n_known") > 0, F.sum(v).over(w) - filled(v, 0.0))
    return x.withColumn("n_known", known).select(
        "entity", "period", F.round(rest(amount), 6).alias("weighted"), "n_known",
        (F.count("*").over(w) - F.count("p").over(w) - F.col("p").isNull().cast("int")).alias("n_unknown"), F.round(rest(F.col("p")), 6).alias("effective"),
    )


@query(f"""WITH {PANEL}, e AS (SELECT grp, period + 1 AS period, sum(qty)::BIGINT AS grp_qty FROM panel GROUP BY grp, period), h AS (SELECT entity, period, segment, grp, target, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1 FROM panel), c AS (SELECT segment, grp, period, count(*) AS pool FROM panel GROUP BY ALL)
SELECT h.entity, h.period, h.segment, lag_1, grp_qty, pool, (lag_1 IS NULL)::INT + (grp_qty IS NULL)::INT AS n_missing FROM h LEFT JOIN e USING (grp, period) LEFT JOIN c USING (segment, grp, period)""")
def d12_assembled(spark, d):
    """One modelling table from several sources, uniqueness checked, missing inputs counted."""
    p = panel(spark, d)
    p = contracts.assert_unique(p, ["entity", "period"])
    e = p.groupBy("grp", (F.col("period") + 1).alias("period")).agg(F.sum("qty").alias("grp_qty"))
    c = p.groupBy("segment", "grp", "period").agg(F.count("*").alias("pool"))
    h = p.select("entity", "period", "segment", "grp", P.exact_lag("target", "entity", "period", 1).alias("lag_1"))
    out = h.join(e, ["grp", "period"], "left").join(c, ["segment", "grp", "period"], "left")
    return out.select("entity", "period", "segment", "lag_1", "grp_qty", "pool", (F.col("lag_1").isNull().cast("int") + F.col("grp_qty").isNull().cast("int")).alias("n_missing"))


@query(f"""WITH {PREDICTIONS}, folds AS (SELECT segment, period AS fold FROM (SELECT segment, period, coalesce(sum(count(*)) OVER (PARTITION BY segment ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM predictions GROUP BY segment, period) WHERE n >= 50),
k AS (SELECT f.segment, fold, regr_slope(actual, a) AS coefficient FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold), z AS (SELECT segment, sign(coefficient) AS s, lag(sign(coefficient)) OVER (PARTITION BY segment ORDER BY fold) AS b FROM k WHERE coefficient <> 0)
SELECT *, change_rate >= 0.25 OR coalesce(std, 0) > abs(mean) AS unstable FROM (SELECT segment, 'a' AS feature, round(avg(coefficient), 4) AS mean, round(stddev_samp(coefficient), 4) AS std, round(min(coefficient), 4) AS min, round(max(coefficient), 4) AS max, (SELECT count(*) FILTER (s <> b) FROM z WHERE z.segment = k.segment) AS sign_changes, coalesce((SELECT count(*) FILTER (s <> b) / nullif(count(b), 0)::DOUBLE FROM z WHERE z.segment = k.segment), 0) AS change_rate FROM k GROUP BY segment)""")
def e9_coefficient_stability(spark, d):
    """Spread and sign changes of the folds' coefficients, and which are unstable."""
    from ..operators.evaluate import stability
    from .models import KEYS, linear, sums_of

    _, sums = sums_of(spark, d, ["a"])
    c = linear.original_units(linear.fits(sums, KEYS, {"last": [0]}, ridge=()), KEYS, ["a"])
    got = stability(c, ["segment", "feature"], "fold")
    return got.select("segment", "feature", *(F.round(x, 4).alias(x) for x in ("mean", "std", "min", "max")), "sign_changes", "change_rate", "unstable")


@query(f"""WITH {PREDICTIONS}, g AS (SELECT segment, (entity * 31 + period) % 2147483647 AS k, abs(a - actual) - abs(b - actual) AS gain FROM predictions), {bootstrap_sql("g", "segment", "k", "gain", 1000)}
SELECT segment, count(*) AS n, round(avg(gain), 6) AS mean_gain, round(median(gain), 6) AS median_gain, round(avg((gain > 0)::INT::DOUBLE), 6) AS improved_rate, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM g JOIN boot USING (segment) GROUP BY segment""")
def e17_paired_ablation(spark, d):
    """Paired gain of one specification over another, with the interval of its mean from 1,000 row resamples."""
    gain = F.abs(F.col("a") - F.col("actual")) - F.abs(F.col("b") - F.col("actual"))
    g = held(predictions(spark, d).select("segment", ((F.col("entity") * 31 + F.col("period")) % 2147483647).alias("k"), gain.alias("gain")), "gains")
    out = g.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.avg((F.col("gain") > 0).cast("double")), 6).alias("improved_rate"))
    out = with_medians(g, out, ["segment"], F.col("gain"), "median_gain").join(row_bootstrap(g, ["segment"], "k", "gain", 1000).drop("n"), "segment")
    return out.withColumns({x: F.round(x, 6) for x in ("median_gain", "low", "high")})


@query(f"""WITH {PREDICTIONS} SELECT segment, round(avg(actual - b), 6) AS mean, round(median(actual - b), 6) AS median, round(stddev_samp(actual - b), 6) AS std, count(*) FILTER (actual < 4000) AS n_low, round(avg(actual - b) FILTER (actual < 4000), 6) AS low_bias, round(avg(actual - b) FILTER (actual >= 12000), 6) AS high_bias, round(avg((b > actual)::INT::DOUBLE), 6) AS over_rate FROM predictions GROUP BY segment""")
def e19_tier_bias(spark, d):
    """Residuals by tier of the actual value."""
    r = F.col("actual") - F.col("b")
    p = held(predictions(spark, d).select("segment", "actual", "b"), "predictions")
    out = p.groupBy("segment").agg(
        F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_samp(r), 6).alias("std"), F.count_if(F.col("actual") < 4000).alias("n_low"),
        F.round(F.avg(F.when(F.col("actual") < 4000, r)), 6).alias("low_bias"), F.round(F.avg(F.when(F.col("actual") >= 12000, r)), 6).alias("high_bias"), F.round(F.avg((F.col("b") > F.col("actual")).cast("double")), 6).alias("over_rate"),
    )
    return with_medians(p, out, ["segment"], r, "median").withColumn("median", F.round("median", 6))


@query(f"""SELECT c_mktsegment AS segment, c_nationkey AS grp, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY ALL""")
def a1_group_sums(spark, d):
    """Strict sums by keys that are known."""
    c = scan(spark, d, "customer").filter("c_nationkey is not null and c_acctbal is not null")
    return c.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(f"""WITH {PANEL}, s AS (SELECT DISTINCT entity, period FROM panel WHERE qty > 100) SELECT p.entity, p.period, CASE WHEN qty > 0 THEN round(price / qty::DOUBLE, 6) END AS unit_price FROM panel p JOIN s USING (entity, period)""")
def x1_guarded_unit_price(spark, d):
    """Semi join on key tuples and a guarded ratio."""
    p = panel(spark, d)
    return p.join(p.filter("qty > 100").select("entity", "period").distinct(), ["entity", "period"], "left_semi").select("entity", "period", F.round(ratio("price", "qty"), 6).alias("unit_price"))
