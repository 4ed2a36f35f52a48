"""Metrics and comparisons of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import buckets
from ..functions.ranks import correlation
from ..operators import evaluate as V
from ..operators.contracts import checked_join
from ..operators.places import Rank, with_ranks
from .base import PREDICTIONS, Query, bootstrap_sql, held, predictions, registered, scan

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)

RANKED = f"""{PREDICTIONS}, ranked AS (
  SELECT *, a - actual AS e, rank() OVER (PARTITION BY segment, period ORDER BY actual DESC) + (count(*) OVER (PARTITION BY segment, period, actual) - 1) / 2.0::DOUBLE AS ar,
         rank() OVER (PARTITION BY segment, period ORDER BY a DESC) + (count(*) OVER (PARTITION BY segment, period, a) - 1) / 2.0::DOUBLE AS pr FROM predictions
)"""
METRICS = """count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / nullif(var_pop(actual), 0), 6) AS r2, round(CASE WHEN stddev_pop(ar) > 1e-12 AND stddev_pop(pr) > 1e-12 THEN covar_pop(ar, pr) / (stddev_pop(ar) * stddev_pop(pr)) END, 6) AS spearman,
  round(avg(abs(ar - pr)), 6) AS rank_mae, round(count(*) FILTER (ar <= 10 AND pr <= 10) / least(10, count(*))::DOUBLE, 6) AS top_overlap"""
NAMES = ("mae", "rmse", "r2", "spearman", "rank_mae", "top_overlap")


def ranked(spark, d):
    return V.diagnosed(predictions(spark, d), ["segment", "period"], predicted="a")


@query(f"WITH {RANKED} SELECT segment, period, entity, abs(e) AS absolute_error, ar AS actual_rank, pr AS predicted_rank FROM ranked")
def e1_diagnostics(spark, d):
    """E1, W8."""
    return ranked(spark, d).select("segment", "period", "entity", "absolute_error", "actual_rank", "predicted_rank")


@query(f"WITH {RANKED} SELECT segment, period, {METRICS} FROM ranked GROUP BY segment, period")
def e2_metrics(spark, d):
    """The metric pack by segment and period."""
    m = V.metrics(ranked(spark, d), ["segment", "period"], 10)
    return m.select("segment", "period", "n", *(F.round(x, 6).alias(x) for x in NAMES))


@query(f"""WITH {RANKED}, f AS (SELECT segment, period, avg(abs(e)) AS mae, CASE WHEN stddev_pop(ar) > 1e-12 AND stddev_pop(pr) > 1e-12 THEN covar_pop(ar, pr) / (stddev_pop(ar) * stddev_pop(pr)) END AS spearman FROM ranked GROUP BY segment, period), p AS (SELECT segment, count(*) AS n, round(avg(abs(e)), 6) AS mae FROM ranked GROUP BY segment)
SELECT segment, p.n, p.mae, round(avg(f.mae), 5) AS mean_mae, round(avg(f.spearman), 5) AS mean_spearman, count(*) AS n_folds FROM p JOIN f USING (segment) GROUP BY segment, p.n, p.mae""")
def e3_pooled_and_mean(spark, d):
    """Over all rows, and the mean of the periods' metrics."""
    r = ranked(spark, d)
    out = V.pooled_and_mean(V.metrics(r, ["segment", "period"], 10), V.metrics(r, ["segment"], 10), ["segment"], ["mae", "spearman"])
    return out.select("segment", "n", F.round("mae", 6).alias("mae"), F.round("mean_mae", 5).alias("mean_mae"), F.round("mean_spearman", 5).alias("mean_spearman"), "n_folds")


PAIRED = f"""{PREDICTIONS}, per AS (SELECT segment, period, count(*) AS n, sum(abs(b - actual)) AS ce, sum(abs(a - actual)) AS re FROM predictions WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
cmp AS (SELECT segment, sum(n)::BIGINT AS n, round(sum(ce) / sum(n), 6) AS candidate_mae, round(sum(re) / sum(n), 6) AS reference_mae, round((sum(re) - sum(ce)) / sum(n), 6) AS improvement,
  count(*) FILTER ((re - ce) / n > 1e-12) AS wins, count(*) FILTER (abs((re - ce) / n) <= 1e-12) AS ties, count(*) FILTER ((re - ce) / n < -1e-12) AS losses FROM per GROUP BY segment)"""


@query(f"WITH {PAIRED} SELECT * FROM cmp")
def e12_paired(spark, d):
    """Candidate against reference on the same rows."""
    out = V.paired(predictions(spark, d), ["segment"], "period", "b", "a")
    return out.select("segment", "n", *(F.round(x, 6).alias(x) for x in ("candidate_mae", "reference_mae", "improvement")), "wins", "ties", "losses")


REPLICATES = 5000
BOOT = f"""pl AS (SELECT segment, period, n, re - ce AS gain, row_number() OVER (PARTITION BY segment ORDER BY period) AS i, count(*) OVER (PARTITION BY segment) AS k FROM per),
dr AS (SELECT segment, r, ('0x' || substr(md5('446:' || r || ':' || i), 1, 15))::BIGINT % k + 1 AS j FROM pl, range(1, {REPLICATES + 1}) t(r)),
sm AS (SELECT dr.segment, r, sum(gain) / sum(n) AS pooled, avg(gain / n) AS of_means FROM dr JOIN pl ON dr.segment = pl.segment AND dr.j = pl.i GROUP BY dr.segment, r),
ci AS (SELECT segment, quantile_cont(pooled, 0.025) AS pooled_low, quantile_cont(pooled, 0.975) AS pooled_high, quantile_cont(of_means, 0.025) AS means_low, quantile_cont(of_means, 0.975) AS means_high FROM sm GROUP BY segment)"""
SUMMARY = f"""{PAIRED}, {BOOT}, rk AS (SELECT segment, period, {', '.join(f'rank() OVER (PARTITION BY segment, period ORDER BY {x} DESC) + (count(*) OVER (PARTITION BY segment, period, {x}) - 1) / 2.0::DOUBLE AS {y}' for x, y in (('actual', 'r'), ('a', 'ra'), ('b', 'rb')))} FROM predictions),
mt AS (SELECT segment, period, {', '.join(f'CASE WHEN stddev_pop(r) > 1e-12 AND stddev_pop({x}) > 1e-12 THEN covar_pop(r, {x}) / (stddev_pop(r) * stddev_pop({x})) END AS s_{x}, count(*) FILTER (r <= 10 AND {x} <= 10) / least(10, count(*))::DOUBLE AS o_{x}' for x in ('ra', 'rb'))} FROM rk GROUP BY ALL),
ch AS (SELECT segment, avg(s_rb) - avg(s_ra) AS spearman_change, avg(o_rb) - avg(o_ra) AS overlap_change FROM mt GROUP BY segment),
bi AS (SELECT segment, avg(b - a) FILTER (actual < 4000) AS low_bias_change, avg(b - a) FILTER (actual >= 12000) AS high_bias_change, coalesce(abs(corr(a, b)) <= 1 - 1e-9, false) AS full_rank FROM predictions GROUP BY segment),
sh AS (SELECT segment, CASE WHEN sum(re - ce) > 0 THEN max(re - ce) / sum(re - ce) END AS largest_share FROM per GROUP BY segment),
su AS (SELECT cmp.*, wins + ties + losses AS n_folds, round(means_low, 6) AS low, round(means_high, 6) AS high, round(spearman_change, 6) AS spearman_change, round(overlap_change, 6) AS overlap_change, round(low_bias_change, 6) AS low_bias_change, round(high_bias_change, 6) AS high_bias_change, full_rank, round(largest_share, 6) AS largest_share FROM cmp JOIN ci USING (segment) JOIN ch USING (segment) JOIN bi USING (segment) JOIN sh USING (segment))"""


@query(f"WITH {SUMMARY} SELECT * FROM su")
def e12_summary(spark, d):
    """Candidate against reference on the same rows: errors, wins, the interval of the gain, changes of rank correlation, overlap and tier bias, and the largest period's share."""
    from ..operators import linear

    p = held(predictions(spark, d), "predictions")
    keys = ["segment"]
    per = p.groupBy("segment", "period").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("actual")) - F.abs(F.col("b") - F.col("actual"))).alias("gain"))
    ci = V.block_bootstrap(per, keys, "period", "gain", "n", REPLICATES).select("segment", F.col("means_low").alias("low"), F.col("means_high").alias("high"))
    both = lambda x: V.metrics(V.diagnosed(p, ["segment", "period"], predicted=x), ["segment", "period"], 10).groupBy("segment").agg(F.avg("spearman").alias(f"s_{x}"), F.avg("top_overlap").alias(f"o_{x}"))
    ch = both("a").join(both("b"), keys).select("segment", (F.col("s_b") - F.col("s_a")).alias("spearman_change"), (F.col("o_b") - F.col("o_a")).alias("overlap_change"))
    step = F.col("b") - F.col("a")
    bias = p.groupBy("segment").agg(F.avg(F.when(F.col("actual") < 4000, step)).alias("low_bias_change"), F.avg(F.when(F.col("actual") >= 12000, step)).alias("high_bias_change"))
    rank = linear.rank_audit(linear.all_sums(p, keys, "period", ["a", "b"], "actual"), keys).select("segment", (F.col("deficiency") == 0).alias("full_rank"))
    share = per.groupBy("segment").agg(F.when(F.sum("gain") > 0, F.max("gain") / F.sum("gain")).alias("largest_share"))
    out = V.paired(p, keys, "period", "b", "a").withColumn("n_folds", F.col("wins") + F.col("ties") + F.col("losses"))
    for part in (ci, ch, bias, rank, share):
        out = out.join(part, keys)
    return out.withColumns({x: F.round(x, 6) for x in ("candidate_mae", "reference_mae", "improvement", "low", "high", "spearman_change", "overlap_change", "low_bias_change", "high_bias_change", "largest_share")})


@query(f"""WITH {SUMMARY} SELECT segment, improvement, spearman_change, CASE WHEN improvement > 0 AND wins > losses AND spearman_change >= 0 THEN 'Successful' WHEN improvement < 0 AND losses > wins THEN 'Unsuccessful' ELSE 'Mixed' END AS decision,
  CASE WHEN improvement > 0 AND wins >= ceil(n_folds / 2.0) AND spearman_change >= -0.005 THEN 'PROMOTE' ELSE 'REJECT' END AS tree_decision,
  CASE WHEN full_rank AND improvement > 0 AND (wins >= 8 OR low > 0) AND spearman_change >= -0.01 AND overlap_change >= -0.02 AND largest_share <= 0.5 THEN 'ACCEPT' WHEN improvement > 0 THEN 'PROMISING_NOT_CONFIRMED' ELSE 'REJECT' END AS adaptive_decision,
  CASE WHEN improvement > 0 AND low > 0 AND wins >= ceil(n_folds / 2.0) AND spearman_change >= 0 AND low_bias_change <= 0 AND high_bias_change >= 0 THEN 'PROMOTE' ELSE 'REJECT' END AS promotion,
  CASE WHEN improvement > 0 AND low > 0 AND n_folds >= 7 THEN 'ADVANCE' WHEN improvement > 0 AND low > 0 THEN 'PROMISING_LIMITED_HISTORY' ELSE 'REJECT' END AS role_decision,
  CASE WHEN improvement >= 0.005 AND spearman_change >= -0.005 AND low_bias_change <= 0.02 AND high_bias_change >= -0.05 THEN 'PASS' ELSE 'FAIL' END AS screen FROM su""")
def e21_decisions(spark, d):
    """The rule sets as data, on measured gains, intervals, rank and bias changes."""
    c = e12_summary(spark, d)
    for rules, otherwise, name in (
        (V.success_rules(), "Mixed", "decision"), (V.tree_rules(), "REJECT", "tree_decision"), (V.adaptive_rules(), "REJECT", "adaptive_decision"),
        (V.promotion_rules(), "REJECT", "promotion"), (V.role_rules(), "REJECT", "role_decision"), (V.screen_rules(), "FAIL", "screen"),
    ):
        c = V.decided(c, rules, otherwise, name)
    return c.select("segment", "improvement", "spearman_change", "decision", "tree_decision", "adaptive_decision", "promotion", "role_decision", "screen")


def versus(candidate, reference):
    return f"SELECT '{candidate}' AS candidate, '{reference}' AS reference, segment, sum(n)::BIGINT AS n, round(sum(re - ce) / sum(n), 6) AS improvement, count(*) FILTER ((re - ce) / n > 1e-12) AS wins FROM (SELECT segment, period, count(*) AS n, sum(abs({candidate} - actual)) AS ce, sum(abs({reference} - actual)) AS re FROM predictions WHERE {candidate} IS NOT NULL AND {reference} IS NOT NULL GROUP BY ALL) GROUP BY segment"


CHAIN = (("b", "a"), ("m", "b"), ("m", "a"))


@query(f"WITH {PREDICTIONS} " + " UNION ALL ".join(versus(*x) for x in CHAIN))
def e13_chain(spark, d):
    """A chain of specifications, each against the one before and the last against the first."""
    p, out = held(predictions(spark, d), "predictions"), None
    for candidate, reference in CHAIN:
        one = V.paired(p, ["segment"], "period", candidate, reference).select(F.lit(candidate).alias("candidate"), F.lit(reference).alias("reference"), "segment", "n", F.round("improvement", 6).alias("improvement"), "wins")
        out = one if out is None else out.unionByName(one)
    return out


def long_predictions(spark, d):
    """A row a model; b is missing for some entities and twice there for others."""
    p = predictions(spark, d).unpivot(["segment", "entity", "period", "actual"], ["a", "b", "m"], "model", "predicted")
    p = p.filter("not (model = 'b' and entity % 17 = 0)")
    return held(p.unionByName(p.filter("model = 'b' and entity % 19 = 0")), "long")


LONG = f"""{PREDICTIONS}, lo AS (SELECT * FROM (SELECT segment, entity, period, actual, unnest(['a', 'b', 'm']) AS model, unnest([a, b, m]) AS predicted FROM predictions) WHERE NOT (model = 'b' AND entity % 17 = 0)), ln AS (SELECT * FROM lo UNION ALL SELECT * FROM lo WHERE model = 'b' AND entity % 19 = 0)"""


@query(f"WITH {LONG}, pe AS (SELECT segment, entity, period, count(*) AS r, count(DISTINCT model) AS k, count(*) FILTER (predicted IS NULL OR NOT isfinite(predicted)) AS bad FROM ln GROUP BY ALL) SELECT segment, count(*) AS n, count(*) FILTER (k < 3) AS n_unpaired, count(*) FILTER (r > k) AS n_repeated, sum(bad)::BIGINT AS n_not_finite FROM pe GROUP BY segment")
def e5_pairing_audit(spark, d):
    """E5: entities of a long table that lack a model or have one twice, and predictions that aren't numbers."""
    return V.pairing_audit(long_predictions(spark, d), ["entity", "period"], ["segment"], ["a", "b", "m"])


@query(f"WITH {LONG} SELECT segment, entity, period, round(predicted, 6) AS reference FROM ln WHERE model = 'm'")
def e26_reference(spark, d):
    """One model selected out of a long table, under another name."""
    return V.selected(long_predictions(spark, d), ["segment", "entity", "period"], "m", "reference").withColumn("reference", F.round("reference", 6))


@query(f"WITH {PREDICTIONS} SELECT r_name AS region, (n_occ >= 3) AS busy, count(*) AS n, round(avg(abs(a - actual)), 6) AS mae FROM predictions JOIN nation ON grp = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def e16_enriched(spark, d):
    """Predictions enriched with context tables, then sliced by it."""
    nation = scan(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), "n_regionkey")
    region = scan(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    both = checked_join(checked_join(predictions(spark, d), nation, ["grp"]), region, ["n_regionkey"]).filter("region is not null")
    return both.groupBy("region", (F.col("n_occ") >= 3).alias("busy")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("actual"))), 6).alias("mae"))


@query(f"WITH {PREDICTIONS}, used AS (SELECT segment, period, period + (CASE WHEN entity % 53 = 1 AND segment < 'F' THEN 0 ELSE 1 END) AS fold FROM predictions) SELECT segment, fold, max(period) AS last_train, max(period) < fold AS in_order, count(*) FILTER (period >= fold) AS n_late FROM used GROUP BY segment, fold")
def e28_fold_order(spark, d):
    """The last training period of every fold, which must lie before it; some rows here are said to train their own period."""
    late = (F.col("entity") % 53 == 1) & (F.col("segment") < "F")
    used = predictions(spark, d).select("segment", "period", (F.col("period") + F.when(late, 0).otherwise(1)).alias("fold"))
    return used.groupBy("segment", "fold").agg(F.max("period").alias("last_train"), (F.max("period") < F.col("fold")).alias("in_order"), F.count_if(F.col("period") >= F.col("fold")).alias("n_late"))


@query(f"""WITH {PAIRED} SELECT segment, period, round((sum(re - ce) OVER w - (re - ce)) / nullif(sum(n) OVER w - n, 0), 6) AS gain_without, CASE WHEN sum(re - ce) OVER w > 0 THEN round((re - ce) / sum(re - ce) OVER w, 6) END AS gain_share FROM per WINDOW w AS (PARTITION BY segment)""")
def e18_leave_one_out(spark, d):
    p = predictions(spark, d)
    per = p.groupBy("segment", "period").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("actual")) - F.abs(F.col("b") - F.col("actual"))).alias("gain"))
    return V.leave_one_out(per, ["segment"], "gain", "n").select("segment", "period", F.round("gain_without", 6).alias("gain_without"), F.round("gain_share", 6).alias("gain_share"))


@query(f"""WITH {PREDICTIONS}, s AS (SELECT segment, abs(b - actual) AS e, abs(a - actual) AS r, b - actual AS signed, CASE WHEN n_prior < 2 THEN 'new' WHEN n_prior < 4 THEN 'some' ELSE 'old' END AS history, CASE WHEN n_occ < 2 THEN '1' WHEN n_occ < 4 THEN '2-3' ELSE '4+' END AS games FROM predictions),
u AS (SELECT segment, e, r, signed, 'history' AS slice, history AS value FROM s UNION ALL SELECT segment, e, r, signed, 'games', games FROM s)
SELECT segment, slice, value, count(*) AS n, round(avg(e), 6) AS mae, round(avg(r), 6) AS reference_mae, round(avg(r - e), 6) AS improvement, round(avg((e < r)::INT::DOUBLE), 6) AS improved_rate, round(avg(signed), 6) AS bias FROM u GROUP BY segment, slice, value""")
def e14_slices(spark, d):
    """Error by slice."""
    p = predictions(spark, d).select(
        "segment", F.abs(F.col("b") - F.col("actual")).alias("e"), F.abs(F.col("a") - F.col("actual")).alias("r"), (F.col("b") - F.col("actual")).alias("signed"),
        buckets("n_prior", (2, 4), ("new", "some", "old")).alias("history"), buckets("n_occ", (2, 4), ("1", "2-3", "4+")).alias("games"),
    )
    return V.slices(p, ["segment"], ["history", "games"], "e", "r", "signed").select("segment", "slice", "value", "n", *(F.round(x, 6).alias(x) for x in ("mae", "reference_mae", "improvement", "improved_rate", "bias")))


@query(f"""WITH {RANKED} SELECT segment, period, CASE WHEN ar <= 10 AND pr <= 10 THEN 'correct' WHEN pr <= 10 THEN 'false_in' WHEN ar <= 10 THEN 'missed' ELSE 'outside' END AS status, count(*) AS n FROM ranked GROUP BY ALL""")
def e15_top_status(spark, d):
    return ranked(spark, d).withColumn("status", V.top_status("actual_rank", "predicted_rank", 10)).groupBy("segment", "period", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {PREDICTIONS}, l AS (SELECT *, (actual > m)::INT AS label, a / (a + m) AS p FROM predictions), k AS (SELECT *, rank() OVER (PARTITION BY segment, period ORDER BY p) + (count(*) OVER (PARTITION BY segment, period, p) - 1) / 2.0::DOUBLE AS r FROM l)
SELECT segment, period, count(*) AS n, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)::DOUBLE, 6) AS auc, round(avg((p - label) ** 2), 6) AS brier FROM k GROUP BY segment, period""")
def e20_auc_brier(spark, d):
    p = predictions(spark, d).withColumn("label", (F.col("actual") > F.col("m")).cast("int")).withColumn("p", F.col("a") / (F.col("a") + F.col("m")))
    return V.auc(p, ["segment", "period"], "label", "p").select("segment", "period", "n", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


@query(f"""WITH {PREDICTIONS} SELECT segment, count(*) AS n, round(avg(abs(a - actual)), 6) AS a, round(avg(abs(b - actual)), 6) AS b, round(avg(abs(m - actual)), 6) AS m FROM predictions WHERE m IS NOT NULL GROUP BY segment""")
def e22_same_cohort(spark, d):
    """Several models over the rows that all of them predict."""
    p = predictions(spark, d)
    both = p.dropna(subset=["a", "b", "m"])  # models are columns of one table, so their cohort takes no join
    return both.groupBy("segment").agg(F.count("*").alias("n"), *(F.round(F.avg(F.abs(F.col(x) - F.col("actual"))), 6).alias(x) for x in ("a", "b", "m")))


@query(f"""WITH {RANKED}, m AS (SELECT segment, period, round(avg(abs(e)), 9) AS mae FROM ranked GROUP BY ALL) SELECT segment, min_by(period, mae) AS best_period, max_by(period, mae) AS worst_period, round(min(mae), 6) AS best_mae, round(max(mae), 6) AS worst_mae FROM m GROUP BY segment""")
def e24_best_worst(spark, d):
    """E24, A12."""
    m = V.metrics(ranked(spark, d), ["segment", "period"], 10)
    return m.groupBy("segment").agg(F.min_by("period", "mae").alias("best_period"), F.max_by("period", "mae").alias("worst_period"), F.round(F.min("mae"), 6).alias("best_mae"), F.round(F.max("mae"), 6).alias("worst_mae"))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT segment, period, rank() OVER (PARTITION BY segment, period ORDER BY a DESC) + (count(*) OVER (PARTITION BY segment, period, a) - 1) / 2.0::DOUBLE AS market, rank() OVER (PARTITION BY segment, period ORDER BY b DESC) + (count(*) OVER (PARTITION BY segment, period, b) - 1) / 2.0::DOUBLE AS model, rank() OVER (PARTITION BY segment, period ORDER BY actual DESC) + (count(*) OVER (PARTITION BY segment, period, actual) - 1) / 2.0::DOUBLE AS actual FROM predictions),
s AS (SELECT segment, period, CASE WHEN stddev_pop(market) > 1e-12 AND stddev_pop(actual) > 1e-12 THEN covar_pop(market, actual) / (stddev_pop(market) * stddev_pop(actual)) END AS market_rho, CASE WHEN stddev_pop(model) > 1e-12 AND stddev_pop(actual) > 1e-12 THEN covar_pop(model, actual) / (stddev_pop(model) * stddev_pop(actual)) END AS model_rho, count(*) FILTER (market <= 10 AND actual <= 10) / least(10, count(*))::DOUBLE AS market_top, count(*) FILTER (model <= 10 AND actual <= 10) / least(10, count(*))::DOUBLE AS model_top, avg(abs(market - actual)) AS market_mae, avg(abs(model - actual)) AS model_mae FROM r GROUP BY ALL)
SELECT segment, round(avg(market_rho), 6) AS market_spearman, round(avg(model_rho), 6) AS model_spearman, round(avg(market_top), 6) AS market_overlap, round(avg(model_top), 6) AS model_overlap, round(avg(market_mae), 6) AS market_mae, round(avg(model_mae), 6) AS model_mae, count(*) FILTER (model_mae < market_mae - 1e-9) AS model_wins, count(*) AS n_periods FROM s GROUP BY segment""")
def e23_external_ranking(spark, d):
    """Two rankings against the actual one: rank correlation, overlap, rank error and periods won."""
    by = ["segment", "period"]
    of = {"market": "a", "model": "b", "actual": "a_value"}
    r = with_ranks(predictions(spark, d).select(*by, "a", "b", F.col("actual").alias("a_value")), by, {name: Rank(x, descending=True) for name, x in of.items()})
    top = lambda x: F.count_if((F.col(x) <= 10) & (F.col("actual") <= 10)) / F.least(F.lit(10), F.count("*"))
    s = r.groupBy(*by).agg(*(correlation(x, "actual").alias(f"{x}_rho") for x in ("market", "model")), *(top(x).alias(f"{x}_top") for x in ("market", "model")), F.avg(F.abs(F.col("market") - F.col("actual"))).alias("market_mae"), F.avg(F.abs(F.col("model") - F.col("actual"))).alias("model_mae"))
    return s.groupBy("segment").agg(*(F.round(F.avg(f"{x}_rho"), 6).alias(f"{x}_spearman") for x in ("market", "model")), *(F.round(F.avg(f"{x}_top"), 6).alias(f"{x}_overlap") for x in ("market", "model")), F.round(F.avg("market_mae"), 6).alias("market_mae"), F.round(F.avg("model_mae"), 6).alias("model_mae"), F.count_if(F.col("model_mae") < F.col("market_mae") - 1e-9).alias("model_wins"), F.count("*").alias("n_periods"))


@query(f"WITH {PAIRED}, {BOOT} SELECT segment, round(pooled_low, 6) AS pooled_low, round(pooled_high, 6) AS pooled_high, round(means_low, 6) AS means_low, round(means_high, 6) AS means_high FROM ci")
def e11_block_bootstrap(spark, d):
    """Intervals from resampled periods, both estimators; draws are hashes of (seed, replicate, place)."""
    p = predictions(spark, d)
    per = p.groupBy("segment", "period").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("actual")) - F.abs(F.col("b") - F.col("actual"))).alias("gain"))
    got = V.block_bootstrap(per, ["segment"], "period", "gain", "n", REPLICATES)
    return got.select("segment", *(F.round(x, 6).alias(x) for x in ("pooled_low", "pooled_high", "means_low", "means_high")))


GAINS = f"{PREDICTIONS}, gains AS (SELECT segment, (entity * 31 + period) % 2147483647 AS k, abs(a - actual) - abs(b - actual) AS gain FROM predictions)"


@query(f"WITH {GAINS}, {bootstrap_sql('gains', 'segment', 'k', 'gain', 5000)} SELECT segment, n, round(low, 6) AS low, round(high, 6) AS high FROM boot JOIN (SELECT segment, count(*) AS n FROM gains GROUP BY segment) USING (segment)")
def e10_row_bootstrap(spark, d):
    """Intervals from 5,000 replicates of Poisson row weights."""
    p = predictions(spark, d).select("segment", ((F.col("entity") * 31 + F.col("period")) % 2147483647).alias("k"), (F.abs(F.col("a") - F.col("actual")) - F.abs(F.col("b") - F.col("actual"))).alias("gain"))
    return V.row_bootstrap(p, ["segment"], "k", "gain").select("segment", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


MODELS = {"recent": "a", "history": "b", "segment_mean": "m"}


@query(f"""WITH {PREDICTIONS}, x AS (SELECT entity, period, a AS said FROM predictions), y AS (SELECT entity, period, b AS said FROM predictions WHERE n_prior >= 2), z AS (SELECT entity, period, m AS said FROM predictions WHERE entity % 7 <> 0),
c AS (SELECT p.segment, p.actual, x.said AS a, y.said AS b, z.said AS m FROM predictions p JOIN x USING (entity, period) JOIN y USING (entity, period) JOIN z USING (entity, period))
SELECT segment, count(*) AS n, round(avg(abs(a - actual)), 6) AS recent, round(avg(abs(b - actual)), 6) AS history, round(avg(abs(m - actual)), 6) AS segment_mean FROM c GROUP BY segment""")
def j19_same_cohort(spark, d):
    """Models that three tables of different rows hold, compared on the rows that all of them predict."""
    p = held(predictions(spark, d), "predictions")
    of = {"recent": p, "history": p.filter("n_prior >= 2"), "segment_mean": p.filter("entity % 7 != 0")}
    tables = {name: held(rows.select("entity", "period", F.col(MODELS[name]).alias("said")), f"model-{name}") for name, rows in of.items()}
    both = V.same_cohort(tables, ["entity", "period"], "said").join(p.select("entity", "period", "segment", "actual"), ["entity", "period"])
    mae = lambda name: F.round(F.avg(F.abs(F.col(name) - F.col("actual"))), 6)
    return both.groupBy("segment").agg(F.count("*").alias("n"), mae("recent").alias("recent"), mae("history").alias("history"), mae("segment_mean").alias("segment_mean"))


@query(f"""WITH {PREDICTIONS}, y AS (SELECT entity, period, CASE WHEN entity % 11 = 0 THEN NULL WHEN entity % 13 = 0 THEN 'NaN'::DOUBLE ELSE b END AS said FROM predictions WHERE n_prior >= 2)
SELECT count(*) FILTER (y.entity IS NOT NULL) AS n_both, count(*) FILTER (y.entity IS NULL) AS n_only_first, count(*) FILTER (y.entity IS NOT NULL AND (said IS NULL OR isnan(said))) AS n_not_finite FROM predictions p LEFT JOIN y USING (entity, period)""")
def e5_pairing_gaps(spark, d):
    """E5: pairing of two outputs where one lacks rows and has values that are missing or no number."""
    p = held(predictions(spark, d), "predictions")
    odd = F.when(F.col("entity") % 11 == 0, F.lit(None)).when(F.col("entity") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("b"))
    second = held(p.filter("n_prior >= 2").select("entity", "period", odd.alias("said")), "second")
    bits = V.present({"first": p.select("entity", "period", F.col("a").alias("said")), "second": second}, ["entity", "period"], "said")
    return bits.agg(F.count_if(F.col("__in") == 3).alias("n_both"), F.count_if(F.col("__in") == 1).alias("n_only_first"), F.count_if((F.col("__in") == 3) & (F.col("__finite").bitwiseAND(F.lit(2)) == 0)).alias("n_not_finite"))
