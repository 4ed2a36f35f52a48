"""Data-quality findings, leakage audit and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import exclusive
from ..operators import contracts as C
from ..sources import tables as S
from .base import PANEL, PREDICTIONS, STATS, Query, panel, predictions, registered, scan, stats
from .panels import LAG

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


def finding(category: str, name: str, table: str, bad: str) -> str:
    return f"SELECT '{category}' AS category, '{name}' AS check_name, 'error' AS severity, CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER ({bad}) AS affected, count(*) AS total, round(count(*) FILTER ({bad}) / count(*)::DOUBLE, 6) AS rate FROM {table}"


CUSTOMER = {"missing_name": "c_name IS NULL", "negative_balance": "c_acctbal < 0", "unknown_segment": "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"}


@query(" UNION ALL ".join(finding("identity", k, "customer", v) for k, v in CUSTOMER.items()))
def q1_findings(spark, d):
    """Findings of one pass over a table."""
    out = C.findings(scan(spark, d, "customer"), [C.Check("identity", k, F.expr(v)) for k, v in CUSTOMER.items()])
    return out.withColumn("rate", F.round("rate", 6))


@query(f"""WITH {STATS}, g AS (SELECT entity, period, count(DISTINCT prio) AS k, min_by(prio, day::VARCHAR || occ::VARCHAR) AS first_prio FROM stats GROUP BY ALL), c AS (SELECT entity, period, prio, sum(qty) AS q FROM stats GROUP BY ALL), t AS (SELECT entity, period, prio AS main_prio FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY q DESC, prio) AS rn FROM c) WHERE rn = 1)
SELECT period, count(*) AS n, count(*) FILTER (k > 1) AS n_multi, count(*) FILTER (first_prio <> main_prio) AS n_disagree FROM g JOIN t USING (entity, period) GROUP BY period""")
def q3_assignment_audit(spark, d):
    """Q3: first against primary assignment."""
    from ..operators.panel import first_row

    s = stats(spark, d)
    g = s.groupBy("entity", "period").agg(F.count_distinct("prio").alias("k"), F.min_by("prio", F.concat(F.col("day").cast("string"), F.col("occ").cast("string"))).alias("first_prio"))
    t = first_row(s.groupBy("entity", "period", "prio").agg(F.sum("qty").alias("q")), ["entity", "period"], F.desc("q"), "prio").select("entity", "period", F.col("prio").alias("main_prio"))
    return g.join(t, ["entity", "period"]).groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("n_multi"), F.count_if(F.col("first_prio") != F.col("main_prio")).alias("n_disagree"))


@query(f"""WITH {PANEL}, l AS (SELECT entity, period, segment, {LAG.format('qty', 1)} AS q1, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS n_prior, {LAG.format('n_occ', 1)} AS o1 FROM panel),
r AS (SELECT segment, CASE WHEN q1 IS NOT NULL THEN 'present' WHEN n_prior = 0 THEN 'no_history' WHEN n_prior >= 3 THEN 'gap_long' ELSE 'gap' END AS reason FROM l) SELECT segment, reason, count(*) AS n FROM r GROUP BY ALL""")
def q5_missing_reasons(spark, d):
    """Q5, F16: one exclusive reason a row, which the flags are checked for."""
    from ..operators import panel as P

    p = panel(spark, d).select("segment", P.exact_lag("qty", "entity", "period", 1).alias("q1"), P.prior_count("entity", "period").alias("n_prior"))
    reason = F.when(F.col("q1").isNotNull(), "present").when(F.col("n_prior") == 0, "no_history").when(F.col("n_prior") >= 3, "gap_long").otherwise("gap")
    flags = [F.col("q1").isNotNull(), F.col("q1").isNull() & (F.col("n_prior") == 0), F.col("q1").isNull() & F.col("n_prior").between(1, 2), F.col("q1").isNull() & (F.col("n_prior") >= 3)]
    return p.filter(exclusive(flags)).withColumn("reason", reason).groupBy("segment", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, q AS (SELECT entity, segment, period, {LAG.format('target', 1)} AS t1, {LAG.format('target', 2)} AS t2, {LAG.format('target', 3)} AS t3, row_number() OVER (PARTITION BY entity ORDER BY period) AS rn FROM panel),
l AS (SELECT * REPLACE (CASE WHEN entity % 31 = 1 AND rn = 1 THEN 1.0 ELSE t2 END AS t2) FROM q)
SELECT segment, count(*) AS n, count(*) FILTER (rn = 1 AND (t1 IS NOT NULL OR t2 IS NOT NULL OR t3 IS NOT NULL)) AS n_leaks, round(100.0::DOUBLE * count(*) FILTER (t1 IS NULL) / count(*), 6) AS t1_null_pct, round(100.0::DOUBLE * count(*) FILTER (t2 IS NULL) / count(*), 6) AS t2_null_pct, round(100.0::DOUBLE * count(*) FILTER (t3 IS NULL) / count(*), 6) AS t3_null_pct FROM l GROUP BY segment""")
def q9_leakage_audit(spark, d):
    """A first row must have no history (some get one here, to be found); share of missing inputs."""
    from ..operators import panel as P

    p = panel(spark, d).select("segment", "entity", P.prior_count("entity", "period").alias("n_prior"), *(P.exact_lag("target", "entity", "period", k).alias(f"t{k}") for k in (1, 2, 3)))
    p = p.withColumn("t2", F.when((F.col("entity") % 31 == 1) & (F.col("n_prior") == 0), 1.0).otherwise(F.col("t2")))
    leak = (F.col("n_prior") == 0) & F.coalesce("t1", "t2", "t3").isNotNull()
    return p.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(leak).alias("n_leaks"), *(F.round(F.count_if(F.col(f"t{k}").isNull()) * 100.0 / F.count("*"), 6).alias(f"t{k}_null_pct") for k in (1, 2, 3)))


@query(f"""WITH {PANEL}, l AS (SELECT segment, period, {LAG.format('target', 2)} AS t2, {LAG.format('target', 3)} AS t3 FROM panel)
SELECT segment, period, count(*) AS n, count(*) FILTER (t2 IS NOT NULL AND t3 IS NOT NULL) AS n_complete, count(*) FILTER (t2 IS NOT NULL OR t3 IS NOT NULL) AS n_any, count(*) FILTER (t2 IS NOT NULL AND t3 IS NOT NULL) / count(*)::DOUBLE AS complete_rate FROM l GROUP BY ALL""")
def a19_coverage(spark, d):
    """Rows with all and with any of two lags."""
    from ..operators import panel as P

    p = panel(spark, d).select("segment", "period", *(P.exact_lag("target", "entity", "period", k).alias(f"t{k}") for k in (2, 3)))
    return S.coverage(p, ["segment", "period"], ["t2", "t3"])


@query(f"""WITH {PANEL} SELECT segment, count(*) AS n_panel, count(*) FILTER (n_occ >= 2) AS n_enough, count(*) FILTER (n_occ >= 2 AND period > 1995) AS n_after_first FROM panel GROUP BY segment""")
def q8_cohort_flow(spark, d):
    """Q8, P4."""
    return panel(spark, d).groupBy("segment").agg(F.count("*").alias("n_panel"), F.count_if(F.col("n_occ") >= 2).alias("n_enough"), F.count_if((F.col("n_occ") >= 2) & (F.col("period") > 1995)).alias("n_after_first"))


@query(f"""WITH {PANEL}, g AS (SELECT segment, period, grp, count(*) AS n FROM panel GROUP BY ALL) SELECT segment, period, count(*) AS n_groups, count(*) FILTER (n = 1) AS n_alone, count(*) - count(DISTINCT n) AS n_tied, max(n) AS largest FROM g GROUP BY ALL""")
def q6_pool_structure(spark, d):
    """Q6: pools without competitors, ties, coverage."""
    g = panel(spark, d).groupBy("segment", "period", "grp").agg(F.count("*").alias("n"))
    return g.groupBy("segment", "period").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_alone"), (F.count("*") - F.count_distinct("n")).alias("n_tied"), F.max("n").alias("largest"))


@query(f"""WITH {PREDICTIONS}, faulty AS (SELECT segment, entity, period, CASE WHEN entity % 37 = 1 THEN 'Infinity'::DOUBLE WHEN entity % 41 = 1 THEN 'NaN'::DOUBLE ELSE a END AS a, CASE WHEN entity % 11 > 0 THEN m END AS m FROM (SELECT * FROM predictions UNION ALL SELECT * FROM predictions WHERE entity % 43 = 1))
SELECT segment, count(*) AS n, count(*) - count(DISTINCT (entity, period)) AS n_repeated, count(*) FILTER (NOT isfinite(a)) AS n_infinite, count(*) FILTER (m IS NULL) AS n_without_mean FROM faulty GROUP BY segment""")
def e28_prediction_sanity(spark, d):
    """Repeated keys, values that are no numbers and missing means; faults of each kind are put in."""
    p = predictions(spark, d)
    p = p.unionByName(p.filter("entity % 43 = 1"))
    odd = F.when(F.col("entity") % 37 == 1, float("inf")).when(F.col("entity") % 41 == 1, float("nan")).otherwise(F.col("a"))
    p = p.withColumn("a", odd).withColumn("m", F.when(F.col("entity") % 11 > 0, F.col("m")))
    return p.groupBy("segment").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("entity", "period")).alias("n_repeated"), F.count_if(F.isnan("a") | (F.abs("a") == float("inf"))).alias("n_infinite"), F.count_if(F.col("m").isNull()).alias("n_without_mean"))
