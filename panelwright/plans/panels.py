"""Targets, lags and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import panel as P
from .base import PANEL, STATS, Query, panel, registered, scan, stats

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"WITH {PANEL} SELECT entity, period, n_occ, qty, price, disc, segment, grp, total_score, target FROM panel")
def d1_target_panel(spark, d):
    """Score, sums, last known segment and group, occurrences."""
    return panel(spark, d).select("entity", "period", "n_occ", "qty", "price", "disc", "segment", "grp", "total_score", "target")


@query(f"WITH {PANEL} SELECT entity, period, n_occ, target FROM panel WHERE n_occ >= 2 AND target IS NOT NULL AND isfinite(target)")
def p5_eligible_targets(spark, d):
    return P.eligible(panel(spark, d), 2).select("entity", "period", "n_occ", "target")


LAG = "max({0}) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN {1} PRECEDING AND {1} PRECEDING)"


@query(f"""WITH {PANEL} SELECT entity, period, segment, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS n_prior,
  {LAG.format('target', 1)} AS target_1, {LAG.format('target', 2)} AS target_2, {LAG.format('target', 3)} AS target_3, {LAG.format('qty', 1)} AS qty_1, {LAG.format('n_occ', 1)} AS n_occ_1,
  round(avg(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean_3,
  {LAG.format('target', 1)} - {LAG.format('target', 2)} AS change FROM panel""")
def d2_lagged_panel(spark, d):
    """Exact-period lags, mean of what there is, change, prior periods."""
    lag = lambda x, k: P.exact_lag(x, "entity", "period", k)
    return panel(spark, d).select(
        "entity", "period", "segment", P.prior_count("entity", "period").alias("n_prior"),
        *(lag("target", k).alias(f"target_{k}") for k in (1, 2, 3)), lag("qty", 1).alias("qty_1"), lag("n_occ", 1).alias("n_occ_1"),
        F.round(P.recent_mean("target", "entity", "period", 3), 6).alias("mean_3"), (lag("target", 1) - lag("target", 2)).alias("change"),
    )


@query(f"""WITH {PANEL}, l AS (SELECT entity, period, {LAG.format('qty', 1)} AS q1, {LAG.format('qty', 2)} AS q2, {LAG.format('qty', 3)} AS q3 FROM panel)
SELECT entity, period, round((coalesce(q1 * 0.5, 0) + coalesce(q2 * 0.33, 0) + coalesce(q3 * 0.17, 0)) / nullif(CASE WHEN q1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN q2 IS NULL THEN 0 ELSE 0.33 END + CASE WHEN q3 IS NULL THEN 0 ELSE 0.17 END, 0)::DOUBLE, 6) AS durability FROM l""")
def w5_weighted_history(spark, d):
    """W5, D13."""
    return panel(spark, d).select("entity", "period", F.round(P.weighted_history("qty", "entity", "period", (0.50, 0.33, 0.17)), 6).alias("durability"))


@query("""SELECT c_custkey AS entity, round(least(1.0, CASE WHEN y >= 2000 THEN n / 17.0::DOUBLE ELSE n / 16.0::DOUBLE END), 6) AS availability,
  2000 - year(b)::INT - CASE WHEN month(b) > 9 OR (month(b) = 9 AND day(b) > 1) THEN 1 ELSE 0 END AS age, round(date_diff('day', b, DATE '2000-09-01') / 365.2425::DOUBLE, 6) AS exact_age,
  CASE WHEN y - 1996 >= 0 THEN y - 1996 END AS experience, greatest(0, y - 1996) AS experience_clipped, CASE WHEN c_acctbal > 0 THEN round(n / c_acctbal, 6) END AS guarded,
  round(least(c_acctbal, 3000.0), 4) AS below, round(greatest(c_acctbal - 3000.0, 0.0), 4) AS above, round(ln(1 + greatest(c_acctbal, 0.0)), 6) AS log_amount,
  CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'mid' ELSE 'high' END AS bucket
FROM (SELECT *, (c_custkey % 20)::INT AS n, (1994 + c_custkey % 9)::INT AS y, DATE '1960-01-01' + (c_custkey * 37 % 9000)::INT AS b FROM customer)""")
def f_scalar_features(spark, d):
    """Guarded ratio, ages, experience, clip, knots, log, buckets, availability."""
    x = scan(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), "c_acctbal", (F.col("c_custkey") % 20).cast("int").alias("n"), (1994 + F.col("c_custkey") % 9).cast("int").alias("y"),
        F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 37 % 9000).cast("int")).alias("b"),
    )
    below, above = E.knots("c_acctbal", 3000.0)
    return x.select(
        "entity", F.round(E.availability(F.col("n").cast("double"), "y", 2000), 6).alias("availability"), E.age_at("b", F.lit(2000)).alias("age"),
        F.round(E.fractional_age("b", F.lit(2000)), 6).alias("exact_age"), E.experience("y", F.lit(1996)).alias("experience"), E.experience("y", F.lit(1996), True).alias("experience_clipped"),
        F.round(E.ratio("n", "c_acctbal"), 6).alias("guarded"), F.round(below, 4).alias("below"), F.round(above, 4).alias("above"), F.round(E.log_amount("c_acctbal"), 6).alias("log_amount"),
        E.buckets("c_acctbal", (0, 2500, 7500), ("debt", "low", "mid", "high")).alias("bucket"),
    )


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'OLD' WHEN 'Brand#12' THEN 'NEW' ELSE p_brand END AS brand, (p_size > 25)::INT AS is_large, coalesce((nullif(p_size % 7, 0) <= 3)::INT, 0) AS near_line,
  (nullif(p_size % 5, 0) IS NULL)::INT + (nullif(p_size % 3, 0) IS NULL)::INT AS n_missing, (nullif(p_size % 5, 0) IS NULL OR nullif(p_size % 3, 0) IS NULL) AS any_missing,
  coalesce(nullif(p_size % 5, 0), p_size % 3) AS preferred, (nullif(p_size % 5, 0) <> nullif(p_size % 3, 0))::INT AS changed, round(1 - (p_size - 1) / 49.0::DOUBLE, 6) AS size_score, abs(p_retailprice - round(p_retailprice, 0)) <= 0.25 AS near_whole,
  CASE WHEN p_size % 5 >= p_size % 3 * 1.5 THEN 'expanded' WHEN p_size % 5 <= p_size % 3 * 0.5 THEN 'collapsed' ELSE 'stable' END AS change_class, CASE WHEN p_size % 7 > 0 AND p_size % 4 > 0 THEN try_cast(substr(p_brand, 7, 2) AS DOUBLE) END AS lenient, substr(p_brand, 7, 2)::INT AS brand_no, round((p_size - 1) / 49.0::DOUBLE, 6) AS worst_first,
  (p_size % 3 = 0)::INT AS is_zero, (p_size % 3 = 1)::INT AS is_one FROM part""")
def f_flags(spark, d):
    """Aliases, flags, missing counts, preference, change, closeness, one-hot."""
    five, three = F.expr("nullif(p_size % 5, 0)"), F.expr("nullif(p_size % 3, 0)")
    x = scan(spark, d, "part").withColumns({"five": five, "three": three, "kind": F.expr("case p_size % 3 when 0 then 'zero' when 1 then 'one' else 'two' end")})
    return x.select(
        "p_partkey", E.renamed("p_brand", {"Brand#11": "OLD", "Brand#12": "NEW"}).alias("brand"), (F.col("p_size") > 25).cast("int").alias("is_large"), E.flag(F.expr("nullif(p_size % 7, 0) <= 3")).alias("near_line"),
        E.missing_count(["five", "three"]).alias("n_missing"), E.any_missing(["five", "three"]).alias("any_missing"), F.coalesce("five", F.expr("p_size % 3")).alias("preferred"), E.changed("five", "three").alias("changed"),
        F.round(E.rank_score("p_size", 50), 6).alias("size_score"), E.close("p_retailprice", F.round("p_retailprice", 0), 0.25).alias("near_whole"),
        E.change_class(F.expr("p_size % 5"), F.expr("p_size % 3"), 0.5).alias("change_class"), E.lenient(F.expr("case when p_size % 7 = 0 then 'NaN' when p_size % 4 = 0 then 'x' else substr(p_brand, 7, 2) end")).alias("lenient"),
        E.strict(F.substring("p_brand", 7, 2), "int").alias("brand_no"), F.round(E.rank_score("p_size", 50, best_first=False), 6).alias("worst_first"), *E.one_of("kind", ["zero", "one"]),
    )


@query(r"""WITH n AS (SELECT c_custkey AS entity, CASE c_custkey % 4 WHEN 0 THEN 'D.J. ' || c_name || ' Jr.' WHEN 1 THEN 'Zoé O''' || c_name WHEN 2 THEN c_name || ' III' ELSE 'Sr ' || c_name END AS name FROM customer),
f AS (SELECT entity, lower(regexp_replace(translate(name, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC'), '[^\x00-\x7F]', '', 'g')) AS low FROM n)
SELECT entity, regexp_replace(regexp_replace(low, '\b(jr|sr|ii|iii|iv)\b', '', 'g'), '[^a-z0-9]', '', 'g') AS compact,
  regexp_replace(trim(regexp_replace(regexp_replace(low, '[''.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '( (jr|sr|ii|iii|iv|v))+$', '') AS spaced FROM f""")
def f19_name_keys(spark, d):
    """F19, F20."""
    name = F.expr("case c_custkey % 4 when 0 then 'D.J. ' || c_name || ' Jr.' when 1 then 'Zoé O\\'' || c_name when 2 then c_name || ' III' else 'Sr ' || c_name end")
    return scan(spark, d, "customer").select(F.col("c_custkey").alias("entity"), E.compact_key(name).alias("compact"), E.spaced_key(name).alias("spaced"))


@query("""SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), LATERAL (SELECT string_split(line, ' ')[1] AS word) WHERE length(word) > 0 GROUP BY lang, word""")
def f28_exploded_list(spark, d):
    """Split, explode, first word of each line."""
    lines = scan(spark, d, "documents").select("lang", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("word", F.get(F.split("line", " "), F.lit(0))).filter("length(word) > 0").groupBy("lang", "word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {STATS} SELECT segment, period, round(least(1.0, sum(n_lines) FILTER (qty > 0) / sum(n_lines / (least(1.0, n_lines / 7.0::DOUBLE))) FILTER (qty > 0)), 6) AS share FROM stats GROUP BY segment, period""")
def f30_implied_share(spark, d):
    """F30, D26."""
    s = stats(spark, d).withColumn("share", F.least(F.lit(1.0), F.col("n_lines") / 7.0))
    return s.filter("qty > 0").groupBy("segment", "period").agg(F.round(E.implied_share(F.col("n_lines"), F.col("share")), 6).alias("share"))
