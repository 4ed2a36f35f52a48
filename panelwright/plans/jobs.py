"""Feature jobs: composites of panels, pools, contexts and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import ranks as R
from ..operators import asof, contracts, peers
from ..operators import panel as P
from ..operators.places import Rank, with_ranks
from .base import PANEL, PREDICTIONS, STATS, SUMS, WEIGHTS, Query, held, panel, parts_of, predictions, registered, scan, scratch, stats
from .panels import LAG

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)


@query(f"""WITH {STATS}, x AS (SELECT * FROM stats UNION ALL SELECT * FROM stats WHERE occ % 11 = 0), k AS (SELECT entity, period, occ, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT entity, period, count(*) AS n_occ, sum(qty)::BIGINT AS qty FROM (SELECT entity, period, occ, max(qty) AS qty FROM x GROUP BY ALL) GROUP BY ALL)
SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM k WHERE n > 1) AS n_duplicate_keys, (SELECT count(*) FROM p) AS n_targets, (SELECT count(*) FROM p WHERE n_occ >= 2) AS n_eligible, (SELECT sum(qty)::BIGINT FROM p WHERE n_occ >= 2) AS qty""")
def d1_target_audit(spark, d):
    """The audit of a target build: repeated (entity, occurrence) keys are refused, and one of each goes on."""
    s = stats(spark, d)
    x = held(s.unionByName(s.filter("occ % 11 = 0")), "stats")
    once = x if contracts.duplicate_keys(x, ["entity", "period", "occ"]).isEmpty() else x.dropDuplicates(["entity", "period", "occ"])
    p = held(P.checked_targets(once, "entity", "period", "segment", "sub", "occ", "grp", WEIGHTS, ("qty", "price", "disc")), "targets")
    return P.target_audit(x, p, ["entity", "period", "occ"], 2, F.sum(F.when(F.col("n_occ") >= 2, F.col("qty"))).alias("qty"))


MEASURES = ("target", "n_occ", "qty", "price", "disc", "total_score")
RATES = {"qty_per_occ": ("qty", "n_occ"), "price_per_occ": ("price", "n_occ"), "disc_per_occ": ("disc", "n_occ"), "unit_price": ("price", "qty"), "disc_rate": ("disc", "price"), "unit_disc": ("disc", "qty"), "score_per_unit": ("total_score", "qty"), "score_rate": ("total_score", "price")}


@query(f"""WITH {PANEL}, x AS (SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE END AS {k}' for k, (a, b) in RATES.items())} FROM panel)
SELECT entity, period, segment, {', '.join(f'{LAG.format(x, 1)} AS {x}_1' for x in (*MEASURES, *RATES))} FROM x""")
def d2_wide_lags(spark, d):
    """Fourteen measures and rates of the period before, over one exchange."""
    x = panel(spark, d).withColumns({k: E.ratio(a, b) for k, (a, b) in RATES.items()})
    return x.select("entity", "period", "segment", *(P.exact_lag(c, "entity", "period", 1).alias(f"{c}_1") for c in (*MEASURES, *RATES)))


@query(f"""WITH {PANEL}, e AS (SELECT o_custkey AS entity, min(o_orderdate::DATE) AS entry FROM orders GROUP BY ALL), m AS (SELECT c_custkey AS entity, entry, year(entry)::INT AS first_year, CASE WHEN c_nationkey % 3 > 0 THEN (c_nationkey % 3)::INT END AS round FROM customer LEFT JOIN e ON e.entity = c_custkey)
SELECT p.entity, p.period, period - year(entry)::INT - CASE WHEN month(entry) > 9 OR (month(entry) = 9 AND day(entry) > 1) THEN 1 ELSE 0 END AS age, round(date_diff('day', entry, make_date(period, 9, 1)) / 365.2425::DOUBLE, 6) AS exact_age, CASE WHEN period >= first_year THEN period - first_year END AS experience, round, (round IS NULL)::INT AS undrafted FROM panel p LEFT JOIN m ON p.entity = m.entity""")
def d3_attributes(spark, d):
    """D3: what is known of an entity at the cutoff of each period: age since entry, experience, class and a flag for none."""
    entry = scan(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.min(F.to_date("o_orderdate")).alias("entry"))
    master = scan(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") % 3).cast("int").alias("round")).join(entry, "entity", "left")
    both = contracts.checked_join(panel(spark, d).select("entity", "period"), master, ["entity"])
    return both.select(
        "entity", "period", E.age_at("entry", "period").alias("age"), F.round(E.fractional_age("entry", "period"), 6).alias("exact_age"),
        E.experience("period", F.year("entry")).alias("experience"), "round", F.col("round").isNull().cast("int").alias("undrafted"),
    )


@query(f"""WITH {STATS}, l AS (SELECT grp, period, entity AS leader, 'legacy' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY grp, period ORDER BY sub, prio, occ) AS rn FROM stats WHERE period < 1998) WHERE rn = 1), s AS (SELECT grp, period, entity AS leader, 'as_of' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY grp, period ORDER BY day DESC, prio, occ) AS rn FROM stats WHERE period >= 1998 AND sub < 9) WHERE rn = 1), u AS (SELECT * FROM l UNION ALL SELECT * FROM s),
o AS (SELECT grp, period, leader + 1 AS leader, 'override' AS origin FROM u WHERE grp = 7) SELECT * FROM u WHERE grp <> 7 UNION ALL SELECT * FROM o""")
def d6_projected_leaders(spark, d):
    """One leader a group and period: the first of the early periods' charts, the newest row before the cutoff in later ones, and overrides."""
    s = stats(spark, d).select("grp", "period", "sub", "prio", "occ", "day", "entity")
    legacy = P.first_row(s.filter("period < 1998"), ["grp", "period"], "sub", "prio", "occ").withColumn("origin", F.lit("legacy"))
    later = asof.latest_before(s.filter("period >= 1998"), ["grp", "period"], "day", F.make_date("period", F.lit(9), F.lit(1)), "prio", "occ").withColumn("origin", F.lit("as_of"))
    both = legacy.unionByName(later).select("grp", "period", F.col("entity").alias("leader"), "origin")
    return contracts.overridden(both, both.filter("grp = 7").select("grp", "period", (F.col("leader") + 1).alias("leader"), F.lit("override").alias("origin")), ["grp", "period"])


ENVIRONMENT = {"qty_per_occ": ("qty", "n_occ"), "price_per_occ": ("price", "n_occ"), "lines_per_occ": ("lines", "n_occ"), "urgent_rate": ("urgent", "n_occ"), "open_rate": ("still_open", "n_occ"), "unit_price": ("price", "qty"), "disc_rate": ("disc", "price"), "qty_per_sub": ("qty", "subs")}


@query(f"""WITH {STATS}, g AS (SELECT grp, period + 1 AS period, count(*) AS n_occ, sum(qty)::BIGINT AS qty, sum(price)::BIGINT AS price, sum(disc)::BIGINT AS disc, sum(n_lines)::BIGINT AS lines, count(*) FILTER (prio <= 2) AS urgent, count(*) FILTER (status = 'O') AS still_open, count(DISTINCT sub) AS subs FROM stats GROUP BY grp, period)
SELECT grp, period, {', '.join(f'CASE WHEN {b} > 0 THEN round({a} / {b}::DOUBLE, 6) END AS {k}' for k, (a, b) in ENVIRONMENT.items())} FROM g""")
def d8_environment(spark, d):
    """Eight rates of a group in the period before."""
    g = stats(spark, d).groupBy("grp", (F.col("period") + 1).alias("period")).agg(
        F.count("*").alias("n_occ"), *(F.sum(x).alias(x) for x in ("qty", "price", "disc")), F.sum("n_lines").alias("lines"), F.count_if(F.col("prio") <= 2).alias("urgent"), F.count_if(F.col("status") == "O").alias("still_open"), F.count_distinct("sub").alias("subs")
    )
    return g.select("grp", "period", *(F.round(E.ratio(a, b), 6).alias(k) for k, (a, b) in ENVIRONMENT.items()))


@query(f"""WITH {PANEL}, l AS (SELECT entity, period, segment, {LAG.format('qty', 1)} AS q1, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS n_prior FROM panel), w AS (SELECT o_custkey AS entity, year(o_orderdate)::INT + 1 AS period, count(*) FILTER (o_orderstatus = 'F') AS documented FROM orders GROUP BY ALL)
SELECT l.entity, l.period, CASE WHEN q1 IS NOT NULL AND q1 >= 100 THEN 'present' WHEN q1 IS NOT NULL AND coalesce(documented, 0) > 0 THEN 'few_documented' WHEN q1 IS NOT NULL THEN 'few' WHEN n_prior = 0 THEN 'none' ELSE 'gap' END AS reason FROM l LEFT JOIN w USING (entity, period)""")
def d14_leader_reasons(spark, d):
    """Why a leader has no usable rating: its prior workload crossed with a second, documented source."""
    l = panel(spark, d).select("entity", "period", P.exact_lag("qty", "entity", "period", 1).alias("q1"), P.prior_count("entity", "period").alias("n_prior"))  # noqa: E741
    w = scan(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), (F.year("o_orderdate") + 1).alias("period")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("documented"))
    q, doc = F.col("q1"), E.filled("documented") > 0
    flags = {"present": q.isNotNull() & (q >= 100), "few_documented": q.isNotNull() & (q < 100) & doc, "few": q.isNotNull() & (q < 100) & ~doc, "none": q.isNull() & (F.col("n_prior") == 0), "gap": q.isNull() & (F.col("n_prior") > 0)}
    both = contracts.checked_join(l, w, ["entity", "period"]).filter(E.exclusive(list(flags.values())))
    return both.select("entity", "period", F.coalesce(*(F.when(x, name) for name, x in flags.items())).alias("reason"))


@query(f"""WITH {PANEL}, m AS (SELECT segment, period + 1 AS period, entity, rank() OVER (PARTITION BY segment, period ORDER BY price DESC) AS market FROM panel WHERE n_occ >= 2), h AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS n_prior FROM panel)
SELECT h.segment, h.period, count(*) AS n_cohort, count(market) AS n_matched, round(count(market) / count(*)::DOUBLE, 6) AS match_rate, min(market) AS best_market FROM h LEFT JOIN m ON h.segment = m.segment AND h.period = m.period AND h.entity = m.entity WHERE n_prior >= 1 GROUP BY ALL""")
def d15_market_coverage(spark, d):
    """How much of the cohort with history the market covers."""
    p = panel(spark, d).withColumn("n_prior", P.prior_count("entity", "period"))
    k = p.filter("n_occ >= 2").select("segment", (F.col("period") + 1).alias("period"), "entity", "price")
    m = with_ranks(k, ["segment", "period"], {"market": Rank("price", "low", True)}).drop("price")
    both = contracts.checked_join(p.filter("n_prior >= 1"), m, ["segment", "period", "entity"])
    return both.groupBy("segment", "period").agg(F.count("*").alias("n_cohort"), F.count("market").alias("n_matched"), F.round(F.count("market") / F.count("*"), 6).alias("match_rate"), F.min("market").alias("best_market"))


@query(f"""WITH {STATS}, x AS (SELECT prio, sum(qty)::DOUBLE / count(*) AS expected FROM stats GROUP BY prio) SELECT entity, period, count(*) AS n, round(sum(qty - expected), 5) AS above_expected, round(avg(qty / expected), 6) AS ratio FROM stats JOIN x USING (prio) GROUP BY entity, period""")
def d16_expected(spark, d):
    """What an entity has above what its kind of occurrence lets expect."""
    s = stats(spark, d)
    x = s.groupBy("prio").agg((F.sum("qty").cast("double") / F.count("*")).alias("expected"))
    both = contracts.checked_join(s.select("entity", "period", "prio", "qty"), x, ["prio"])
    return both.groupBy("entity", "period").agg(F.count("*").alias("n"), F.round(F.sum(F.col("qty") - F.col("expected")), 5).alias("above_expected"), F.round(F.avg(F.col("qty") / F.col("expected")), 6).alias("ratio"))


@query(f"""WITH {STATS}, ext AS (SELECT c_name AS ext_id, c_custkey AS entity FROM customer), f AS (SELECT ext_id, period, avg(n_lines) AS v FROM stats JOIN ext USING (entity) WHERE status = 'F' GROUP BY ALL), o AS (SELECT entity, period, avg(n_lines) AS v FROM stats WHERE status = 'O' GROUP BY ALL), b AS (SELECT entity, period, v FROM f JOIN ext USING (ext_id))
SELECT entity, period, round(coalesce(b.v, o.v), 6) AS rate, CASE WHEN b.v IS NOT NULL THEN 'external' ELSE 'own' END AS origin FROM b FULL JOIN o USING (entity, period)""")
def d20_external_rates(spark, d):
    """Rates of a source that has ids of its own, brought over by a bridge that is unique both ways, and preferred where there is one."""
    s = stats(spark, d)
    bridge = scan(spark, d, "customer").select(F.col("c_name").alias("ext_id"), F.col("c_custkey").alias("entity"))
    bridge = contracts.assert_unique(contracts.assert_unique(bridge, ["ext_id"]), ["entity"])
    external = held(s.filter("status = 'F'").join(bridge, "entity").groupBy("ext_id", "period").agg(F.avg("n_lines").alias("v")), "external")
    brought = external.join(bridge, "ext_id").select("entity", "period", F.col("v").alias("external"))
    own = s.filter("status = 'O'").groupBy("entity", "period").agg(F.avg("n_lines").alias("own"))
    both = contracts.matched(brought, own, ["entity", "period"])
    return both.select("entity", "period", F.round(F.coalesce("external", "own"), 6).alias("rate"), F.when(F.col("external").isNotNull(), "external").otherwise("own").alias("origin"))


SIX = f"""{STATS}, {PANEL[PANEL.index("panel AS ("):]},
base AS (SELECT entity, period, segment, grp, max(grp) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_grp FROM panel),
opp AS (SELECT entity, period + 1 AS period, qty AS opp_qty, n_occ AS opp_occ FROM panel),
deep AS (SELECT entity, period + 1 AS period, grp, sum(qty) FILTER (n_lines >= 5) / sum(qty)::DOUBLE AS deep_share, sum(qty) FILTER (prio = 1) / sum(qty)::DOUBLE AS urgent_share FROM stats GROUP BY entity, period, grp),
grps AS (SELECT grp, period + 1 AS period, sum(qty)::BIGINT AS grp_qty FROM panel GROUP BY grp, period),
part AS (SELECT entity, period + 1 AS period, grp, count(*) FILTER (sub <= 6) / count(*)::DOUBLE AS early_rate FROM stats WHERE prio > 1 GROUP BY entity, period, grp),
track AS (SELECT entity, period + 1 AS period, avg(price)::DOUBLE AS mean_price FROM stats WHERE n_lines >= 4 GROUP BY entity, period),
ext AS (SELECT entity, period + 2 AS period, disc AS old_disc FROM panel WHERE entity % 3 > 0),
six AS (SELECT b.entity, b.period, b.segment, opp_qty, opp_occ, coalesce(deep_share, 0) AS deep_share, coalesce(urgent_share, 0) AS urgent_share, grp_qty, early_rate, mean_price, old_disc,
  (early_rate IS NOT NULL)::INT AS part_known, (mean_price IS NOT NULL)::INT AS track_known, (old_disc IS NOT NULL)::INT AS ext_known
  FROM base b LEFT JOIN opp o ON o.entity = b.entity AND o.period = b.period LEFT JOIN deep d ON d.entity = b.entity AND d.period = b.period AND d.grp = b.prev_grp LEFT JOIN grps g ON g.grp = b.grp AND g.period = b.period
  LEFT JOIN part p ON p.entity = b.entity AND p.period = b.period AND p.grp = b.prev_grp LEFT JOIN track t ON t.entity = b.entity AND t.period = b.period LEFT JOIN ext e ON e.entity = b.entity AND e.period = b.period)"""
GROUPS = {"opportunity": ["opp_qty", "opp_occ"], "group": ["grp_qty"], "participation": ["early_rate"], "tracking": ["mean_price", "old_disc"], "routes": ["routes_run", "old_disc"]}


def yearly(spark, d):
    """The panel with what the six sources need of its stat rows, in one pass over them, written; grp_mixed where an entity has several groups in a period."""
    share = lambda c: F.sum(F.when(c, F.col("qty"))) / F.sum("qty")
    one = F.min("grp").eqNullSafe(F.max("grp")) & F.count("grp").isin(F.lit(0), F.count("*"))
    more = (
        share(F.col("n_lines") >= 5).alias("deep_share"), share(F.col("prio") == 1).alias("urgent_share"), F.try_divide(F.count_if((F.col("prio") > 1) & (F.col("sub") <= 6)), F.count_if(F.col("prio") > 1)).alias("early_rate"),
        F.avg(F.when(F.col("n_lines") >= 4, F.col("price"))).alias("mean_price"), F.min("grp").alias("stat_grp"), (~one).alias("grp_mixed"),
    )
    p = P.targets(stats(spark, d), "entity", "period", "segment", "sub", "occ", "grp", WEIGHTS, SUMS, *more)
    return held(p.withColumn("prev_grp", P.exact_lag("grp", "entity", "period", 1)), "yearly")


def six_sources(spark, d):
    """Each row of the panel with six sources: five by entity and period in one exchange, two of them only for the group of the period before, and one by group and period."""
    p = yearly(spark, d)
    later = lambda k: (F.col("period") + k).alias("period")
    base, past = p.select("entity", "period", "segment", "grp", "prev_grp"), p.filter("period IS NOT NULL")
    # An entity's sources by group have one group a period: customers stay in their nation.
    sources = {
        "opportunity": past.select("entity", later(1), F.col("qty").alias("opp_qty"), F.col("n_occ").alias("opp_occ")),
        "deep": past.select("entity", later(1), F.col("stat_grp").alias("deep_grp"), F.col("grp_mixed").alias("deep_mixed"), "deep_share", "urgent_share"),
        "part": past.filter("early_rate IS NOT NULL").select("entity", later(1), F.col("stat_grp").alias("part_grp"), "early_rate"),
        "track": past.filter("mean_price IS NOT NULL").select("entity", later(1), "mean_price"),
        "ext": past.filter("entity % 3 > 0").select("entity", later(2), F.col("disc").alias("old_disc")),
    }
    met = contracts.assembled(base, sources, ["entity", "period"], parts_of(spark, p.count() * (1 + len(sources))))
    grps = held(p.groupBy("grp", "period").agg(F.sum("qty").alias("grp_qty")).select("grp", later(1), "grp_qty"), "groups")  # its size is known where it is joined
    both = contracts.checked_join(met, grps, ["grp", "period"])
    several = F.raise_error(F.lit("an entity has several groups in a period"))
    of = lambda c, g: F.when(F.col("deep_mixed"), several.cast("double")).when(F.col(g) == F.col("prev_grp"), F.col(c))
    known = lambda c, name: F.col(c).isNotNull().cast("int").alias(name)
    out = both.select("entity", "period", "segment", "opp_qty", "opp_occ", *(F.coalesce(of(c, "deep_grp"), F.lit(0.0)).alias(c) for c in ("deep_share", "urgent_share")), "grp_qty", of("early_rate", "part_grp").alias("early_rate"), "mean_price", "old_disc")
    return out.select("*", known("early_rate", "part_known"), known("mean_price", "track_known"), known("old_disc", "ext_known"))


@query(f"WITH {SIX} SELECT * REPLACE (round(deep_share, 6) AS deep_share, round(urgent_share, 6) AS urgent_share, round(early_rate, 6) AS early_rate, round(mean_price, 3) AS mean_price) FROM six")
def d21_assembled(spark, d):
    """Six sources assembled, zeros filled in where a share is missing, flags that say what is known."""
    six = six_sources(spark, d)
    return six.withColumns({**{x: F.round(x, 6) for x in ("deep_share", "urgent_share", "early_rate")}, "mean_price": F.round("mean_price", 3)})


@query(f"WITH {SIX}, c AS (" + " UNION ALL ".join(f"SELECT segment, period, '{g}' AS feature_group, count(*) AS n, {'0' if 'routes_run' in fs else 'count(*) FILTER (' + ' AND '.join(f'{f} IS NOT NULL' for f in fs) + ')'} AS n_complete, count(*) FILTER ({' OR '.join(f'{f} IS NOT NULL' for f in fs if f != 'routes_run')}) AS n_any, '{'routes_run' if 'routes_run' in fs else ''}' AS omitted FROM six GROUP BY segment, period" for g, fs in GROUPS.items()) + ") SELECT *, round(n_any / n::DOUBLE, 6) AS any_rate FROM c")
def d21_coverage(spark, d):
    """Rows with all and with any feature of a group, by segment and period, and the features that no source has."""
    return contracts.group_coverage(six_sources(spark, d), ["segment", "period"], GROUPS).withColumn("any_rate", F.round("any_rate", 6))


@query(f"""WITH {STATS}, y AS (SELECT entity, period, CASE WHEN count(DISTINCT prio) = 1 THEN min(prio) END AS amount, count(DISTINCT prio) > 1 AS conflict FROM stats GROUP BY ALL) SELECT entity, period + 1 AS period, amount, conflict FROM y""")
def d22_nested_history(spark, d):
    """Amounts of the period before out of each entity's nested history; where its entries disagree, none."""
    nested = stats(spark, d).groupBy("entity", "period").agg(F.collect_set("prio").alias("amounts")).groupBy("entity").agg(F.collect_list(F.struct("period", "amounts")).alias("history"))  # five amounts, as many periods as there are
    path = scratch(spark, "history")
    nested.write.json(path)
    rows = spark.read.schema("entity bigint, history array<struct<period int, amounts array<int>>>").json(path).select("entity", F.inline("history"))
    several = F.size("amounts") > 1
    return rows.select("entity", (F.col("period") + 1).alias("period"), F.when(~several, F.get("amounts", F.lit(0))).alias("amount"), several.alias("conflict"))


ROLE = f"""{PANEL}, g AS (SELECT grp, segment, period, sum(qty) AS total, count(*) AS pool FROM panel GROUP BY ALL), r AS (SELECT p.entity, p.period, p.segment, p.grp, p.qty, CASE WHEN p.qty / g.total::DOUBLE >= 0.3 THEN 'lead' WHEN p.qty / g.total::DOUBLE >= 0.1 THEN 'support' ELSE 'depth' END AS role, pool FROM panel p JOIN g ON p.grp = g.grp AND p.segment = g.segment AND p.period = g.period),
f AS (SELECT entity, period, segment, grp, qty, role, pool, max(role) OVER w AS role_1, max(qty) OVER w AS qty_1 FROM r WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING))"""


def roles(spark, d):
    by = ["grp", "segment", "period"]
    share = F.col("qty") / R.total_of("qty", by)
    r = panel(spark, d).select("entity", "period", "segment", "grp", "qty", R.total_of(F.lit(1), by).alias("pool"), F.when(share >= 0.3, "lead").when(share >= 0.1, "support").otherwise("depth").alias("role"))
    return r.withColumns({"role_1": P.exact_lag("role", "entity", "period", 1), "qty_1": P.exact_lag("qty", "entity", "period", 1)})


@query(f"""WITH {ROLE} SELECT entity, period, segment, role AS label, role_1, qty_1, pool, (role_1 IS NOT NULL)::INT AS covered FROM f""")
def d28_role_table(spark, d):
    """Role of the target period as the label, roles and measures of the period before as inputs, and whether these are there."""
    return roles(spark, d).select("entity", "period", "segment", F.col("role").alias("label"), "role_1", "qty_1", "pool", F.col("role_1").isNotNull().cast("int").alias("covered"))


@query(f"""WITH {ROLE}, e AS (SELECT grp, period + 1 AS period, sum(qty)::BIGINT AS grp_qty FROM panel GROUP BY grp, period), v AS (SELECT a.grp, a.segment, a.period + 1 AS period, coalesce(sum(a.qty) FILTER (b.entity IS NULL), 0)::BIGINT AS vacated FROM panel a LEFT JOIN panel b ON a.entity = b.entity AND a.grp = b.grp AND a.segment = b.segment AND b.period = a.period + 1 GROUP BY ALL),
s AS (SELECT c_custkey AS entity, y::INT AS period, c_mktsegment AS segment, c_nationkey AS grp FROM customer, range(1996, 2002) t(y))
SELECT s.entity, s.period, s.segment, role_1, coalesce(qty_1, 0) AS qty_1, coalesce(grp_qty, 0) AS grp_qty, coalesce(vacated, 0) AS vacated, (qty_1 IS NOT NULL)::INT AS has_history, CASE WHEN qty_1 IS NULL THEN 1 ELSE 0 END + CASE WHEN grp_qty IS NULL THEN 1 ELSE 0 END AS n_missing
FROM s LEFT JOIN (SELECT entity, period + 1 AS period, role AS role_1, qty AS qty_1 FROM r) h ON s.entity = h.entity AND s.period = h.period LEFT JOIN e ON s.grp = e.grp AND s.period = e.period LEFT JOIN v ON s.grp = v.grp AND s.segment = v.segment AND s.period = v.period""")
def d29_role_utility(spark, d):
    """Every entity of a period's snapshot, also those without history, with its role, group and what was vacated."""
    p = held(roles(spark, d), "roles")
    nxt = (F.col("period") + 1).alias("period")
    h = p.select("entity", nxt, F.col("role").alias("role_1"), F.col("qty").alias("qty_1"))
    e = p.groupBy("grp", nxt).agg(F.sum("qty").alias("grp_qty"))
    prior = p.select("entity", "grp", "segment", nxt, "qty")
    v = peers.vacated(prior, p, ["grp", "segment", "period"], "entity", "qty").select("grp", "segment", "period", "vacated")
    snapshot = scan(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.sequence(F.lit(1996), F.lit(2001))).alias("period"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp"))
    out = contracts.checked_join(snapshot, h, ["entity", "period"])
    out = contracts.checked_join(contracts.checked_join(out, e, ["grp", "period"]), v, ["grp", "segment", "period"])
    missing = F.col("qty_1").isNull().cast("int") + F.col("grp_qty").isNull().cast("int")
    return out.select("entity", "period", "segment", "role_1", *(E.filled(x).alias(x) for x in ("qty_1", "grp_qty", "vacated")), F.col("qty_1").isNotNull().cast("int").alias("has_history"), missing.alias("n_missing"))


COMPETITORS = f"""{PREDICTIONS}, x AS (SELECT segment, grp, period, entity, actual, b, n_occ::BIGINT AS load, CASE WHEN n_prior >= 2 THEN a / (a + m) END AS p FROM predictions),
w AS (SELECT s.entity, s.period, count(o.entity) AS n_others, count(o.p) AS n_known, count(o.entity) FILTER (o.p IS NULL) AS n_unknown, coalesce(sum(o.p), 0) AS effective, coalesce(sum(o.p * o.load), 0) AS burden, max(o.p) AS best, max(o.load) AS max_load, sum(o.load)::BIGINT AS sum_load, count(o.entity) FILTER (o.p > s.p) AS n_ahead FROM x s LEFT JOIN x o ON s.segment = o.segment AND s.grp = o.grp AND s.period = o.period AND s.entity <> o.entity GROUP BY s.entity, s.period)"""


def competitors(spark, d):
    by = ["segment", "grp", "period"]
    x = predictions(spark, d).select(*by, "entity", "actual", "b", F.col("n_occ").alias("load"), F.when(F.col("n_prior") >= 2, F.col("a") / (F.col("a") + F.col("m"))).alias("p"))
    return peers.effective(x, by, "entity", "p", "load")


@query(f"WITH {COMPETITORS} SELECT entity, period, n_others, n_known, n_unknown, round(effective, 6) AS effective, round(burden, 6) AS burden, round(best, 6) AS best, max_load, sum_load, n_ahead, round(p / nullif(p + effective, 0), 6) AS own_share FROM w JOIN x USING (entity, period)")
def d30_effective_competitors(spark, d):
    """Ten outputs on an entity's competitors from their probabilities, unknown ones kept apart, without pairs."""
    c = competitors(spark, d)
    return c.select("entity", "period", "n_others", "n_known", "n_unknown", *(F.round(x, 6).alias(x) for x in ("effective", "burden", "best")), "max_load", "sum_load", "n_ahead", F.round(F.try_divide(F.col("p"), F.col("p") + F.col("effective")), 6).alias("own_share"))


@query(f"WITH {COMPETITORS} SELECT entity, period, segment, round(actual - b, 5) AS residual, round(effective, 6) AS effective, round(burden, 6) AS burden, n_known FROM w JOIN x USING (entity, period) WHERE n_others > 0")
def d31_constrained_table(spark, d):
    """Residuals of the frozen base with the competitors' features, one row an entity and period, no input missing."""
    c = competitors(spark, d).filter("n_others > 0").select("entity", "period", "segment", F.round(F.col("actual") - F.col("b"), 5).alias("residual"), F.round("effective", 6).alias("effective"), F.round("burden", 6).alias("burden"), "n_known")
    out = contracts.assert_unique(held(c, "constrained"), ["entity", "period"])
    return out.filter(F.assert_true(~E.any_missing(["residual", "effective", "burden"])).isNull())
