"""Folds, baselines, linear models, calibration and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, folds, linear, logistic, mixtures, trees
from ..operators import panel as P
from .base import PANEL, PREDICTIONS, Query, held, panel, predictions, registered

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)

FOLDS = f"""{PREDICTIONS}, counts AS (SELECT segment, period AS fold, count(*) AS n_valid FROM predictions GROUP BY ALL), cum AS (SELECT *, coalesce(sum(n_valid) OVER (PARTITION BY segment ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_train FROM counts), folds AS (SELECT segment, fold, n_train, n_valid FROM cum WHERE n_train >= 50)"""
KEYS = ["segment", "fold"]
FEATURES = ["a", "b", "n_prior"]
SPECS = {"last": [0], "history": [0, 1], "full": [0, 1, 2]}
ALPHAS = ", ".join(map(str, linear.RIDGE))
# One feature's ridge in closed form: means, deviation and covariance of the training rows, then errors by penalty.
RIDGE = f"""{FOLDS}, st AS (SELECT f.segment, fold, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(actual) AS my, covar_pop(a, actual) AS cay FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY ALL),
al AS (SELECT unnest([{ALPHAS}]::DOUBLE[]) AS alpha),
sc AS (SELECT p.segment, st.fold, alpha, avg(abs(my + n * (cay / sa) / (n + alpha) * (a - ma) / sa - actual)) AS mae, count(*) AS n FROM predictions p JOIN st ON p.segment = st.segment AND p.period = st.fold, al GROUP BY ALL),
inn AS (SELECT segment, fold, inner_fold FROM (SELECT *, count(*) OVER (PARTITION BY segment, fold) AS k FROM (SELECT x.segment, x.fold, y.fold AS inner_fold, row_number() OVER (PARTITION BY x.segment, x.fold ORDER BY y.fold DESC) AS rn FROM folds x JOIN folds y ON x.segment = y.segment AND y.fold < x.fold) WHERE rn <= 5) WHERE k >= 3)"""
NESTED = f"""{RIDGE}, past AS (SELECT i.segment, i.fold, alpha, avg(mae) AS inner_mae FROM inn i JOIN sc ON i.segment = sc.segment AND i.inner_fold = sc.fold GROUP BY ALL),
best AS (SELECT segment, fold, alpha, inner_mae FROM (SELECT *, row_number() OVER (PARTITION BY segment, fold ORDER BY round(inner_mae, 9), alpha DESC) AS rn FROM past) WHERE rn = 1)"""


def folds_of(rows):
    return folds.expanding_folds(rows, "period", "segment", 50)


def fold_table(spark, d):
    return folds_of(predictions(spark, d))


def expanded(spark, d):
    """Predictions once a fold. Statistics, Gram matrix and scoring all read them, so they are written once."""
    rows = held(predictions(spark, d), "predictions")
    return folds.with_roles(rows, folds.expanding_folds(rows, "period", "segment", 50), "period", "segment")


@query(f"WITH {FOLDS} SELECT * FROM folds")
def m2_expanding_folds(spark, d):
    """M2."""
    return fold_table(spark, d)


@query(f"WITH {FOLDS} SELECT segment, fold, role, count(*) AS n, max(period) AS last_period FROM (SELECT f.segment, fold, period, CASE WHEN period < fold THEN 'train' ELSE 'valid' END AS role FROM predictions p JOIN folds f ON p.segment = f.segment AND period <= fold) GROUP BY ALL")
def j12_fold_expansion(spark, d):
    """Training rows lie before the fold."""
    return expanded(spark, d).groupBy("segment", "fold", "role").agg(F.count("*").alias("n"), F.max("period").alias("last_period"))


@query(f"WITH {FOLDS} SELECT min(fold) AS start FROM (SELECT fold FROM folds WHERE fold >= 1996 GROUP BY fold HAVING count(DISTINCT segment) = (SELECT count(DISTINCT segment) FROM folds))")
def m1_evaluation_start(spark, d):
    """M1."""
    return folds.evaluation_start(fold_table(spark, d), "segment", 1996)


@query(f"WITH {FOLDS}, i AS (SELECT a.segment, a.fold, b.fold AS inner_fold, row_number() OVER (PARTITION BY a.segment, a.fold ORDER BY b.fold DESC) AS rn FROM folds a JOIN folds b ON a.segment = b.segment AND b.fold < a.fold), k AS (SELECT *, count(*) OVER (PARTITION BY segment, fold) AS n FROM i WHERE rn <= 5) SELECT segment, fold, inner_fold FROM k WHERE n >= 3")
def w20_inner_periods(spark, d):
    """W20, M8."""
    return folds.inner_periods(fold_table(spark, d), "segment")


@query(f"WITH {PANEL}, s AS (SELECT segment, period, sum(target) AS s, count(*) AS n FROM panel GROUP BY ALL) SELECT segment, period, round(sum(s) OVER w / sum(n) OVER w, 6) AS baseline FROM s WINDOW w AS (PARTITION BY segment ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def m3_mean_baseline(spark, d):
    """M3."""
    return folds.mean_baseline(panel(spark, d), "period", "segment", "target").withColumn("baseline", F.round("baseline", 6))


def sums_of(spark, d, features=FEATURES, target="actual"):
    """Predictions, written once as several branches read them, and their running sums by fold."""
    rows = held(predictions(spark, d), "predictions")
    return rows, linear.fold_sums(rows, ["segment"], "period", features, target)


@query(f"WITH {FOLDS} SELECT f.segment, fold, 'a' AS feature, count(*) AS n, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold UNION ALL SELECT f.segment, fold, 'b', count(*), round(avg(b), 6), round(stddev_pop(b), 6) FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold")
def m4_fold_statistics(spark, d):
    """M4: means and population deviations of training rows, from running sums."""
    _, sums = sums_of(spark, d, ["a", "b"])
    return linear.statistics(sums, KEYS, ["a", "b"]).select(*KEYS, "feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {PANEL}, l AS (SELECT segment, period, target AS actual, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS t2 FROM panel), c AS (SELECT segment, period AS fold, count(*) AS k FROM l GROUP BY ALL), f AS (SELECT segment, fold FROM (SELECT *, sum(k) OVER (PARTITION BY segment ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM c) WHERE n >= 50),
md AS (SELECT f.segment, fold, coalesce(median(t2), 0) AS med FROM l JOIN f ON l.segment = f.segment AND period < fold GROUP BY ALL)
SELECT l.segment, md.fold, count(*) AS n, count(*) - count(t2) AS n_missing, round(any_value(med), 6) AS med, round(avg(coalesce(t2, med)), 6) AS mean, round(stddev_pop(coalesce(t2, med)), 6) AS std FROM l JOIN md ON l.segment = md.segment AND period < md.fold GROUP BY l.segment, md.fold""")
def m4_imputed_statistics(spark, d):
    """M4: a feature that misses values, imputed with the fold's own training median."""
    rows = held(panel(spark, d).select("segment", "period", F.col("target").alias("actual"), P.exact_lag("target", "entity", "period", 2).alias("t2")), "lagged")
    sums = linear.fold_sums(rows, ["segment"], "period", ["t2"], "actual")
    return linear.statistics(sums, KEYS, ["t2"]).select(*KEYS, "n", "n_missing", *(F.round(x, 6).alias(x) for x in ("med", "mean", "std")))


@query(f"WITH {FOLDS} SELECT f.segment, fold, 'a' AS feature, round(regr_slope(actual, a), 4) AS coefficient, round(regr_intercept(actual, a), 3) AS intercept FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold")
def m5_ols_one_feature(spark, d):
    """Least squares by fold, coefficients in original units."""
    _, sums = sums_of(spark, d, ["a"])
    units = linear.original_units(linear.fits(sums, KEYS, {"last": [0]}, ridge=()), KEYS, ["a"])
    return units.select(*KEYS, "feature", F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 3).alias("intercept"))


def scores(spark, d):
    """Errors on each fold's own period of every specification and setting."""
    rows, sums = sums_of(spark, d)
    fits = linear.fits(sums, KEYS, SPECS, linear.RIDGE, linear.NET_ALPHA, linear.NET_L1)
    return linear.errors(rows, fits, ["segment"], "period", FEATURES, "actual").drop("n_inputs")


@query()
def m6_linear_grids(spark, d):
    """M6, M7: ridge and elastic-net grids of every fold from one Gram matrix; errors on the fold's own period."""
    return scores(spark, d).filter("spec = 'full'").drop("spec")


@query(f"WITH {RIDGE} SELECT segment, fold, alpha, round(mae, 5) AS mae, n FROM sc")
def m6_ridge_one_feature(spark, d):
    """M6: the ridge grid on one feature."""
    return scores(spark, d).filter("spec = 'last' and method = 'ridge'").select(*KEYS, "alpha", F.round("mae", 5).alias("mae"), "n")


@query(f"WITH {NESTED} SELECT segment, fold, alpha, round(inner_mae, 5) AS inner_mae, round(mae, 5) AS mae, n FROM best JOIN sc USING (segment, fold, alpha)")
def m8_nested_ridge(spark, d):
    """Per fold the penalty that did best on the last inner folds (three to five), refitted on all that lies before the fold."""
    rows, sums = sums_of(spark, d, ["a"])
    inner = folds.inner_periods(folds_of(rows), "segment")
    fits = linear.fits(sums, KEYS, {"last": [0]}).filter("method = 'ridge'")
    best = linear.nested(rows, sums, fits, ["segment"], "period", ["a"], "actual", inner, all_ranks=False)
    return best.select(*KEYS, "alpha", F.round("inner_mae", 5).alias("inner_mae"), F.round("mae", 5).alias("mae"), "n")


def nested_choice(spark, d, choose):
    rows, sums = sums_of(spark, d)
    fits = linear.fits(sums, KEYS, SPECS, linear.RIDGE, linear.NET_ALPHA, linear.NET_L1)
    return linear.nested(rows, sums, fits, ["segment"], "period", FEATURES, "actual", folds.inner_periods(folds_of(rows), "segment"), choose)


@query()
def m8_nested_specs(spark, d):
    """The nested choice of every specification over all methods and penalties."""
    return nested_choice(spark, d, ["spec"])


@query()
def m9_adaptive_choice(spark, d):
    """Per fold the specification and setting that did best on inner folds, by error, then rank correlation."""
    return nested_choice(spark, d, [])


@query()
def m10_ablation(spark, d):
    """Ridge over nested feature groups, every fold and penalty from one Gram matrix."""
    return scores(spark, d).filter("method = 'ridge'").select(*KEYS, "spec", "alpha", "mae", "n")


@query(f"WITH {RIDGE} SELECT segment, fold, alpha, 'a' AS feature, round(n * (cay / sa) / (n + alpha) / sa, 6) AS coefficient FROM st, al")
def m30_coefficient_path(spark, d):
    """A coefficient over the penalties."""
    _, sums = sums_of(spark, d, ["a"])
    units = linear.original_units(linear.fits(sums, KEYS, {"last": [0]}).filter("method = 'ridge'"), KEYS, ["a"])
    return units.select(*KEYS, "alpha", "feature", F.round("coefficient", 6).alias("coefficient"))


@query(f"WITH {FOLDS}, c AS (SELECT f.segment, fold, abs(corr(a, b)) AS r FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold) SELECT segment, fold, 'pair' AS spec, 2 AS n_features, CASE WHEN r > 1 - 1e-9 THEN 1 ELSE 2 END AS matrix_rank, CASE WHEN r > 1 - 1e-9 THEN 1 ELSE 0 END AS deficiency, CASE WHEN r <= 1 - 1e-9 THEN round(sqrt((1 + r) / (1 - r)), 4) END AS condition FROM c UNION ALL SELECT segment, fold, 'doubled', 3, CASE WHEN r > 1 - 1e-9 THEN 1 ELSE 2 END, CASE WHEN r > 1 - 1e-9 THEN 2 ELSE 1 END, NULL FROM c")
def a16_rank_audit(spark, d):
    """Matrix rank, deficiency and condition number by fold, of two features and of these with a multiple of one."""
    rows = held(predictions(spark, d).withColumn("double_a", F.col("a") * 2), "predictions")
    out = None
    for name, features in {"pair": ["a", "b"], "doubled": ["a", "b", "double_a"]}.items():
        one = linear.rank_audit(linear.fold_sums(rows, ["segment"], "period", features, "actual"), KEYS).withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("condition", F.round("condition", 4))


PAIRS = [(x, y) for i, x in enumerate(FEATURES) for y in FEATURES[i + 1 :]]


@query(f"WITH {FOLDS}, c AS ({' UNION ALL '.join(f"SELECT f.segment, fold, '{x}' AS feature_a, '{y}' AS feature_b, corr({x}, {y}) AS r FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY f.segment, fold" for x, y in PAIRS)}) SELECT segment, fold, feature_a, feature_b, round(r, 5) AS r, CASE WHEN abs(r) >= 0.9 THEN 'review' ELSE 'strong' END AS decision FROM c WHERE abs(r) >= 0.75 AND NOT isnan(r)")
def a14_correlated_pairs(spark, d):
    """Pairs of features above a correlation of 0.75, with a label, from the Gram matrix."""
    _, sums = sums_of(spark, d)
    c = linear.correlations(sums, KEYS, FEATURES).filter(F.abs("r") >= 0.75)
    return c.withColumn("decision", F.when(F.abs("r") >= 0.9, "review").otherwise("strong")).withColumn("r", F.round("r", 5))


POWER = f"""{FOLDS}, k AS (SELECT *, rank() OVER (PARTITION BY segment, period ORDER BY qty DESC) + (count(*) OVER (PARTITION BY segment, period, qty) - 1) / 2.0::DOUBLE AS r FROM (SELECT p.segment, p.period, q.qty, p.actual FROM predictions p JOIN panel q USING (entity, period))),
bt AS (SELECT 0.05::DOUBLE + i * ((1.50::DOUBLE - 0.05::DOUBLE) / 145) AS beta FROM range(146) t(i)),
tr AS (SELECT k.segment, fold, beta, actual, r ** -beta AS w, actual / (r ** -beta) AS v FROM k JOIN folds f ON k.segment = f.segment AND period < fold, bt),
wm AS (SELECT segment, fold, beta, min(v) AS alpha FROM (SELECT *, sum(w) OVER (PARTITION BY segment, fold, beta ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY segment, fold, beta) AS total FROM tr) WHERE run * 2 >= total GROUP BY ALL),
er AS (SELECT segment, fold, beta, alpha, avg(abs(actual - alpha * w)) AS mae, count(*) AS n FROM tr JOIN wm USING (segment, fold, beta) GROUP BY ALL),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment, fold ORDER BY mae, beta) AS rn FROM er) WHERE rn = 1)"""


@query(f"WITH {POWER} SELECT bp.segment, bp.fold, round(beta, 4) AS beta, round(alpha, 3) AS alpha, round(any_value(bp.mae), 4) AS train_mae, any_value(bp.n) AS n_train, round(avg(abs(actual - alpha * r ** -beta)), 4) AS mae FROM bp JOIN k ON k.segment = bp.segment AND k.period = bp.fold GROUP BY bp.segment, bp.fold, beta, alpha")
def m12_power_calibration(spark, d):
    """Alpha * rank ** -beta fitted by segment and fold on earlier periods only, over a grid of exponents; its error on the fold. The rank is by the year's quantity, which the score falls with."""
    from ..operators.places import Rank, with_ranks

    both = predictions(spark, d, "qty").select("segment", "period", "actual", "qty")
    ranked = with_ranks(both, ["segment", "period"], {"rank": Rank("qty", descending=True)})
    p = held(ranked.select("segment", "period", "rank", "actual"), "ranked")
    fitted = calibrate.power_calibration(p, "segment", "period", "rank", "actual", folds.expanding_folds(p, "period", "segment", 50)).select(*KEYS, "alpha", "beta", F.col("mae").alias("train_mae"), F.col("n").alias("n_train"))
    done = p.withColumn("fold", F.col("period")).join(F.broadcast(fitted), KEYS).withColumn("error", F.abs(F.col("actual") - calibrate.apply_power("rank")))  # fitted has a row a fold
    return done.groupBy(*KEYS, F.round("beta", 4).alias("beta"), F.round("alpha", 3).alias("alpha"), F.round("train_mae", 4).alias("train_mae"), "n_train").agg(F.round(F.avg("error"), 4).alias("mae"))


@query(f"""WITH {PREDICTIONS}, w AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS weight), per AS (SELECT segment, period, weight, sum(abs(actual - weight * a - (1 - weight) * b)) AS e, count(*) AS n FROM predictions, w GROUP BY ALL), past AS (SELECT *, sum(e) OVER q / sum(n) OVER q AS past FROM per WINDOW q AS (PARTITION BY segment, weight ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT segment, period, weight, round(past, 6) AS past_mae FROM (SELECT *, row_number() OVER (PARTITION BY segment, period ORDER BY round(past, 6), weight) AS rn FROM past WHERE past IS NOT NULL) WHERE rn = 1""")
def m18_blend_weight(spark, d):
    """The weight that did best over earlier periods."""
    got = calibrate.blended(predictions(spark, d), ["segment"], "period", "a", "b", "actual", [0.0, 0.25, 0.5, 0.75, 1.0])
    return got.withColumn("past_mae", F.round("past_mae", 6))


RESIDUAL = f"""{FOLDS}, st AS (SELECT f.segment, fold, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(actual - b) AS my, covar_pop(a, actual - b) AS cay FROM predictions p JOIN folds f ON p.segment = f.segment AND period < fold GROUP BY ALL),
al AS (SELECT alpha, shrinkage FROM (SELECT unnest([0.1, 1, 10, 100]::DOUBLE[]) AS alpha), (SELECT unnest([0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS shrinkage)),
sc AS (SELECT p.segment, st.fold, alpha, shrinkage, avg(abs(actual - b - shrinkage * (my + n * (cay / sa) / (n + alpha) * (a - ma) / sa))) AS mae, count(*) AS n FROM predictions p JOIN st ON p.segment = st.segment AND p.period = st.fold, al GROUP BY ALL),
{RIDGE[RIDGE.index("inn AS"):]}, past AS (SELECT i.segment, i.fold, alpha, shrinkage, avg(mae) AS inner_mae FROM inn i JOIN sc ON i.segment = sc.segment AND i.inner_fold = sc.fold GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment, fold ORDER BY round(inner_mae, 9), shrinkage, alpha DESC) AS rn FROM past) WHERE rn = 1)"""


@query(f"WITH {RESIDUAL} SELECT segment, fold, alpha, shrinkage, round(inner_mae, 5) AS inner_mae, round(mae, 5) AS mae, n FROM best JOIN sc USING (segment, fold, alpha, shrinkage)")
def m19_residual_ridge(spark, d):
    """A ridge on the residual of a frozen base and how much of it counts, both chosen on inner folds."""
    rows = held(predictions(spark, d).withColumn("residual", F.col("actual") - F.col("b")), "predictions")
    fits = linear.fits(linear.fold_sums(rows, ["segment"], "period", ["a"], "residual"), KEYS, {"last": [0]}, (0.1, 1.0, 10.0, 100.0)).filter("method = 'ridge'")
    done = linear.scored(rows, fits, ["segment"], "period", ["a"])
    errors = F.array(*(F.struct(F.lit(x).alias("shrinkage"), F.avg(F.abs(F.col("residual") - x * F.col("predicted"))).alias("mae")) for x in calibrate.SHRINKAGE))
    by_setting = done.groupBy(*KEYS, "alpha").agg(F.count("*").alias("n"), errors.alias("errors")).select(*KEYS, "alpha", "n", F.inline("errors"))
    best = folds.chosen_inside(by_setting, folds.inner_periods(folds_of(rows), "segment"), ["segment"], ["alpha", "shrinkage"], [F.col("shrinkage"), F.desc("alpha")])
    return best.select(*KEYS, "alpha", "shrinkage", F.round("inner_mae", 5).alias("inner_mae"), F.round("mae", 5).alias("mae"), "n")


def adjusted_rows(spark, d):
    return adjusted(spark, d)[0]


def adjusted(spark, d):
    """Rows of each fold's own period with what the adjusters read, in thousands, and the fold's training means and deviations; and the folds."""
    p = predictions(spark, d).select(
        "segment", "entity", "period", (F.col("actual") / 1000).alias("actual"), (F.col("b") / 1000).alias("base"),
        F.col("n_prior").cast("double").alias("count"), (F.col("n_prior") * 2.0).alias("burden"), (F.col("a") / (F.col("a") + F.col("m"))).alias("share"),
    )
    rows = held(p, "adjusted")
    stats = linear.statistics(linear.fold_sums(rows, ["segment"], "period", ["count", "share"], "actual"), KEYS, ["count", "share"])
    of = lambda x, c: F.max(F.when(F.col("feature") == x, F.col(c))).alias(f"{x}_{c}")
    wide = stats.groupBy(*KEYS).agg(*(of(x, c) for x in ("count", "share") for c in ("mean", "std")))
    return held(rows.withColumn("fold", F.col("period")).join(wide, KEYS), "adjusted"), folds_of(rows)


def adjustment(name, p):
    """SQL of one adjuster under one setting."""
    terms = {
        "count": lambda: f"{p.get('p_coef')} * (cnt - cnt_mean) / nullif(cnt_std, 0)", "share": lambda: f"{p.get('p_coef')} * (share - share_mean) / nullif(share_std, 0)",
        "burden": lambda: f"-{p.get('p_penalty')} * greatest(burden - 6, 0)",
        "steps": lambda: f"-({p.get('p_penalty')} * greatest(burden - 2, 0) + {p.get('p_penalty_2')} * greatest(burden - 4, 0) + {p.get('p_penalty_3')} * greatest(burden - 6, 0))",
        "gated": lambda: f"greatest(burden - 4, 0) * ({p.get('p_up')} * least(greatest((base - 4) / 4, 0), 1) - {p.get('p_low')} * least(greatest((4 - base) / 4, 0), 1))",
    }
    term = terms[name]()  # least() and greatest() skip nulls in DuckDB, too
    return f"CASE WHEN ({term}) IS NULL THEN 0 ELSE least(0.75, greatest(-0.75, ({term})::DOUBLE)) END"


ADJUSTED = f"""{FOLDS}, raw AS (SELECT segment, entity, period, actual / 1000 AS actual, b / 1000 AS base, n_prior::DOUBLE AS cnt, n_prior * 2.0::DOUBLE AS burden, a / (a + m) AS share FROM predictions),
ts AS (SELECT f.segment, fold, avg(cnt) AS cnt_mean, CASE WHEN stddev_pop(cnt) > 1e-9 THEN stddev_pop(cnt) END AS cnt_std, avg(share) AS share_mean, CASE WHEN stddev_pop(share) > 1e-9 THEN stddev_pop(share) END AS share_std FROM raw JOIN folds f ON raw.segment = f.segment AND period < fold GROUP BY ALL),
adj AS (SELECT raw.*, fold, cnt_mean, cnt_std, share_mean, share_std FROM raw JOIN ts ON raw.segment = ts.segment AND raw.period = ts.fold)"""
GRID_ERRORS = " UNION ALL ".join(f"SELECT segment, fold, '{name}' AS name, {i} AS setting, avg(abs(actual - base - {adjustment(name, s)})) AS mae, avg(abs(actual - base)) AS base_mae, count(*) AS n FROM adj GROUP BY segment, fold" for name, grid in calibrate.GRIDS.items() for i, s in enumerate(grid))


@query(f"WITH {ADJUSTED}, g AS ({GRID_ERRORS}) SELECT segment, fold, name, setting, round(mae, 6) AS mae, round(base_mae, 6) AS base_mae, n FROM g")
def m20_bounded_corrections(spark, d):
    """All five bounded adjusters over their whole grids in one pass, with means and deviations of the fold's training rows."""
    got = calibrate.grid_errors(adjusted_rows(spark, d), KEYS, "base", "actual")
    return got.withColumns({"mae": F.round("mae", 6), "base_mae": F.round("base_mae", 6)})


COMPONENTS = f"""{ADJUSTED}, g AS ({GRID_ERRORS}), {RIDGE[RIDGE.index("inn AS"):]},
pc AS (SELECT i.segment, i.fold, name, setting, avg(mae) AS inner_mae, avg(base_mae) AS inner_base FROM inn i JOIN g ON i.segment = g.segment AND i.inner_fold = g.fold GROUP BY ALL),
bc AS (SELECT *, row_number() OVER (PARTITION BY segment, fold ORDER BY round(inner_mae, 9), name) AS place FROM (SELECT *, row_number() OVER (PARTITION BY segment, fold, name ORDER BY round(inner_mae, 9), setting) AS rn FROM pc) WHERE rn = 1 AND inner_base - inner_mae >= 0.0005)"""


@query(f"WITH {COMPONENTS} SELECT segment, fold, name, setting, round(inner_mae, 6) AS inner_mae, round(inner_base - inner_mae, 6) AS inner_gain, place FROM bc WHERE place <= 3")
def m21_components(spark, d):
    """Each fold's components: the best setting of every adjuster on inner folds, of which up to three that gain 0.0005 there stay."""
    return components(spark, d)[1].withColumns({x: F.round(x, 6) for x in ("inner_mae", "inner_gain")})


def components(spark, d):
    from ..operators import panel as P

    rows, outer = adjusted(spark, d)
    errors = held(calibrate.grid_errors(rows, KEYS, "base", "actual"), "grid")
    inner = folds.inner_periods(outer, "segment")
    past = inner.join(errors.withColumnRenamed("fold", "inner_fold"), ["segment", "inner_fold"]).groupBy(*KEYS, "name", "setting").agg(F.avg("mae").alias("inner_mae"), F.avg("base_mae").alias("inner_base"))
    best = P.first_row(past, [*KEYS, "name"], F.round("inner_mae", 9), "setting").withColumn("inner_gain", F.col("inner_base") - F.col("inner_mae")).filter("inner_gain >= 0.0005")
    return rows, P.top_rows(best, KEYS, 3, F.round("inner_mae", 9), "name").select(*KEYS, "name", "setting", "inner_mae", "inner_gain", "place")


CORRECTED = " UNION ALL ".join(f"SELECT segment, fold, entity, '{name}' AS name, {i} AS setting, {adjustment(name, s)} AS c FROM adj" for name, grid in calibrate.GRIDS.items() for i, s in enumerate(grid))


@query(f"WITH {COMPONENTS}, cc AS ({CORRECTED}), k AS (SELECT segment, fold, entity, avg(c) AS c, count(*) AS n_components FROM cc JOIN bc USING (segment, fold, name, setting) WHERE place <= 3 GROUP BY ALL) SELECT adj.segment, adj.fold, count(*) AS n, max(coalesce(n_components, 0)) AS n_components, round(avg(abs(actual - base)), 6) AS base_mae, round(avg(abs(actual - base - least(0.75, greatest(-0.75, coalesce(c, 0))))), 6) AS mae FROM adj LEFT JOIN k USING (segment, fold, entity) GROUP BY adj.segment, adj.fold")
def m23_corrected(spark, d):
    """Base prediction plus the bounded mean of the fold's chosen components, as it would be deployed."""
    rows, chosen = components(spark, d)
    wide = chosen.groupBy(*KEYS).agg(F.collect_list(F.struct("name", "setting")).alias("chosen"))  # three at most
    both = rows.join(wide, KEYS, "left").withColumn("n_chosen", F.coalesce(F.size("chosen"), F.lit(0)))
    done = calibrate.mean_correction(both, "chosen", "correction")
    return done.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.max("n_chosen").alias("n_components"),
        F.round(F.avg(F.abs(F.col("actual") - F.col("base"))), 6).alias("base_mae"), F.round(F.avg(F.abs(F.col("actual") - F.col("base") - F.col("correction"))), 6).alias("mae"),
    )


@query(f"WITH {ADJUSTED}, g AS ({GRID_ERRORS}), h AS (SELECT segment, fold < 2000 AS discovery, name, setting, sum(mae * n) / sum(n) AS mae, sum(base_mae * n) / sum(n) AS base_mae, sum(n)::BIGINT AS n FROM g GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment, name ORDER BY round(mae, 9), setting) AS rn FROM h WHERE discovery) WHERE rn = 1) SELECT s.segment, s.name, s.setting, round(s.mae, 6) AS mae, round(s.base_mae, 6) AS base_mae, round(s.base_mae - s.mae, 6) AS improvement, s.base_mae - s.mae >= 0.005 AS passed, s.n FROM best JOIN h s ON s.segment = best.segment AND s.name = best.name AND s.setting = best.setting AND NOT s.discovery")
def m22_locked_confirmation(spark, d):
    """Each adjuster's setting locked on discovery periods, scored on sealed ones, with pass or fail."""
    g = calibrate.grid_errors(adjusted_rows(spark, d), KEYS, "base", "actual")
    weighted = lambda x: F.sum(F.col(x) * F.col("n")) / F.sum("n")
    side = lambda rows: rows.groupBy("segment", "name", "setting").agg(weighted("mae").alias("mae"), weighted("base_mae").alias("base_mae"), F.sum("n").alias("n"))
    g = held(g, "grid")
    got = calibrate.locked(side(g.filter("fold < 2000")), side(g.filter("fold >= 2000")), ["segment", "name"], ["setting"])
    return got.withColumns({x: F.round(x, 6) for x in ("mae", "base_mae", "improvement")})


@query(f"""WITH {NESTED}, md AS (SELECT segment, alpha FROM (SELECT segment, alpha, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, min(fold), alpha) AS rn FROM (SELECT *, dense_rank() OVER (PARTITION BY segment ORDER BY fold DESC) AS dr FROM best) WHERE dr <= 5 GROUP BY segment, alpha) WHERE rn = 1),
fin AS (SELECT segment, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(actual) AS my, covar_pop(a, actual) AS cay FROM predictions GROUP BY segment), nw AS (SELECT * FROM predictions WHERE period = (SELECT max(period) FROM predictions)), pr AS (SELECT nw.segment, entity, period, alpha, my + n * (cay / sa) / (n + alpha) * (a - ma) / sa AS predicted FROM nw JOIN fin USING (segment) JOIN md USING (segment))
SELECT segment, entity, period, alpha, round(predicted, 4) AS predicted, row_number() OVER (PARTITION BY segment ORDER BY round(predicted, 4) DESC, entity) AS place FROM pr""")
def m29_batch_scoring(spark, d):
    """Refit on all periods with the penalty that recent folds chose most often, score the latest period, rank by segment; the inputs are checked."""
    from ..functions.ranks import first_rank
    from ..operators.contracts import assert_inputs

    assert_inputs(["a"], ["actual", "entity", "n_occ"])
    rows, sums = sums_of(spark, d, ["a"])
    inner = folds.inner_periods(folds_of(rows), "segment")
    recent = linear.nested(rows, sums, linear.fits(sums, KEYS, {"last": [0]}).filter("method = 'ridge'"), ["segment"], "period", ["a"], "actual", inner, all_ranks=False)
    modal = folds.modal_recent(recent.select("segment", "fold", "alpha"), ["segment"], "fold", ["alpha"]).select("segment", "alpha")
    final = linear.fits(linear.all_sums(rows, ["segment"], "period", ["a"], "actual"), ["segment"], {"last": [0]}).filter("method = 'ridge'").join(modal, ["segment", "alpha"])
    newest = rows.agg(F.max("period").alias("newest"))
    done = rows.join(F.broadcast(newest), F.col("period") == F.col("newest")).join(final, "segment").withColumn("predicted", F.round(linear.predicted(["a"]), 4))  # newest is one row
    return done.withColumn("place", first_rank("predicted", ["segment"], ["entity"])).select("segment", "entity", "period", "alpha", "predicted", "place")


def probabilities(spark, d):
    """Predictions with the cross-fitted probability of an above-average period."""
    p = held(predictions(spark, d).withColumn("label", (F.col("actual") > F.col("m")).cast("int")), "labelled")
    return logistic.crossfit(p, ["segment"], "period", FEATURES, "label")


@query()
def m14_crossfitted_probabilities(spark, d):
    """Balanced logistic probabilities of every period, fitted on the periods before it; null where these are too few."""
    return probabilities(spark, d).select("segment", "entity", "period", "label", "probability")


def mixture_rows(spark, d, schemes):
    """Predictions in points with tiers of the year's occurrences, and every scheme's mixtures."""
    points = lambda x: (F.col(x) / 1024).alias(x)
    rows = predictions(spark, d).select("segment", "entity", "period", *map(points, ("actual", "a", "b")), "n_prior", F.col("n_occ").alias("role"))
    return mixtures.mixed(rows, "segment", "period", FEATURES, "actual", "role", schemes)


def tuned_mixture(spark, d, schemes):
    """by fold the cuts and penalty that did best on inner folds."""
    settings = {i * len(mixtures.ALPHAS) + j: (cuts, alpha) for i, cuts in enumerate(schemes) for j, alpha in enumerate(mixtures.ALPHAS)}
    best = mixtures.chosen(mixture_rows(spark, d, schemes), "segment", "period", "actual", settings, folds.inner_periods(fold_table(spark, d), "segment"))
    names = spark.createDataFrame([(i, list(cuts), alpha) for i, (cuts, alpha) in settings.items()], "setting int, cuts array<double>, alpha double")  # a row a setting
    cut = lambda i: F.get("cuts", F.lit(i)).alias(f"cut_{i + 1}")
    return best.join(F.broadcast(names), "setting").select(*KEYS, *(cut(i) for i in range(len(schemes[0]))), "alpha", "inner_mae", "mae", "n")


@query()
def m13_tier_probabilities(spark, d):
    """Balanced classifiers of two and of three tiers, every period scored by a fit on the periods before it; null where a tier has fewer than 20 rows there."""
    rows = mixture_rows(spark, d, [mixtures.TWO_TIERS[0], mixtures.THREE_TIERS[0]])
    p = lambda i, t, name: F.get(F.get("tiers", F.lit(i)), F.lit(t)).alias(name)
    return rows.select("segment", "entity", "period", "role", p(0, 1, "upper"), *(p(1, t, f"tier_{t}") for t in range(3)))


@query()
def m15_mixture(spark, d):
    """Two ridges mixed by the probability of the upper tier; of four thresholds and four penalties each fold takes what did best on its inner folds."""
    return tuned_mixture(spark, d, mixtures.TWO_TIERS)


@query()
def m16_three_tiers(spark, d):
    """Three ridges mixed by the probabilities of three tiers; three pairs of cuts and four penalties."""
    return tuned_mixture(spark, d, mixtures.THREE_TIERS)


@query(f"""WITH {FOLDS}, q AS (SELECT p.*, n_occ * 1.0::DOUBLE AS chance FROM predictions p), s1 AS (SELECT f.segment, fold, regr_slope(chance, a) AS k, regr_intercept(chance, a) AS c FROM q JOIN folds f ON q.segment = f.segment AND period < fold GROUP BY f.segment, fold),
x AS (SELECT q.segment, entity, period, actual, c + k * a AS hat FROM q JOIN s1 ON q.segment = s1.segment AND q.period = s1.fold), c2 AS (SELECT segment, period AS fold, count(*) AS n FROM x GROUP BY ALL), f2 AS (SELECT segment, fold FROM (SELECT *, sum(n) OVER (PARTITION BY segment ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM c2) WHERE t >= 50),
s2 AS (SELECT f2.segment, fold, regr_slope(actual, hat) AS k, regr_intercept(actual, hat) AS c FROM x JOIN f2 ON x.segment = f2.segment AND period < fold GROUP BY f2.segment, fold)
SELECT x.segment, s2.fold, count(*) AS n, round(avg(abs(c + k * hat - actual)), 4) AS mae FROM x JOIN s2 ON x.segment = s2.segment AND x.period = s2.fold GROUP BY x.segment, s2.fold""")
def m17_chained(spark, d):
    """Occurrences first, then the score from their cross-fitted predictions: the second fit only sees what the first said about periods it had not read."""
    rows = held(predictions(spark, d).withColumn("chance", F.col("n_occ").cast("double")), "predictions")
    ols = lambda sums: linear.fits(sums, KEYS, {"one": [0]}, ridge=())
    first = linear.scored(rows, ols(linear.fold_sums(rows, ["segment"], "period", ["a"], "chance")), ["segment"], "period", ["a"])
    x = held(first.select("segment", "entity", "period", "actual", F.col("predicted").alias("hat")), "chained")
    done = linear.scored(x, ols(linear.fold_sums(x, ["segment"], "period", ["hat"], "actual")), ["segment"], "period", ["hat"])
    return done.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 4).alias("mae"))


def tree_rows(spark, d):
    """Predictions in points of 1024, the scale at which caps and pruning mean something; one row has all that a tree sees."""
    points = lambda x: (F.col(x) / 1024).alias(x)
    return predictions(spark, d).select("segment", "entity", "period", *map(points, ("actual", "a", "b", "m")), "n_prior")


def tree_experiment(spark, d, kind: str, **options):
    """Chosen settings and predictions of one family, as trees.nested returns them."""
    return trees.nested(tree_rows(spark, d), "segment", "period", FEATURES, "actual", kind, **options)


CHOSEN = ["segment", "fold", "label", "inner_mae", "mae", "n", "train_mae", "depth", "leaves", "n_distinct"]


@query()
def m24_tree(spark, d):
    """Decision trees by segment and fold, 64 settings with cost-complexity pruning, chosen on inner folds: direct, and as corrections of the recent mean by 0.75 at most."""
    direct, _ = tree_experiment(spark, d, "tree")
    residual, _ = tree_experiment(spark, d, "tree", base="b")
    return direct.select(F.lit("direct").alias("form"), *CHOSEN).unionByName(residual.select(F.lit("residual").alias("form"), *CHOSEN))


@query()
def m24_tree_predictions(spark, d):
    """What the chosen trees say of every row of their fold."""
    _, rows = tree_experiment(spark, d, "tree")
    return rows.select("segment", "fold", "entity", "actual", "predicted")


@query()
def m25_forest(spark, d):
    """Forests by segment and fold, 36 settings compared with 150 trees each; the chosen one has 500."""
    return tree_experiment(spark, d, "forest")[0].select(*CHOSEN)


@query()
def m26_boosting(spark, d):
    """Leaf-wise boosting by segment and fold, 48 settings of squared and absolute loss."""
    return tree_experiment(spark, d, "boosting")[0].select(*CHOSEN)


@query()
def m27_permutation_importance(spark, d):
    """Five shuffles of every feature among the rows of each fold, scored by the fold's chosen tree."""
    chosen, _ = tree_experiment(spark, d, "tree")
    return trees.importance(tree_rows(spark, d), "segment", "period", ["entity"], FEATURES, "actual", "tree", chosen.select("segment", "fold", "setting"), n_trees=1)


@query()
def m28_tree_models(spark, d):
    """The nodes of each segment's final tree, fitted on all periods with the setting that the last folds chose most often."""
    chosen, _ = tree_experiment(spark, d, "tree")
    return trees.final_models(tree_rows(spark, d), "segment", "period", FEATURES, "actual", chosen)


@query()
def e25_complexity(spark, d):
    """By segment, fold and family the errors on training and later rows, their ratio, leaves and distinct predictions of the chosen models.

    Every family has its whole grid with all trees and rounds, as in M24 to M26. The rows are made, and summed to cells, once for the three.
    """
    rows = held(tree_rows(spark, d), "tree-rows")
    same = (rows, "segment", "period", FEATURES, "actual")
    ready, out = trees.prepared(*same), None
    for kind in trees.GRIDS:
        one = trees.nested(*same, kind, ready=ready)[0].select(F.lit(kind).alias("family"), *CHOSEN, (F.col("mae") / F.nullif(F.col("train_mae"), F.lit(0.0))).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out
