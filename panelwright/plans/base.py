"""The panel engine's configuration on the given tables, in Spark and as SQL.

entity = customer, segment = market segment, group = nation, period = year and sub-period
= month of an order, occurrence = order. Measures are sums over an order's lines in whole
units (price in cents), and the weights of the score are binary fractions, so that sums
are exact and do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..sources.scratch import held, scratch  # noqa: F401
from ..sources.tables import scan

WEIGHTS = {"qty": 0.25, "price": 0.0009765625, "disc": -0.0625}
SUMS = ("qty", "price", "disc")
Query = Callable[[SparkSession, str], DataFrame]


def registered(queries: dict[str, Query], oracles: dict[str, str]):
    """A decorator that registers a query, and its SQL if there is any."""

    def of(sql: str | None = None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return of


#: Orders of a task of the exchange by entity: what a task holds doesn't grow with the tables.
TASK_ROWS = 250_000


def parts_of(spark: SparkSession, n: int, least: int = 20_000) -> int:
    """Partitions for n rows: TASK_ROWS a partition at most, and as many as there are cores if these get `least` rows each."""
    return max(1, -(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // least)))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Stat rows: one an order with lines, dealt by entity, so that panels and lags need no further exchange.

    Lines meet in as many partitions as the session has, combined before the exchange; where these would hold more than
    TASK_ROWS orders each, lines are dealt anew, so that a task's memory doesn't grow with the tables.
    """
    parts, raw = parts_of(spark, scan(spark, d, "orders").count()), scan(spark, d, "lineitem")
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        raw = raw.repartition(parts, "l_orderkey")
    lines = raw.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("price"),
        F.sum(F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("long")).alias("disc"),
        F.count("*").alias("n_lines"),
    )
    orders = scan(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), F.month("o_orderdate").alias("sub"), F.col("o_orderkey").alias("occ"),
        F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), F.to_date("o_orderdate").alias("day"),
    )
    customers = scan(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp"))
    dealt = orders.join(lines, orders.occ == lines.l_orderkey).drop("l_orderkey").repartition(parts, "entity")
    return dealt.join(customers, "entity")


STATS = """
lines AS (
  SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS price,
         sum(floor(l_extendedprice * l_discount)::BIGINT)::BIGINT AS disc, count(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey
), stats AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS period, month(o_orderdate)::INT AS sub, o_orderkey AS occ, o_orderstatus AS status,
         substr(o_orderpriority, 1, 1)::INT AS prio, o_orderdate::DATE AS day, qty, price, disc, n_lines, c_mktsegment AS segment, c_nationkey AS grp
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    return P.targets(stats(spark, d), "entity", "period", "segment", "sub", "occ", "grp", WEIGHTS, SUMS)


PANEL = f"""{STATS}, panel AS (
  SELECT entity, period, count(DISTINCT occ) AS n_occ, sum(qty)::BIGINT AS qty, sum(price)::BIGINT AS price, sum(disc)::BIGINT AS disc,
         max_by(segment, sub * 1000000000000 + occ) AS segment, max_by(grp, sub * 1000000000000 + occ) AS grp,
         sum(qty * 0.25::DOUBLE + price * 0.0009765625::DOUBLE + disc * -0.0625::DOUBLE) AS total_score,
         sum(qty * 0.25::DOUBLE + price * 0.0009765625::DOUBLE + disc * -0.0625::DOUBLE) / count(DISTINCT occ) AS target
  FROM stats GROUP BY entity, period
)"""


def predictions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Three predictions of each target: a (last period), b (mean of three), m (mean of the segment before), and more columns of the panel, which is made once and written."""
    from ..operators.folds import mean_baseline

    rows = panel(spark, d).select(
        "entity", "period", "segment", "grp", "n_occ", F.col("target").alias("actual"),
        P.exact_lag("target", "entity", "period", 1).alias("a"),
        P.recent_mean("target", "entity", "period", 3).alias("b"),
        P.prior_count("entity", "period").alias("n_prior"), *more,
    )
    rows = held(rows, "lagged")
    m = mean_baseline(rows, "period", "segment", "actual").withColumnRenamed("baseline", "m")
    return rows.join(m, ["segment", "period"]).filter("a is not null")


PREDICTIONS = f"""{PANEL}, seg AS (
  SELECT segment, period, sum(target) AS s, count(*) AS n FROM panel GROUP BY segment, period
), segmean AS (
  SELECT segment, period, sum(s) OVER w / sum(n) OVER w AS m FROM seg
  WINDOW w AS (PARTITION BY segment ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), predictions AS (
  SELECT * FROM (
    SELECT entity, period, p.segment, grp, n_occ, target AS actual,
           max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS a,
           avg(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
           row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS n_prior, m
    FROM panel p JOIN segmean USING (segment, period)
  ) WHERE a IS NOT NULL
)"""


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def bootstrap_sql(source: str, by: str, key: str, value: str, replicates: int, seed: int = 446) -> str:
    """evaluate.row_bootstrap as SQL tables; the last, boot, has by, low and high."""
    from ..operators.evaluate import FIELD, POISSON

    weight = " + ".join(f"((x + 0.5) / {FIELD}::DOUBLE > {c!r}::DOUBLE)::INT" for c in POISSON)
    return f"""draws AS (SELECT {by}, {key} AS k, {value} AS v, r, ({key} * (r * 48271 % {FIELD}) + r * 16807 + {seed}) % {FIELD} AS x FROM {source}, (SELECT unnest(range(1, {replicates} + 1))::BIGINT AS r)),
once AS (SELECT * REPLACE ((x * x + r) % {FIELD} AS x) FROM draws), twice AS (SELECT * REPLACE ((x * x + k) % {FIELD} AS x) FROM once),
means AS (SELECT {by}, r, sum(v * ({weight})) / sum({weight})::DOUBLE AS m FROM twice GROUP BY {by}, r),
boot AS (SELECT {by}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY {by})"""
