"""Sources, sinks, manifests and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.contracts import TableContract
from ..sources import tables as S
from .base import PANEL, Query, held, panel, registered, scan, scratch

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registered(QUERIES, ORACLES)

#: Documents a part file at most, so that a file's bytes fit in a task that hashes them.
TEXT_ROWS = 2_000


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal BETWEEN 0 AND 5000")
def s2_projected_scan(spark, d):
    """Two columns and a range reach the Parquet reader."""
    return S.as_text(S.scan(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]), ["c_mktsegment"]).filter(F.col("c_acctbal").between(0, 5000)).drop("c_acctbal")


@query("SELECT c_custkey AS entity, c_mktsegment AS segment, c_acctbal AS amount FROM customer")
def p1_semantic_columns(spark, d):
    """Physical columns under a contract, found without regard to case."""
    return TableContract({"entity": "C_CUSTKEY", "segment": "C_MktSegment", "amount": "c_acctbal"}, forbidden=("is_active",)).apply(scan(spark, d, "customer"))


@query("SELECT 'period' AS kind, p::VARCHAR AS value FROM range(1990, 2005) r(p) WHERE p NOT IN (SELECT year(o_orderdate) FROM orders)")
def p15_missing_periods(spark, d):
    """P15, U4."""
    return TableContract({"period": "period"}, periods=range(1990, 2005)).gaps(scan(spark, d, "orders").select(F.year("o_orderdate").alias("period")))


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def s4_strict_csv(spark, d):
    """Written as CSV with quotes, read back under a strict schema with a range check."""
    path = scratch(spark, "csv")
    scan(spark, d, "part").select("p_partkey", F.concat(F.lit('"'), "p_brand", F.lit('"')).alias("p_brand"), "p_size", "p_retailprice").write.option("header", True).csv(path)
    return S.strict_csv(spark, path, {"p_partkey": "bigint", "p_brand": "string", "p_size": "int", "p_retailprice": "double"}, F.expr("p_size between 1 and 1000"))


@query("""WITH n AS (SELECT year(o_orderdate)::INT AS period, o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL) SELECT period, (id // 1000)::VARCHAR AS part, (year(DATE '2000-01-01') - 5)::VARCHAR || '-2001' AS span, id, n FROM n""")
def s5_json_archive(spark, d):
    """Nested JSON in files a period, the period from the file's name, its meta kept beside every item."""
    path = scratch(spark, "json")
    by = scan(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    one = by.groupBy("year", F.floor(F.col("id") / 1000).alias("part")).agg(F.collect_list(F.struct("id", "n")).alias("players"))  # at most 1000 ids a list
    meta = F.create_map(F.lit("part"), F.col("part").cast("string"), F.lit("span"), F.lit("1995-2001"))
    one.select("year", F.lit("ok").alias("status"), meta.alias("meta"), "players").write.partitionBy("year").json(path)
    S.named_by_partition(spark, path, "archive")
    got = S.json_archive(spark, path, "players", "id bigint, n bigint", one_object=False)
    return got.select("period", F.col("meta")["part"].alias("part"), F.col("meta")["span"].alias("span"), "id", "n")


@query(f"WITH {PANEL} SELECT entity, period, segment, target FROM panel")
def s8_validated_write(spark, d):
    """Written beside, checked, put in place of an older table; a third write leaves it alone."""
    path = scratch(spark, "panel")
    p = panel(spark, d).select("entity", "period", "segment", "target")
    S.publish(p.filter("period = 1995"), path, ["entity", "period"])  # replaced by the whole below
    out = S.publish(p, path, ["entity", "period"])
    S.preserve(out.limit(0), path)
    return out


#: Meaning, formula, sources and whether a model may read it, by feature.
DICTIONARY = {
    "lag_1": ("score of the period before", "target(t-1)", "orders,lineitem", True),
    "lag_3": ("score three periods before", "target(t-3)", "orders,lineitem", True),
    "target": ("score of the period", "total_score / n_occ", "orders,lineitem", False),
}


@query(f"""WITH {PANEL}, l AS (SELECT period, target, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS lag_3 FROM panel),
d(feature, meaning, formula, sources, model_input) AS (VALUES {', '.join(f"('{k}', '{m}', '{f}', '{s}', {str(b).lower()})" for k, (m, f, s, b) in DICTIONARY.items())})
SELECT d.*, CASE feature WHEN 'lag_1' THEN (SELECT min(period) FILTER (lag_1 IS NOT NULL) FROM l) WHEN 'lag_3' THEN (SELECT min(period) FILTER (lag_3 IS NOT NULL) FROM l) ELSE (SELECT min(period) FILTER (target IS NOT NULL) FROM l) END AS first_period FROM d""")
def s18_feature_dictionary(spark, d):
    """Dictionary rows beside the earliest period that has a value."""
    from ..operators import panel as P

    p = panel(spark, d).select("period", "target", *(P.exact_lag("target", "entity", "period", k).alias(f"lag_{k}") for k in (1, 3)))
    rows = spark.createDataFrame([(k, *v) for k, v in DICTIONARY.items()], "feature string, meaning string, formula string, sources string, model_input boolean")
    return rows.join(S.first_available(p, list(DICTIONARY), "period"), "feature")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'new' ELSE 'old' END AS version, c_nationkey AS model FROM customer""")
def s13_upsert(spark, d):
    """One model's rows replaced."""
    old = scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("version"), F.col("c_nationkey").alias("model"))
    return S.upsert(old, old.filter("model = 3").withColumn("version", F.lit("new")), "model")


@query("""SELECT 'orders' AS dataset, count(*) AS n_rows, 2 AS n_columns, 'o_orderkey,o_orderdate' AS column_names, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS periods FROM orders""")
def s11_dataset_manifest(spark, d):
    return S.dataset_manifest(scan(spark, d, "orders").select("o_orderkey", "o_orderdate"), "orders", F.year("o_orderdate"))


@query("""SELECT b::VARCHAR AS file, CASE WHEN b % 7 = 0 THEN 'changed' ELSE 'removed' END AS status FROM (SELECT DISTINCT doc_id % 25 AS b FROM documents) WHERE b % 7 = 0 OR b % 5 = 0""")
def s12_preservation(spark, d):
    """Part files hashed before and after some partitions of a table are rewritten and others deleted."""
    path = scratch(spark, "landed")
    rows = scan(spark, d, "documents").select("doc_id", "text", "source", (F.col("doc_id") % 25).alias("bucket"))
    rows.write.option("maxRecordsPerFile", TEXT_ROWS).partitionBy("bucket").parquet(path)
    before = held(S.folder_manifest(spark, path, "bucket"), "manifest")
    corrected = spark.read.parquet(path).filter("bucket % 7 = 0").withColumn("source", F.upper("source")).withColumn("corrected", F.lit(True))
    corrected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", TEXT_ROWS).partitionBy("bucket").parquet(path)
    gone = before.select("file").filter("file % 5 = 0 and file % 7 != 0").collect()  # at most one a bucket
    S.drop_partitions(spark, path, [f"bucket={r['file']}" for r in gone])
    return S.changed_files(before, held(S.folder_manifest(spark, path, "bucket"), "manifest"))


@query()
def s11_file_manifest(spark, d):
    """Bytes and checksums of the part files that documents are landed in."""
    path = scratch(spark, "documents")
    scan(spark, d, "documents").write.option("maxRecordsPerFile", TEXT_ROWS).parquet(path)
    return S.manifest(spark, path, "*.parquet").withColumn("file", F.regexp_replace("file", r"^(part-\d+)-.*(\.c|-c)(\d+)\..*$", "$1-$3"))


PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "known_price": "double"}


@query(" UNION ALL ".join(f"SELECT '{x}' AS column_name, '{kind}' AS data_type, count(*) AS n_rows, count(*) FILTER ({x} IS NULL) AS n_null, 100.0::DOUBLE * count(*) FILTER ({x} IS NULL) / count(*) AS null_pct, count({x}) = count(*) AND count(DISTINCT {x}) = count(*) AS id_candidate, (SELECT string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) FROM orders) AS periods FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS known_price FROM orders)" for x, kind in PROFILED.items()))
def s16_profile(spark, d):
    """Types, rows, nulls and id candidates of every column in one pass, beside the periods covered."""
    o = scan(spark, d, "orders").withColumn("known_price", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    periods = S.dataset_manifest(o, "orders", F.year("o_orderdate")).select("periods").first()["periods"]
    return S.profile(o.select(*PROFILED)).drop("n_distinct").withColumn("periods", F.lit(periods))


@query("SELECT l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_suppkey::VARCHAR AS l_suppkey FROM lineitem")
def s3_text_codes(spark, d):
    """S3: codes flattened to text."""
    return S.as_text(S.scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"]), ["l_linenumber", "l_suppkey"])


@query("SELECT event_id, user_id, ts::DATE::VARCHAR AS day FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)")
def s6_latest_snapshot(spark, d):
    """Rows of the newest dated folder; only its files are read."""
    path = scratch(spark, "snapshots")
    scan(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("snapshot_date")).write.partitionBy("snapshot_date").parquet(path)
    return S.latest_snapshot(spark.read.parquet(path)).select("event_id", "user_id", F.col("snapshot_date").cast("string").alias("day"))


@query("SELECT c_mktsegment AS segment, c_nationkey AS grp, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def s10_report_csv(spark, d):
    """A report table as one sorted CSV file, read back strictly."""
    path = scratch(spark, "report")
    report = scan(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    S.csv_sink(report, path, ["segment", "grp"])
    return S.strict_csv(spark, path, {"segment": "string", "grp": "bigint", "n": "bigint", "total": "double"}, F.expr("n > 0"))


@query(f"WITH {PANEL} SELECT segment, period, entity, qty, row_number() OVER (PARTITION BY segment, period ORDER BY qty DESC, entity) AS place FROM panel")
def s17_published_ranking(spark, d):
    """One ranked snapshot published as Parquet and as CSV, both read back and found equal in rows."""
    from ..operators.places import Rank, with_places
    from ..operators.contracts import ContractError

    ranked = with_places(panel(spark, d).select("segment", "period", "entity", "qty"), ["segment", "period"], "qty", ["entity"], {"place": Rank("qty", "first", True)})
    out = S.publish(ranked, scratch(spark, "ranking"), ["segment", "period", "entity"])
    path = scratch(spark, "ranking-csv")
    out.write.option("header", True).csv(path)
    if spark.read.option("header", True).csv(path).count() != out.count():
        raise ContractError("the CSV copy has other rows than the table")
    return out


@query(f"""WITH {PANEL}, l AS (
  SELECT segment, qty, price, disc, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1,
         max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 6 PRECEDING AND 6 PRECEDING) AS lag_6 FROM panel
), c AS (
  SELECT segment, count(*) AS n, count(qty) AS qty, count(price) AS price, count(disc) AS disc, count(lag_1) AS lag_1, count(lag_6) AS lag_6 FROM l GROUP BY segment
), f AS (
  SELECT segment, n, unnest(['qty', 'price', 'disc', 'lag_1', 'lag_6']) AS feature, unnest([qty, price, disc, lag_1, lag_6]) AS k, unnest([0, 1, 2, 3, 4]) AS place FROM c
), s AS (
  SELECT segment, 'any' AS spec, place, feature FROM f WHERE k > 0 UNION ALL SELECT segment, 'complete', place, feature FROM f WHERE k = n
)
SELECT segment, spec, row_number() OVER (PARTITION BY segment, spec ORDER BY place) - 1 AS ord, feature FROM s""")
def s15_segment_features(spark, d):
    """Ordered feature lists as rows, from the columns and segments of the written panel."""
    from ..operators import panel as P

    lags = (P.exact_lag("target", "entity", "period", k).alias(f"lag_{k}") for k in (1, 6))
    written = held(panel(spark, d).select("segment", "qty", "price", "disc", *lags), "features")
    families = [x for x in written.columns if x.startswith("lag_")]  # P9: columns by prefix, and all but a list
    return S.segment_manifest(written, "segment", [x for x in written.columns if x not in ("segment", *families)] + families)


@query(f"WITH {PANEL}, l AS (SELECT period, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1, max(target) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS lag_3 FROM panel) SELECT 'lag_1' AS feature, min(period) FILTER (lag_1 IS NOT NULL) AS first_period FROM l UNION ALL SELECT 'lag_3', min(period) FILTER (lag_3 IS NOT NULL) FROM l")
def s18_first_available(spark, d):
    """The earliest period of each feature."""
    from ..operators import panel as P

    p = panel(spark, d).select("period", *(P.exact_lag("target", "entity", "period", k).alias(f"lag_{k}") for k in (1, 3)))
    return S.first_available(p, ["lag_1", "lag_3"], "period")


@query("WITH o AS (SELECT *, year(o_orderdate)::INT AS period FROM orders) SELECT o_orderkey, CASE WHEN period % 2 = 1 THEN o_orderstatus END AS o_orderstatus, period, CASE WHEN period % 2 = 0 THEN o_totalprice END AS o_totalprice FROM o")
def s7_landed_periods(spark, d):
    """Files of all periods, odd and even ones with different columns, stacked."""
    o, path = held(scan(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "orders"), scratch(spark, "landed")
    years = [r["year"] for r in o.select("year").distinct().collect()]  # a row a period
    o.filter("year % 2 = 1").select("o_orderkey", "o_orderstatus", "year").write.partitionBy("year").parquet(f"{path}/1")
    o.filter("year % 2 = 0").select("o_orderkey", "o_totalprice", "year").write.partitionBy("year").parquet(f"{path}/0")
    return S.landed(spark, {y: f"{path}/{y % 2}/year={y}" for y in sorted(years)}, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT c_custkey, c_name FROM customer")
def s14_frozen(spark, d):
    """Present-day columns dropped and their absence checked."""
    return S.frozen(scan(spark, d, "customer"), ["c_acctbal", "c_mktsegment", "c_nationkey"])


MAPPED = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "orders": ["o_orderkey", "o_custkey"]}
MAPPING = " UNION ALL ".join(
    f"SELECT '{x}' AS left_column, '{y}' AS right_column, (SELECT count(DISTINCT {x}) FROM lineitem) AS n_left, (SELECT count(DISTINCT {y}) FROM orders) AS n_right, (SELECT count(*) FROM (SELECT DISTINCT {x} FROM lineitem WHERE {x} IN (SELECT {y} FROM orders))) AS n_common"
    for x in MAPPED["lineitem"] for y in MAPPED["orders"]
)


@query(f"WITH m AS ({MAPPING}) SELECT *, round(n_common / n_left::DOUBLE, 6) AS contained FROM m WHERE n_common >= 0.95 * n_left")
def s16_column_mapping(spark, d):
    """Which columns of one table hold the values of which columns of another, from exact counts."""
    return S.column_mapping(scan(spark, d, "lineitem").select(*MAPPED["lineitem"]), scan(spark, d, "orders").select(*MAPPED["orders"])).withColumn("contained", F.round("contained", 6))
