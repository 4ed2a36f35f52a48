"""Hand-computed cases of expressions and ranks, with nulls, ties and bounds."""

from pyspark.sql import functions as F

from panelwright.functions import exprs as E
from panelwright.functions import ranks as R


def one(spark, column, schema="a double, b double", row=(None, None)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_ratio_guards_the_denominator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(E.ratio("a", "b")).collect()] == [0.5, None, None, None, None]


def test_score_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(100.0, 1.0), (None, 2.0), (0.0, None)], "yards double, tds double")
    assert [r[0] for r in df.select(E.score({"yards": 0.1, "tds": 6})).collect()] == [16.0, 12.0, 0.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (None,)], "a double")
    assert [r[0] for r in df.select(E.clip("a", -1.0, 1.0)).collect()] == [1.0, -1.0, None]
    below, above = E.knots("a", 2.0)
    assert [tuple(r) for r in df.select(below, above).collect()] == [(2.0, 3.0), (-5.0, 0.0), (None, None)]


def test_ages(spark):
    df = spark.createDataFrame([("2000-09-01",), ("2000-09-02",), ("2000-08-31",), (None,)], "b string").select(F.to_date("b").alias("b"))
    assert [r[0] for r in df.select(E.age_at("b", F.lit(2020))).collect()] == [20, 19, 20, None]
    assert one(spark, E.experience(F.lit(2020), F.lit(2022))) is None
    assert one(spark, E.experience(F.lit(2020), F.lit(2022), clipped=True)) == 0


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "a string")
    assert [r[0] for r in df.select(E.lenient("a")).collect()] == [1.5, None, None, None]


def test_name_keys_differ_on_purpose(spark):
    names = ["D.J. Chark Jr.", "Brian Robinson Jr.", "Zoë O'Neil III", "Vic V", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [tuple(r) for r in df.select(E.compact_key("n"), E.spaced_key("n")).collect()] == [
        ("djchark", "dj chark"), ("brianrobinson", "brian robinson"), ("zoeoneil", "zoe oneil"), ("vicv", "vic"), (None, None),
    ]


def test_buckets_are_left_closed(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (4.0,), (None,)], "a double")
    assert [r[0] for r in df.select(E.buckets("a", (2, 4), ("low", "mid", "high"), "none")).collect()] == ["low", "mid", "high", "none"]


def test_others_max_without_self_join(spark):
    df = spark.createDataFrame([("r", 1, 5), ("r", 2, 7), ("r", 3, 7), ("r", 4, None), ("s", 5, 1)], "g string, k int, v int")
    got = {r["k"]: r["o"] for r in R.with_others_max(df, "v", ["g"], "k", "o").collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 7, 5: None}


def test_null_rules_of_aggregates(spark):
    df = spark.createDataFrame([("a", 1, None, 2.0), ("a", 2, 3.0, 0.0), ("b", 1, None, 1.0)], "g string, o int, v double, w double")
    got = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(R.known_sum("v"), F.sum("v"), R.last_known("v", "o"), R.weighted_mean("v", "w")).collect()}
    assert got == {"a": (3.0, 3.0, 3.0, None), "b": (0.0, None, None, None)}


def test_correlation_and_skewness(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 4.0, 4.0), (9.0, 18.0, 4.0), (None, 1.0, 4.0)], "x double, y double, z double")
    r, flat, skew = df.agg(R.correlation("x", "y"), R.correlation("x", "z"), R.sample_skew("x")).first()
    assert abs(r - 1) < 1e-12 and flat is None and abs(skew - 1.6301) < 1e-3
