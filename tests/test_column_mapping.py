"""Column mapping counts exactly, whatever the columns' sizes."""

from pyspark.sql import functions as F

from panelwright.sources.tables import column_mapping


def test_a_few_values_beside_many_are_found(spark):
    right = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") + 1_000_000).alias("far"), F.col("id").cast("string").alias("text"))
    left = spark.range(20_000).select((F.col("id") % 7 + 1).cast("int").alias("line"), (F.col("id") * 4).alias("quarter"), F.when(F.col("id") % 2 == 0, F.lit("12")).alias("word"))
    got = {tuple(r) for r in column_mapping(left, right).collect()}
    assert got == {("line", "key", 7, 60_000, 7, 1.0), ("word", "text", 1, 60_000, 1, 1.0)}


def test_more_columns_than_a_word_has_bits(spark):
    right = spark.range(5).select(*(F.col("id").alias(f"r{i}") for i in range(70)))
    left = spark.range(3).select("id")
    assert sorted(r["right_column"] for r in column_mapping(left, right).collect()) == sorted(f"r{i}" for i in range(70))
