"""Landing files in, validated tables and manifests out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError, TableContract
from .scratch import held


def scan(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; naming the columns is not needed for pruning, only for a contract."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({x: F.col(x).cast("string") for x in columns})


def strict_csv(spark: SparkSession, path: str, columns: Mapping[str, str], check: Column | None = None) -> DataFrame:
    """A headed CSV read as text, quotes stripped, cast to the given types; a bad cast or a failed check fails the read."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in columns])
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    out = raw.select(*(F.expr(f"trim(BOTH '\"' FROM trim(`{x}`))").cast(kind).alias(x) for x, kind in columns.items()))
    return out.filter(F.assert_true(check).isNull()) if check is not None else out


def json_archive(spark: SparkSession, path: str, items: str, item_schema: str, period_pattern: str = r"(\d{4})[^/]*$", one_object: bool = True) -> DataFrame:
    """JSON objects with a list of structs, one a file or one a line: a row an item, the period taken from the file's path (by default its name), meta kept."""
    schema = f"status string, meta map<string,string>, {items} array<struct<{item_schema}>>"
    raw = spark.read.schema(schema).option("multiLine", one_object).json(path)
    period = F.regexp_extract(F.col("_metadata.file_path"), period_pattern, 1).try_cast("int")
    return raw.select(period.alias("period"), "meta", F.inline(items))


def latest_snapshot(df: DataFrame, taken: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot; on a partition column only its files are read."""
    newest = df.agg(F.max(taken)).first()[0]
    return df.filter(F.col(taken) == F.lit(newest)) if newest is not None else df.limit(0)


def landed(spark: SparkSession, paths: Mapping[int, str], columns: Sequence[str], period: str = "period") -> DataFrame:
    """Files of several periods under one contract, stacked; a column that a period lacks is null there."""
    out = None
    for year, path in paths.items():
        df = spark.read.parquet(path)
        if not set(columns) & set(df.columns):
            raise ContractError(f"no expected column for {year}")
        df = df.select(*(x for x in columns if x in df.columns)).withColumn(period, F.lit(year))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ContractError("nothing landed")
    return out


def publish(df: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Write beside path, read back, compare schema, rows and keys; only then put it in place of what is there.

    What was at path stays until the new table has passed, and also if it has not.
    """
    spark, seen, beside = df.sparkSession, Observation(), f"{path}.{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(beside)
    back = spark.read.parquet(beside)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ContractError(f"{path} reads back with another schema")
    if back.count() != seen.get["n"]:
        raise ContractError(f"{path} reads back with another number of rows")
    if keys and not back.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ContractError(f"{path}: {', '.join(keys)} is not a key")
    moved(spark, beside, path)
    return spark.read.parquet(path)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder to another, which is deleted first, by Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(target), True)
    if not system.rename(path(source), path(target)):
        raise OSError(f"can't rename {source} to {target}")


def named_by_partition(spark: SparkSession, path: str, prefix: str) -> None:
    """Moves the files of path/<column>=<value>/ to path/<prefix>-<number>_<value>.<kind>: one rename a file, no data."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(paths(path)):
        value = folder.getPath().getName().partition("=")[2]
        if folder.isDirectory() and value:
            for i, f in enumerate(system.listStatus(folder.getPath())):
                kind = f.getPath().getName().rpartition(".")[2]
                if not system.rename(f.getPath(), paths(f"{path}/{prefix}-{i}_{value}.{kind}")):
                    raise OSError(f"can't rename {f.getPath()}")
            system.delete(folder.getPath(), True)


def preserve(df: DataFrame, path: str) -> None:
    """Write unless there is something already."""
    df.write.mode("ignore").parquet(path)


def csv_sink(df: DataFrame, path: str, order: Sequence[str | Column] = ()) -> None:
    """One headed CSV file; for report tables only."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, bytes and sha256 of every file under a path whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_manifest(spark: SparkSession, path: str, by: str) -> DataFrame:
    """file (the value of the partition column by), bytes and sha256 over the sorted hashes of a partition's part files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    each = files.select(F.regexp_extract("path", f"/{by}=([^/]+)/", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return each.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))


def drop_partitions(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """Deletes partition folders, by Hadoop's file system, wherever the path is."""
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dataset_manifest(df: DataFrame, name: str, period: Column) -> DataFrame:
    """One row: dataset, rows, columns, column names and the periods covered."""
    return df.agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(period)).alias("periods")).select(
        F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("column_names"), F.array_join(F.transform("periods", lambda p: p.cast("string")), ",").alias("periods")
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """file and what became of it, of all that aren't the same in both manifests."""
    a, b = before.select("file", F.col("sha256").alias("was")), after.select("file", F.col("sha256").alias("now"))
    what = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "file", "full").select("file", what.alias("status")).filter("status is not null")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in rows replaced by them."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def frozen(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """df without columns that tell the present, checked."""
    out = df.drop(*forbidden)
    TableContract({x: x for x in out.columns}, forbidden=forbidden).apply(out)
    return out


def segment_manifest(df: DataFrame, segment: str, features: Sequence[str]) -> DataFrame:
    """segment, spec, ord, feature: in column order, those with `any` value in the segment and those `complete` there."""
    counts = df.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("n"), *(F.count(x).alias(f"k{i}") for i, x in enumerate(features)))
    kept = lambda test: F.filter(F.array(*(F.when(test(F.col(f"k{i}")), F.lit(x)) for i, x in enumerate(features))), lambda x: x.isNotNull())
    specs = F.create_map(F.lit("any"), kept(lambda k: k > 0), F.lit("complete"), kept(lambda k: k == F.col("n")))
    return counts.select("segment", F.explode(specs).alias("spec", "features")).select("segment", "spec", F.posexplode("features").alias("ord", "feature"))


def profile(df: DataFrame) -> DataFrame:
    """column_name, data_type, n_rows, n_null, null_pct, n_distinct (approximate) and whether it may be an id, of every column, in one pass.

    An id candidate has no nulls and as many values as rows, up to the error of the estimate (3 x 2%).
    """
    cols = df.columns
    aggs = [F.count("*").alias("n")]
    for i, x in enumerate(cols):
        aggs += [F.count_if(F.col(x).isNull()).alias(f"z{i}"), F.approx_count_distinct(x, 0.02).alias(f"d{i}")]
    kinds = dict(df.dtypes)
    rows = F.array(*(F.struct(F.lit(x).alias("column_name"), F.lit(kinds[x]).alias("data_type"), F.col("n").alias("n_rows"), F.col(f"z{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, x in enumerate(cols)))
    out = df.agg(*aggs).select(F.inline(rows)).withColumn("null_pct", F.try_divide(F.col("n_null") * 100.0, "n_rows"))
    return out.withColumn("id_candidate", (F.col("n_null") == 0) & (F.col("n_distinct") >= 0.94 * F.col("n_rows")))


def first_available(df: DataFrame, features: Sequence[str], period: str) -> DataFrame:
    """feature and the first period that has a value."""
    mins = df.agg(*(F.min(F.when(F.col(x).isNotNull(), F.col(period))).alias(x) for x in features))
    return mins.unpivot([], list(features), "feature", "first_period")


def coverage(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """n, rows with all and with any feature, and rates, by group."""
    every = F.greatest(*(F.isnull(x).cast("int") for x in features)) == 0 if len(features) > 1 else F.col(features[0]).isNotNull()
    some = F.coalesce(*(F.col(x).cast("string") for x in features)).isNotNull()
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(every).alias("n_complete"), F.count_if(some).alias("n_any")).withColumn("complete_rate", F.try_divide("n_complete", "n"))


FAMILIES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number", "string": "text", "date": "date", "timestamp": "date"}
#: Columns that one word of a value's signature marks.
MARKS = 62


def marked(df: DataFrame, side: str, words: int) -> DataFrame:
    """family, the value (whole for integers, as text for others) and, word by word, a bit for the column: a row a known value."""
    known = [(x, FAMILIES[kind]) for x, kind in df.dtypes if kind in FAMILIES]
    bits = lambda i: {f"left_{w}": (1 << i % MARKS if side == "left" and i // MARKS == w else 0) for w in range(words)} | {f"right_{w}": (1 << i % MARKS if side == "right" and i // MARKS == w else 0) for w in range(words)}
    of = lambda i, x, f: F.struct(F.lit(f).alias("family"), (F.col(x).cast("long") if f == "integer" else F.lit(None).cast("long")).alias("whole"), (F.lit(None).cast("string") if f == "integer" else F.col(x).cast("string")).alias("v"), *(F.lit(b).cast("long").alias(c) for c, b in bits(i).items()))
    return df.select(F.inline(F.array(*(of(i, x, f) for i, (x, f) in enumerate(known))))).filter("whole is not null or v is not null")


def column_mapping(left: DataFrame, right: DataFrame, least: float = 0.95) -> DataFrame:
    """left_column, right_column, n_left, n_right and n_common (exact distinct values) and contained, the share of left's values that right has, of pairs of one family with `least` of them.

    Each table is read once: values are collapsed to the set of columns that hold them, these
    sets are counted, and all pairs come from the counts. No sketch proposes pairs: it says
    nothing of a column of a few values beside one of many.
    """
    names = {"left": [x for x, kind in left.dtypes if kind in FAMILIES], "right": [x for x, kind in right.dtypes if kind in FAMILIES]}
    words = -(-max(map(len, names.values()), default=0) // MARKS)
    shape = "left_column string, right_column string, n_left long, n_right long, n_common long, contained double"
    if not all(names.values()):
        return left.sparkSession.createDataFrame([], shape)
    signature = [f"{side}_{w}" for side in names for w in range(words)]
    values = marked(left, "left", words).unionByName(marked(right, "right", words)).groupBy("family", "whole", "v").agg(*(F.bit_or(c).alias(c) for c in signature))
    sets = values.groupBy("family", *signature).agg(F.count("*").alias("n"))
    held_by = lambda side: F.array_compact(F.array(*(F.when(F.col(f"{side}_{i // MARKS}").bitwiseAND(F.lit(1 << i % MARKS)) != 0, F.lit(x)) for i, x in enumerate(names[side]))))
    sets = held(sets.select("n", held_by("left").alias("__left"), held_by("right").alias("__right")), "sets")
    size = lambda side: sets.select(F.explode(f"__{side}").alias(f"{side}_column"), "n").groupBy(f"{side}_column").agg(F.sum("n").alias(f"n_{side}"))
    common = sets.select(F.explode("__left").alias("left_column"), "__right", "n").select("left_column", F.explode("__right").alias("right_column"), "n").groupBy("left_column", "right_column").agg(F.sum("n").alias("n_common"))
    out = common.join(size("left"), "left_column").join(size("right"), "right_column")
    return out.withColumn("contained", F.col("n_common") / F.col("n_left")).filter(F.col("contained") >= least).select(*(c.split()[0] for c in shape.split(", ")))
