"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local session, where one machine is everything, gets a folder of its
    own when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_scan(docs: DataFrame) -> DataFrame:
    """docs if its rows have places in Parquet files, else docs as written to the shared folder."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return written(docs, "rows")
    return docs


def row_number(docs: DataFrame) -> Column:
    """A row's number by its file and its place there, which no packing of files into tasks changes. docs must be from as_scan.

    31 bits of a hash of the file's path, seeded so that no two files share them, then
    32 bits of the place: the same for every scan of the same files.
    """
    mine = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("_metadata.file_path")), F.lit(1 << 31))
    seed = 0
    while True:
        files = docs.groupBy(F.col("_metadata.file_path").alias("path"), mine(seed).alias("file")).agg(F.lit(1))
        n = files.agg(F.count("*").alias("paths"), F.count_distinct("file").alias("files")).first()
        if n["paths"] == n["files"]:
            return F.shiftleft(mine(seed), 32) + F.col("_metadata.row_index")
        seed += 1


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all columns kept, without the rows whose row_number is in the single column of gone. docs must be from as_scan."""
    row = unused(docs, "__row")
    return docs.withColumn(row, row_number(docs)).join(gone.toDF(row), row, "left_anti").select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: Column) -> Column:
    """True for the quarter of ids that no model here may learn from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))
