"""A landing zone: what is fresh, what is new, and appends that don't make a folder for each document."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def landed(spark: SparkSession, path: str, schema: str, newer_than: Column | None = None) -> DataFrame:
    """The rows of a landing table; with ``newer_than`` only of files changed since, by the file's own time, so old files are not opened.

    A path that nothing has been landed at is an empty table.
    """
    try:
        rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if newer_than is not None:
        rows = rows.where(F.col("_metadata.file_modification_time") >= newer_than)
    return rows.drop("bucket")


def missing(wanted: DataFrame, spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose keys the landing table doesn't have; only its keys are read."""
    return wanted.join(landed(spark, path, schema).select(*keys), keys, "left_anti")


def land(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Appends the rows whose keys aren't there yet, each key once (the least row), and says how many.

    Folders are hash buckets of the keys, so their number doesn't grow with the documents. The files of an append appear together when it's done; a
    second append of the same rows changes nothing. One writer at a time.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(rows.columns) if rest else rows.distinct()
    new = missing(once, spark, path, schema, keys).withColumn("bucket", bucket_of(keys, buckets))
    before = landed(spark, path, schema).count()
    new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return landed(spark, path, schema).count() - before
