"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records into buckets of a memory's size by a seeded hash. Pass
two shuffles each bucket by Fisher-Yates (what Spark's ``shuffle`` function runs) and
deals the permutation out to the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_BROADCAST_ROWS, materialize, table, utf8_size, with_prefix_offsets

SHARDS = 16
SEED = 20_240_229
#: Bytes of text and rows that one bucket holds, about.
BUCKET_BYTES = 8_000_000
BUCKET_ROWS = 50_000
#: Tasks that shuffle buckets at most; part of the order.
PARTS = 20_000


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _in_order(records: Column) -> Column:
    """By the two hashes that lead each record; works for records that can't be compared."""
    def before(a: Column, b: Column) -> Column:
        return (
            F.when(a["h1"] < b["h1"], -1).when(a["h1"] > b["h1"], 1)
            .when(a["h2"] < b["h2"], -1).when(a["h2"] > b["h2"], 1).otherwise(0)
        )

    return F.array_sort(records, before)


def shuffle_to_shards(records: DataFrame, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds shard (int) and slot (long): a seeded random order, dealt evenly.

    Shard sizes differ by one row at most (law ``rows``); slots are gapless from 0. ``size`` gives
    a record's bytes. Records go whole, of any types, NULLs included; columns named shard
    or slot are replaced, others may have any names; an empty table gives no rows. The order depends on the rows, the
    seed and the bucket bounds, not on files, partitions, the session's settings or the plan, as far as copies of no row are more rows or bytes than a
    bucket holds. Fisher-Yates draws from a generator for each task, so bucket b goes to task b modulo PARTS and tasks shuffle
    their buckets by number; a bucket's place comes with it as a row of its own, so nothing moves the filled buckets again. Copies of such a row are spread over the buckets by their place in
    the input, and the scattered table is written first, so the input should be one whose rows
    keep their places when a task runs again, such as files.
    """
    records = records.drop("shard", "slot")
    hashable = [F.col(f"`{f.name}`") for f in records.schema if not _has_map(f.dataType)]
    # a record goes as one column, so its columns may have any names
    hashed = records.select(
        F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"), F.xxhash64(F.lit(seed), *hashable).alias("h1"),
        F.xxhash64(F.lit(~seed), *hashable).alias("h2"), F.coalesce(size, F.lit(0)).alias("bytes"),
    )

    by_hash = materialize(hashed.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "hashes")
    rows, total = by_hash.agg(F.sum("n"), F.sum("bytes")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes), -(-(rows or 0) // bucket_rows))
    # copies that fill more than a bucket, by rows or by bytes; fewer than there are buckets
    hot = by_hash.where((F.col("n") > 1) & ((F.col("n") > bucket_rows) | (F.col("bytes") > bucket_bytes))).select("h1", F.lit(True).alias("hot"))
    is_hot = bool(hot.take(1))

    place = F.pmod(F.col("h1"), F.lit(buckets))
    if is_hot:
        hashed = hashed.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot) if buckets <= MAX_BROADCAST_ROWS else hot, "h1", "left")
        place = F.when(F.col("hot"), F.pmod(F.xxhash64("h1", "place"), F.lit(buckets))).otherwise(place)
    scattered = hashed.select(place.alias("bucket"), F.struct("h1", "h2", "record").alias("r"))
    if is_hot:
        scattered = materialize(scattered, "scattered")
        counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = by_hash.groupBy(F.pmod(F.col("h1"), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))
    offsets = with_prefix_offsets(counts, "bucket", "n", "base").select("bucket", "base")

    parts = min(buckets, PARTS)
    task = F.pmod("bucket", F.lit(parts)).cast("int").alias("task")
    rows = scattered.select(task, "bucket", "r", F.lit(None).cast("long").alias("base"))
    places = offsets.select(task, "bucket", F.lit(None).cast(rows.schema["r"].dataType).alias("r"), "base")
    filled = rows.unionAll(places).repartitionById(parts, "task").groupBy("task", "bucket").agg(F.max("base").alias("base"), F.collect_list("r").alias("rs"))
    # buckets in order within a task: the generator gives the same when a task runs again
    shuffled = filled.sortWithinPartitions("bucket").select("base", F.shuffle(_in_order(F.col("rs")), F.lit(seed)).alias("rs"))
    dealt = shuffled.select("base", F.posexplode("rs").alias("at", "r")).withColumn("g", F.col("base") + F.col("at"))
    return dealt.select("r.record.*", (F.col("g") % shards).cast("int").alias("shard"), F.floor(F.col("g") / shards).cast("long").alias("slot"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """A folder for each shard, rows in the order of their slots within and across its files."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = shuffle_to_shards(docs, utf8_size(F.col("text")) + 1)
    return dealt.select(
        "doc_id",
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
