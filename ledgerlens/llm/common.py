"""Shared plumbing: reading tables, the shared work folder, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``: exactly what ``bytes.split()`` splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Used for spark.checkpoint.dir only where the session has none and runs on one machine (tests).
DEFAULT_SHARED_DIR = "/tmp/checkpoints/ledgerlens"

#: Bytes of one Arrow batch between JVM and Python worker, about.
BATCH_BYTES = 1 << 20
#: Python workers live on between stages; with these they give freed arrays and batches back to the system instead of keeping them.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = DEFAULT_SHARED_DIR
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive
    the loss of any executor without recomputing what is above.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def with_prefix_offsets(counts: DataFrame, key: str, count: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``count`` over smaller values of the integer ``key``.

    Two levels, so that the single ordered task sees one row per ``block`` keys
    instead of one per key.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(key) / block))
    blocks = blocked.groupBy("_block").agg(F.sum(count).alias("_block_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_block_n").over(before), F.lit(0)).alias("_block_base"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(blocks, "_block")
        .withColumn(out, F.col("_block_base") + F.coalesce(F.sum(count).over(within), F.lit(0)))
        .drop("_block", "_block_base")
    )


#: Rows of one key from which it is hot, and hot keys that one broadcast may hold.
HOT_ROWS = 1_000
MAX_BROADCAST_ROWS = 200_000


def join_spread(rows: DataFrame, named: DataFrame, key: str, times: str) -> DataFrame:
    """``rows`` joined with ``named``, which has each ``key`` once and in ``times`` about how many rows it meets.

    Keys of many rows are sent to where their rows are, if a count shows that they are few; the
    others meet by shuffle, where no key is large. So no task gets all rows of a hot key.
    ``times`` goes; hand over a written table as ``named``.
    """
    hot = named.where(F.col(times) > HOT_ROWS).drop(times)
    n = hot.limit(MAX_BROADCAST_ROWS + 1).count()
    if not n or n > MAX_BROADCAST_ROWS:
        return rows.join(named.drop(times), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.where(F.col(times) <= HOT_ROWS).drop(times), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast(T.LongType())


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has its own bound: Spark counts rows by
    default, and thousands of long texts in one batch are held several times over by JVM and worker.
    Workers started from now on get WORKER_MEMORY, unless the session has its own values.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[..., tuple]], inputs: list[str]) -> DataFrame:
    """Adds ``fields`` from a Python function of the input cells, one Arrow batch at a time.

    ``make`` runs once in each task and returns the function. Columns named like a field
    are replaced, all others pass through untouched, of whatever type.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    out = {f.name for f in fields}
    kept = [i for i, c in enumerate(df.columns) if c not in out]
    at = [df.columns.index(c) for c in inputs]
    schema = T.StructType([df.schema[i] for i in kept] + fields)
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        of = make()
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            cells = [of(*row) for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            columns = list(zip(*cells, strict=True)) or [()] * len(kinds)
            added = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *added], names)

    return df.mapInArrow(run, schema)
