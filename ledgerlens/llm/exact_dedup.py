"""Exact deduplication: groups by a 128-bit content hash, compared byte by byte.

Each text's normal form is hashed to 128 bits (MD5). Rows of one hash are a group; inside the groups that have
more than one row the bytes are compared, so that texts that only share their hash part again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, free_name, join_spread, materialize, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; NULL is empty.

    ``lower`` changes letters of other scripts too, but does the same where every character is one byte.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))


def content_hash(normal: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(normal.cast("binary")))


def _small(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = False, normal=folded, hashed=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and place.

    Rows are copies when their normal forms have the same bytes. Of each group the row with the smallest id stays
    (``keep_largest``: the largest); of rows that repeat this id one stays, the first by place. A row without id
    stays only if its group has no id at all, and keep_id is NULL then. NULL texts count as empty ones, and an empty text is a
    text like any other; an empty table gives no rows. Other columns of ``docs`` are not read and may have any names.
    place numbers the rows in the order they are read, so ``docs`` should be one whose rows keep their places when a
    task runs again, such as files.

    Texts are read twice and moved at most once: the first scan writes ids and hashes; the second compares the
    bytes of rows whose hash occurs more than once, combined in each task before the shuffle. If these hashes are too many to be sent to
    every executor, all texts are compared. Hot groups meet their figures by broadcast of the few hot hashes, so no task gets all of a group.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("place"), normal(F.col(text)).alias("normal")
    ).select("doc_id", "place", hashed(F.col("normal")).alias("h"), F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"))
    rows = materialize(rows, "hashes")

    if keep_largest:
        least = F.max(F.struct("doc_id", (-F.col("place")).alias("at")))
    else:
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("place").alias("at")))

    def figures(of: DataFrame, key: str) -> DataFrame:
        by = of.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), least.alias("first"))
        return materialize(by.select(key, "group_size", F.col("first.doc_id").alias("keep_id"), F.abs("first.at").alias("keep_place")), "groups")

    def told(of: DataFrame, groups: DataFrame, key: str) -> DataFrame:
        met = join_spread(of, groups.withColumn("times", F.col("group_size")), key, "times")
        return met.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256", "place")

    groups = figures(rows, "h")

    compared = docs.select(normal(F.col(text)).alias("normal")).select(hashed(F.col("normal")).alias("h"), "normal")
    repeated = groups.where("group_size > 1").select("h")
    if _small(repeated):
        compared = compared.join(F.broadcast(repeated), "h", "left_semi")
    texts = compared.groupBy("h", "normal").agg(F.count(F.lit(1)).alias("n"))
    collided = materialize(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "collisions")
    if collided.isEmpty():
        return told(rows, groups, "h")

    sent = F.broadcast(collided) if _small(collided) else collided
    apart = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("place"), normal(F.col(text)).alias("normal"))
    apart = apart.withColumn("h", hashed(F.col("normal"))).join(sent, "h", "left_semi")
    apart = materialize(apart.select("doc_id", "place", "normal", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256")), "collisions")
    return told(rows.join(sent, "h", "left_anti"), groups, "h").unionByName(told(apart, figures(apart, "normal"), "normal"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, whole; columns may have any names. Rows and places as in find_copies."""
    place = free_name(docs, "_place")
    gone = find_copies(docs, doc_id, text, keep_largest).where("not kept").select(F.col("place").alias(place))
    gone = materialize(gone, "copies")
    gone = F.broadcast(gone) if _small(gone) else gone
    return docs.withColumn(place, F.monotonically_increasing_id()).join(gone, place, "left_anti").drop(place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_copies(docs, keep_largest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The same rows in DuckDB's SQL.
SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
