"""A stored inverted index: written by source, searched with partition pruning and block maxima.

An index is a folder of two tables. ``postings`` has a row for each term and group of documents, in folders by source, generation and
bucket of the term's hash, sorted by term: the number of its documents, the largest frequency and smallest length among them, and the
(document, frequency, length) list. ``sources`` says which generation of a source is the current one, and how many documents and
tokens it has. A source is replaced by writing its next generation and then its row in ``sources``, so readers see the old one or the new one whole.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.work import written
from .retrieval import K1, B, idf, query_terms

#: Folders by term hash, documents that a group has about, and groups that one file holds.
BUCKETS = 16
GROUP_DOCS = 1024
FILE_GROUPS = 1024
#: Groups that are scored first, for a score that the others' bounds must reach.
FIRST_GROUPS = 16
#: Rows of (source, group) that one broadcast may hold.
MAX_BROADCAST_ROWS = 200_000


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def frequencies(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of tokens: runs of equal ones once sorted, inside the row."""
    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))[0]

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) > 0, F.transform(F.array(F.sort_array(tokens)), runs)[0]).otherwise(none)


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", buckets: int = BUCKETS, group_docs: int = GROUP_DOCS) -> None:
    """Writes the sources that ``docs`` has into the index at ``path``; a source that is there already is replaced, others stay.

    A NULL source is ''. Documents of a source are dealt to groups by hash of their key, so a term's list in a group has a bounded length however
    frequent the term or large the source. Texts are cut into terms once and written. One shuffle of the postings, by source, bucket and a range of groups: each such part is one file.
    NULL and empty texts count as documents without tokens. Keys should be unique in a source.
    """
    generation = time.time_ns()
    tokens = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(key).alias("doc"), tokenize(F.col(text)).alias("tokens"))
    rows = written(tokens.select("source", "doc", F.size("tokens").alias("len"), frequencies(F.col("tokens")).alias("terms")), "terms")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("len").cast("long")).alias("tokens"))
    counts = written(counts.withColumn("groups", F.ceil(F.col("n_docs") / group_docs).cast("long")), "sources")
    dealt = rows.join(counts.select("source", "groups"), "source").select("source", F.pmod(F.xxhash64("doc"), F.col("groups")).alias("grp"), "doc", "len", F.explode("terms").alias("t"))
    dealt = dealt.select("source", term_bucket(F.col("t.term"), buckets).alias("bucket"), F.floor(F.col("grp") / FILE_GROUPS).alias("part"), "grp", F.col("t.term").alias("term"), F.struct("doc", F.col("t.tf").alias("tf"), "len").alias("d"))
    grouped = dealt.repartition("source", "bucket", "part").groupBy("source", "bucket", "part", "term", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.max("d.tf").alias("max_tf"), F.min("d.len").alias("min_len"), F.collect_list("d").alias("docs")
    )
    out = grouped.withColumn("generation", F.lit(generation)).drop("part").sortWithinPartitions("source", "generation", "bucket", "term", "grp")
    out.write.mode("append").partitionBy("source", "generation", "bucket").parquet(f"{path}/postings")
    counts.select("source", F.lit(generation).alias("generation"), "n_docs", "tokens", F.lit(buckets).alias("buckets"), F.lit(docs.schema[key].dataType.simpleString()).alias("key_type")).coalesce(1).write.mode("append").parquet(f"{path}/sources")


def remove_source(spark: SparkSession, path: str, source: str) -> None:
    """Takes a source out of the index; its files stay until the folder is cleaned up."""
    current = spark.read.parquet(f"{path}/sources").where(F.col("source") == source).limit(1)
    current.select("source", F.lit(time.time_ns()).alias("generation"), F.lit(-1).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("tokens"), "buckets", "key_type").write.mode("append").parquet(f"{path}/sources")


@dataclass(frozen=True)
class Index:
    """A stored index as it is now: the postings of the sources' current generations, and the figures of the corpus."""

    postings: DataFrame
    n_docs: int
    tokens: int
    buckets: int

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The terms' postings; folders of other buckets are not read, nor row groups of other terms."""
        hashed = F.transform(F.array(*(F.lit(t) for t in [*terms, ""])), lambda t: term_bucket(t, self.buckets))
        wanted = sorted(set(self.postings.sparkSession.range(1).select(hashed).first()[0]))
        return self.postings.where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))

    def term_figures(self) -> DataFrame:
        """(term, df, groups) of every term; the lists are not read."""
        return self.postings.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("groups"))


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; the driver reads the table of sources, as their generations are what prunes folders."""
    listed = spark.read.parquet(f"{path}/sources")
    figures = F.struct("generation", "n_docs", "tokens", "buckets", "key_type")
    current = [r for r in listed.groupBy("source").agg(F.max_by(figures, "generation").alias("s")).select("source", "s.*").collect() if r["n_docs"] >= 0]
    if len({(r["buckets"], r["key_type"]) for r in current}) > 1:
        raise ValueError(f"parts of the index at {path} have different numbers of buckets or types of keys")
    key_type, buckets = (current[0]["key_type"], current[0]["buckets"]) if current else ("bigint", BUCKETS)
    schema = f"term string, grp bigint, n bigint, max_tf int, min_len int, docs array<struct<doc:{key_type},tf:int,len:int>>, source string, generation bigint, bucket int"
    try:
        postings = spark.read.schema(schema).parquet(f"{path}/postings")
    except AnalysisException:  # no document has had a token
        postings = spark.createDataFrame([], schema)
    # of partition columns only, so it's decided by folder; the folder of '' is read as NULL
    live = F.concat_ws("/", F.coalesce("source", F.lit("")), "generation").isin([f"{r['source']}/{r['generation']}" for r in current])
    return Index(postings.where(live), sum(r["n_docs"] for r in current), sum(r["tokens"] for r in current), buckets)


def term_score(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(length, F.lit(1)) / average))


def search(index: Index, query: str, top: int = 6, terms: dict[str, list[str]] | None = None, first: int = FIRST_GROUPS) -> DataFrame:
    """The ``top`` documents by BM25 score, ties by key: doc, score; the same rows as scanning all texts would give.

    A group's score is bounded by the sum of what its largest frequency and smallest length give for each term. The ``first`` groups by bound are
    scored; of the others only those are read whose bound reaches the ``top``-th best score found. Bounds come from the figures beside the
    lists. The driver gets a row for each query term, ``first`` groups and ``top`` scores.
    """
    spark = index.postings.sparkSession
    weights: Counter = query_terms(spark, query, terms)
    found = index.of_terms(sorted(weights))
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    if not df:
        return index.postings.limit(0).select(F.explode("docs").alias("d")).select("d.doc", F.lit(0.0).alias("score"))
    n, average = F.lit(index.n_docs), F.lit(index.tokens / index.n_docs)
    of_term = F.create_map(*(x for t, c in df.items() for x in (F.lit(t), F.struct(F.lit(c).alias("df"), F.lit(float(weights[t])).alias("weight")))))
    known = found.withColumn("t", of_term[F.col("term")])

    def part(tf: Column, length: Column) -> Column:
        return F.col("t.weight") * term_score(n, F.col("t.df"), tf, length, average)

    def scored(rows: DataFrame) -> DataFrame:
        d = rows.select("t", F.explode("docs").alias("d"))
        return d.groupBy(F.col("d.doc").alias("doc")).agg(F.sum(part(F.col("d.tf"), F.col("d.len"))).alias("score"))

    group = ["source", "generation", "grp"]
    bounds = written(known.groupBy(*group).agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound")), "bounds")
    best = bounds.orderBy(F.desc("bound"), *group).limit(first).collect()
    among = [F.col("source").eqNullSafe(r["source"]) & (F.col("generation") == r["generation"]) & (F.col("grp") == r["grp"]) for r in best]
    begun = [r["score"] for r in scored(known.where(reduce(or_, among))).orderBy(F.desc("score")).limit(top).select("score").collect()]
    least = begun[-1] if len(begun) == top else 0.0
    # sums of the same parts in another order may differ in their last digits
    reach = bounds.where(F.col("bound") >= least * (1 - 1e-9)).select(F.coalesce("source", F.lit("")).alias("source"), "generation", "grp")
    reach = F.broadcast(reach) if reach.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else reach
    kept = known.withColumn("source", F.coalesce("source", F.lit(""))).join(reach, group, "left_semi")
    return scored(kept).where("score > 0").orderBy(F.desc("score"), "doc").limit(top)
