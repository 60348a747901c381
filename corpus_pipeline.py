"""The corpus pipeline: quality rules, quality classifier, near duplicates, decontamination, packing.

Each stage gets the documents that its predecessor kept and is judged on them. All but the last
return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules
from ledgerlens.llm.common import append_columns, free_name, materialize, table
from ledgerlens.llm.encoders import default_vocabulary

#: Ids that one broadcast may hold: 16 MB of them.
MAX_BROADCAST_IDS = 1_000_000


def _judged(docs: DataFrame, inputs: list[str], operator: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` that ``operator`` keeps, as they were: columns named like one that it adds are put aside meanwhile."""
    adds = {c.lower() for c in operator(docs.select(*inputs)).columns} - set(inputs)
    aside = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in adds}
    kept = operator(docs.withColumnsRenamed(aside)).where(keep)
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and no learned rule rejects."""
    rules = quality_rules.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _judged(docs, ["doc_id", "text"], lambda d: quality_rules.judge(d, rules), "kept")


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views keep.

    They learn from the labelled rows of the whole table, as the rules leave hardly any bad ones, and hand each other
    pseudo-labels of what the rules kept.
    """
    inputs = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    model = quality_classifier.fit(docs.select(*inputs), table(spark, sf_dir, "labels"), labelled_from=table(spark, sf_dir, "documents"))
    return _judged(docs, inputs, lambda d: quality_classifier.score(d, model), "kept")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of least doc_id.

    Rows without words or without doc_id stay; of such that repeat doc_id and text one stays. A doc_id may repeat with other texts:
    its rows are told apart by the key of their shingles.
    """
    linked = materialize(ngram_join.linked_rows(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull()), "linked")
    kept = docs.join(_small(linked.where("not stays").select("doc_id").distinct()), "doc_id", "left_anti")
    repeated = linked.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        key, empty = free_name(docs, "_key"), ngram_join.gram_key(None, ngram_join._Words())

        def make():
            words = ngram_join._Words()
            return lambda text: (ngram_join.gram_key(text, words),)

        rows = append_columns(docs.join(_small(repeated), "doc_id", "left_semi"), [T.StructField(key, T.BinaryType())], make, ["text"])
        stay = linked.where("stays").select("doc_id", F.col("key").alias(key)).join(_small(repeated), "doc_id", "left_semi")
        worded = rows.where(F.col(key) != F.lit(empty)).join(stay, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        blank = rows.where(F.col(key) == F.lit(empty)).dropDuplicates(["doc_id", "text"])
        kept = kept.join(_small(repeated), "doc_id", "left_anti").select(docs.columns).unionByName(worded.unionByName(blank).select(docs.columns))
    return kept.select(docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """Sent to all executors if its size is checked to be under the bound; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in any occurrence of a benchmark window."""
    items = table(spark, sf_dir, "benchmark")
    return _judged(docs, ["doc_id", "text"], lambda d: decontamination.find_overlaps(d, items), "n_hit = 0")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 1024 tokens."""
    return packing.pack_documents(docs, default_vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The learned stages have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
