"""A stored index gives what a scan of the texts gives, and reads less."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import index, retrieval
from ledgerlens.sources.work import written

ROWS = [
    (1, "apple apple pear", "a"), (2, "pear 资产负债", "a"), (3, None, "a"), (4, "", "b"), (5, "apple plum plum plum", "b"), (6, "资产 apple", None), (7, "pear " * 40, None),
]
SCHEMA = "doc_id long, text string, source string"


def same(index_rows, scan_rows):
    assert [r.doc for r in index_rows] == [r.doc_id for r in scan_rows]
    assert [r.score for r in index_rows] == pytest.approx([r.score for r in scan_rows])


def test_replaced_and_removed_sources(spark, tmp_path):
    path, df = f"{tmp_path}/ix", spark.createDataFrame(ROWS, SCHEMA)
    index.write_index(df.where("source = 'a'"), path, group_docs=2)
    index.write_index(spark.createDataFrame([(9, "apple " * 9, "b")], SCHEMA), path, group_docs=2)
    before = index.open_index(spark, path)
    index.write_index(df.where("source is null or source = 'b'"), path, group_docs=2)
    for query in ("apple", "资产 pear", "plum apple apple", "nothing"):
        same(index.search(index.open_index(spark, path), query, first=1).collect(), retrieval.bm25(df, query, "doc_id").collect())
    assert index.search(before, "apple").first().doc == 9  # opened before: the old generation, whole
    index.remove_source(spark, path, "a")
    left = df.where("source is null or source = 'b'")
    same(index.search(index.open_index(spark, path), "apple pear").collect(), retrieval.bm25(left, "apple pear", "doc_id").collect())


def test_empty_and_blank_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", "a")], SCHEMA)
    index.write_index(df, f"{tmp_path}/blank")
    found = index.open_index(spark, f"{tmp_path}/blank")
    assert found.n_docs == 2 and index.search(found, "apple").count() == 0 and found.term_figures().count() == 0
    index.write_index(df.limit(0), f"{tmp_path}/none")
    assert index.search(index.open_index(spark, f"{tmp_path}/none"), "apple").columns == ["doc", "score"]


def test_frequencies(spark):
    tokens = [[], ["a"], ["b", "a", "b"], ["x"] * 1000]
    got = spark.createDataFrame([(t,) for t in tokens], "t array<string>").select(index.frequencies(F.col("t")).alias("f")).collect()
    assert [{x.term: x.tf for x in r.f} for r in got] == [{}, {"a": 1}, {"a": 1, "b": 2}, {"x": 1000}]


def test_large_index_reads_few_groups(spark, tmp_path):
    rare = F.when(F.col("id").isin(17, 4018), " rare rare")
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws("", F.lit("common words here "), F.repeat(F.lit("common "), (F.col("id") % 3).cast("int")), rare).alias("text"), F.lit("s").alias("source"))
    path = f"{tmp_path}/ix"
    index.write_index(df, path, group_docs=64)
    found = index.open_index(spark, path)
    groups = found.of_terms(["common"])
    assert groups.count() > 60 and groups.agg(F.max(F.size("docs"))).first()[0] < 300
    plan = groups.select("docs")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "concat_ws" in pruned and "bucket" in pruned and "EqualTo(term,common)" in plan
    assert len({f.rsplit("/", 1)[0] for (f,) in groups.select(F.input_file_name()).distinct().collect()}) == 1
    same(index.search(found, "rare common", top=2, first=2).collect(), retrieval.bm25(df, "rare common", "doc_id", top=2).collect())
    with pytest.raises(ValueError):
        index.write_index(df.limit(5).withColumn("source", F.lit("t")), path, buckets=3)
        index.open_index(spark, path)


def test_texts_are_cut_into_terms_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cut = df.select(index.tokenize(F.col("text")).alias("t"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    kept = []
    monkeypatch.setattr(index, "written", lambda rows, label: kept.append((label, rows.columns)) or written(rows, label))
    index.write_index(df, f"{tmp_path}/ix")
    assert kept == [("terms", ["source", "doc", "len", "terms"]), ("sources", ["source", "n_docs", "tokens", "groups"])]
