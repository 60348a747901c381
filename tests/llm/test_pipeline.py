"""Each stage against a plain version of it on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlens.llm import quality_rules  # noqa: E402


def test_stages_do_their_work(spark, small):
    from test_ngram_join import brute
    from test_text_operators import brute_hits, brute_stats

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, small), name)
        assert out.columns == columns
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
        assert after.items() <= before.items() and out.count() == len(after)
        labels = spark.read.parquet(f"{small}/labels.parquet")
        if name == "quality_rules":
            rules = quality_rules.fit(docs, labels)
            ok = {r.doc_id for r in quality_rules.judge(docs, rules).where("rule = 0").collect()}
            want = {d for d, t in before.items() if d in ok and (s := brute_stats(t))[0] >= 10 and 100 * s[4] <= 20 * s[0]}
        elif name == "quality_classifier":
            bad = {r.doc_id for r in labels.where("quality = 0").collect()} & set(before)
            good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(before)
            assert not bad & set(after) and len(good - set(after)) <= max(1, len(good) // 100)
            want = set(after)  # the verdicts are tested by test_bad_documents_go
        elif name == "near_duplicates":
            want = {d for d, n, c in brute(sorted(before.items())) if n == 0 or d == c}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            want = {d for d, t in before.items() if brute_hits(t, items)[1] == 0}
        assert set(after) == want, name
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "packing"]
    assert pipeline.run(spark, small).count() == len(packed)


def test_columns_named_like_an_operators_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = ["n_words", "rule", "kept", "base_failed", "score", "p_text", "spans", "n_hit", "item_ids", "key", "rid", "_own_kept"]
    docs = docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in own))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 20 and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in own), name


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, text + " more")], "doc_id long, text string")
    kept = pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or -1 for r in kept)) == [-1, 1, 3, 4]


def test_repeated_ids_lose_only_copies(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcd"}
    rows = [
        (1, text["a"]), (2, text["a"] + " more"), (2, text["b"]),  # 2: a copy of 1, and a text without any
        (3, text["c"]), (3, text["c"] + " more"), (3, text["c"].upper()),  # one id, one component
        (4, text["d"]), (4, text["b"] + " more"), (5, ""), (5, text["a"]), (6, "lone words"), (6, "other words"),
    ]
    kept = [tuple(r) for r in pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    third = [t for d, t in kept if d == 3]
    assert len(third) == 1 and third[0] in {t for d, t in rows if d == 3}
    assert sorted(x for x in kept if x[0] != 3) == [(1, text["a"]), (2, text["b"]), (4, text["d"]), (5, ""), (6, "lone words"), (6, "other words")]


def test_bad_documents_go(spark):
    """The second stage rejects bad labelled documents that its input has, also where the first has taken most of them."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    bad, good = labels.where("quality = 0").select("doc_id"), labels.where("quality = 1").select("doc_id")
    few = bad.orderBy("doc_id").limit(40)
    given = docs.join(bad, "doc_id", "left_anti").unionByName(docs.join(few, "doc_id"))
    kept = pipeline.by_classifier(spark, given, sf).select("doc_id").cache()
    assert kept.join(few, "doc_id").count() <= 12
    n, stay = docs.join(good, "doc_id").count(), kept.join(good, "doc_id").count()
    assert stay >= 0.99 * n
