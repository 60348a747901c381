from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import comps, loading


def test_unknown_metrics_are_named():
    with pytest.raises(ValueError, match="revenue_cagr"):
        comps.metric("cn", "ebitda")
    assert set(comps.METRICS) == {"us", "cn", "hk"} and set(comps.MULTIPLES["us"]) >= {"pe", "ev_ebitda"}


def test_best_reading_and_evidence(spark):
    rows = spark.createDataFrame([("d", "text", "cash", "cash"), ("d", "text", "x", None), ("d", "words", "cash", "cash"), ("d", "words", "debt", "long_term_debt"), ("e", "text", "cash", "cash"), ("e", "words", "cash", "cash")], "doc string, way string, label string, field string")
    got = loading.best_reading(rows, "doc", "way", ["text", "words"]).select("doc", "way").distinct().collect()
    assert {(r.doc, r.way) for r in got} == {("d", "words"), ("e", "text")}
    pages = spark.createDataFrame([("d", 2, "second"), ("d", 1, "first"), ("d", 3, None), ("d", 4, "other")], "doc string, page int, text string")
    picked = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2), ("d", 3)], "doc string, page int")
    assert loading.evidence_text(pages, picked, "doc").first().evidence == "first\nsecond\n"


def test_dense_pages_and_empty_tables(spark):
    cells = spark.createDataFrame([(1, "1,000"), (1, "(5)"), (1, "cash"), (2, "a"), (2, "b"), (2, "3"), (2, None), (2, " ")], "page int, text string")
    assert {r.page: r.dense for r in loading.dense_with_numbers(cells, ["page"]).collect()} == {1: True, 2: False}
    grid = spark.createDataFrame([], "doc int, r int, c int, value string")
    assert loading.statement_rows(grid, ["doc"]).count() == 0 and loading.markdown(grid, ["doc"]).count() == 0
    assert loading.markdown(spark.createDataFrame([(1, 0, 0, "a|b"), (1, 0, 1, None)], "doc int, r int, c int, value string"), ["doc"]).first().markdown == "| a\\|b |  |\n|---|---|"


def test_simplified_and_labels(spark):
    assert spark.sql("SELECT '應收賬款' AS t").select(loading.simplified(F.col("t")).alias("x")).first().x == "应收账款"
    got = spark.createDataFrame([("现金",), ("现金：",), ("cash",), ("1",), (" ",), (None,)], "t string").select(loading.plausible_label(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False, False]
