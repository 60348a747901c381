from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerlens.operators import layout, notes, reports
from ledgerlens.operators import valuation as v
from ledgerlens.plans.fixture_queries import MULTIPLES, PLANS, RESULTS, ROUNDS


def test_results_of_all_methods(spark):
    plans = PLANS.base.frame(spark).withColumn("entity", F.concat(F.lit("e"), "id"))
    found = reports.appraise(plans, MULTIPLES.base.frame(spark).withColumn("entity", F.lit("e1")).where("id < 3"), ROUNDS.base.frame(spark).drop("pre_money").withColumn("entity", F.lit("e2")))
    assert found.columns == reports.RESULT
    rows = found.collect()
    first = next(r for r in rows if r.entity == "e1" and r.method == "dcf")
    assert first.low < first.mid < first.high and first.trace[0].label == "pv_flows" and first.assumptions[0].confidence == "low"
    assert next(r for r in rows if r.entity == "e3").notes == ["growth not below the rate"]
    weak = {r.entity: (r.weak, r.gaps) for r in reports.low_confidence(found).collect()}
    assert "wacc" in weak["e1"][0] and weak["e3"][1] == ["net_debt"]
    lines = reports.report_lines(found).collect()
    assert len(lines) == len(rows) and lines[0].line.startswith("dcf  ")
    doc = {r.entity: json.loads(r.json) for r in reports.football_json(v.bands(RESULTS.base.frame(spark))).collect()}
    assert [b["method"] for b in doc["a"]["bands"]] == ["dcf", "multiples", "reverse"]


def test_template_heads_groups(spark):
    q = spark.createDataFrame([(1, "a", "x", "1"), (2, "a", "y", None), (3, "b", "z", None)], "seq int, group string, key string, hint string")
    got = [r.line for r in reports.template_lines(q).orderBy("seq", F.desc(F.col("line").startswith("["))).collect()]
    assert got == ["[a]", "x =   # 1", "y = ", "[b]", "z = "]


def test_cover(spark):
    pages = spark.createDataFrame([("d", 1, "招股说明书\n某某科技集团\n某某科技股份有限公司2023年\n股票代码：600001"), ("d", 3, "别的有限公司"), ("e", 1, None)], "doc string, page int, text string")
    got = {r.doc: (r.company, r.code) for r in notes.cover_facts(pages, "doc").collect()}
    assert got == {"d": ("某某科技股份有限公司", "600001"), "e": (None, None)}


def test_two_tables_side_by_side(spark):
    cells = [("p", x, t) for x, t in ((0.05, "cash"), (0.05, "debt"), (0.2, "1"), (0.55, "equity"), (0.55, "tax"), (0.7, "2"))] + [("q", 0.05, "cash"), ("q", 0.5, "1"), ("q", 0.6, "2")]
    df = spark.createDataFrame(cells, "page string, x double, text string")
    cuts = layout.side_cut(df, ["page"])
    assert {r.page: r.cut for r in cuts.collect()} == {"p": 0.55, "q": None}
    assert {(r.text, r.side) for r in layout.split_sides(df, cuts, ["page"]).where("page = 'p'").collect()} == {("cash", 0), ("debt", 0), ("1", 0), ("equity", 1), ("tax", 1), ("2", 1)}


def test_pages_of_each_statement(spark):
    s = spark.createDataFrame([("d", 1, 0, 0), ("d", 2, 200, 0), ("d", 3, 100, 50), ("d", 4, 100, 300), ("d", 5, 0, 100), ("d", 6, 0, 0), ("d", 7, 0, 90)], "doc string, page int, balance int, income int")
    got = sorted((r.kind, r.page) for r in layout.pick_pages(s, "doc", "page", ["balance", "income"]).collect())
    assert got == [("balance", 2), ("balance", 3), ("income", 4), ("income", 5)]
