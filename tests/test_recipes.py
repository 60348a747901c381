from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import derived, notes, recipes
from ledgerlens.sources import documents


def test_statement_figures(spark):
    rows = spark.createDataFrame([(1, "revenue", 100.0, 0), (1, "revenue", 999.0, 5), (1, "cash", 10.0, 1), (1, "short_term_debt", 5.0, 2), (2, "cash", 7.0, 3), (2, "total_liabilities", 30.0, 4), (2, "accounts_payable", 30.0, 6), (3, "cash", 1.0, 7), (3, "total_liabilities", 90.0, 8)], "doc int, field string, value double, seq int")
    wide = derived.pivot_fields(rows, "doc", ["revenue", "cash", "short_term_debt", "long_term_debt", "total_liabilities", "accounts_payable"])
    got = {r.doc: r for r in derived.statement_net_debt(wide).collect()}
    assert got[1].revenue == 100.0
    assert (got[1].net_debt, got[1].net_debt_missing) == (None, ["long_term_debt"])
    assert (got[2].net_debt, got[2].net_debt_note) == (-7.0, "other liabilities make up all: debt is 0")
    assert got[3].net_debt is None
    full = derived.statement_net_debt(spark.sql("SELECT 5D AS short_term_debt, 20D AS long_term_debt, 10D AS cash")).first()
    assert (full.net_debt, full.net_debt_missing) == (15.0, None)


def test_history_and_doubts(spark):
    d = spark.sql("SELECT 100D AS revenue, 20D AS operating_income, 5D AS da, -8D AS capex, 30D AS accounts_receivable, 10D AS accounts_payable, CAST(NULL AS DOUBLE) AS inventory, 25D AS total_current_assets, 0.4D AS income_rate")
    r = derived.minority_interest(derived.ebitda(derived.missing_key_fields(derived.history_notes(derived.history(d))))).first()
    assert (r.ebitda_margin, r.da_share, r.capex_share, r.nwc_share, r.ebitda) == (0.25, 0.05, 0.08, 0.2, 25.0)
    assert r.notes == ["working capital without inventory", "receivables above current assets"]
    assert (r.missing_keys, r.unusable, r.minority, r.minority_defaulted) == (["cfo"], True, 0.0, True)
    da = spark.sql("SELECT array(1D, NULL, 2D) AS l").select(derived.total_da(F.lit(0.0), F.lit(None).cast("double"), F.col("l")).alias("x"))
    assert da.first().x == 3.0


def test_reasons_candidates_and_prefill(spark):
    rows = spark.createDataFrame([(1, "income", "da", None), (1, "income", "x", 1.0), (2, "balance", "cash", 2.0)], "doc int, stmt string, field string, value double")
    got = {(r.doc, r.reason) for r in derived.history_reasons(rows, "doc", {"da_share": ["income", "da"]}).collect()}
    assert got == {(1, "no value"), (2, "no table")}
    files = spark.createDataFrame([("a", "pdf", 9, 0.5, 2), ("b", "pdf", 12, 0.4, 3), ("c", "pdf", 99, 1.0, 1), ("d", "html", 7, 1.0, 3)], "path string, kind string, mapped int, rate double, statements int")
    assert [r.path for r in derived.best_candidates(files).collect()] == ["b"]
    p = derived.prefill(spark.sql("SELECT 12D AS a, 10D AS b UNION ALL SELECT 1D, -1D"), "a", "b", "g").collect()
    assert [round(r.g, 6) if r.g is not None else None for r in p] == [0.2, None]
    c, f = spark.createDataFrame([(1, None, 2.0)], "id int, x double, y double"), spark.createDataFrame([(1, 5.0, 9.0)], "id int, x double, y double")
    r = derived.fill_absent(c, f, "id", ["x", "y"]).first()
    assert (r.x, r.x_source, r.y, r.y_source) == (5.0, "statements", 2.0, "given")
    o = derived.operating_income_check(spark.sql("SELECT 1000D AS revenue, 100D AS operating_income, 104D AS derived_operating_income"))
    assert o.first().operating_income_agrees


RECON = "现金流量表补充资料 净利润 100.00 固定资产折旧 30 无形资产摊销 5 存货的减少 －10 经营活动产生的现金流量净额 125"


def test_amounts_in_text(spark):
    def after(text, label):
        r = spark.createDataFrame([(text,)], "t string").select(notes.amount_after(F.col("t"), F.lit(label)).alias("a")).first().a
        return r and tuple(r)

    assert after("折旧 (1,234.5) x", "折旧") == (-1234.5, 3) and after("摊销 —5", "摊销") == (-5.0, 3) and after("折旧" + " " * 48 + "7", "折旧") is None
    assert after("x", "摊销") is None and after(None, "a") is None and after("摊销 无", "摊销") is None
    page = spark.createDataFrame([(RECON,), ("nothing",), (None,), ("固定资产折旧、投资性房地产折旧 22.6",)], "t string")
    got = page.select(notes.depreciation(F.col("t")).alias("d"), notes.reconcile(F.col("t")).alias("r")).collect()
    assert got[0].d == {"固定资产折旧": 30.0, "无形资产摊销": 5.0} and got[0].r.asDict() == {"net_income": 100.0, "cfo": 125.0, "items": 3, "diff": 0.0, "ok": True}
    assert got[1].r is None and got[2].r is None and got[3].d == {"固定资产折旧": 22.6}  # two labels, one figure
    profile = "发行概况 发行股数 的比例 本次发行股数 不超过 2,500 万股 每股面值 1.00 元 每股发行价格 【】元 " + "填" * 90 + " 发行后总股本 10,000万股"
    s = spark.createDataFrame([(profile,)], "t string").select(notes.share_structure(F.col("t")).alias("s")).first().s
    assert (s["issued"], s["after"], s["before"], s["par"], s["price"], s["inferred"]) == (25e6, 1e8, 75e6, 1.0, None, "before")
    pages = spark.createDataFrame([(1, 1, RECON), (1, 2, "净利润 调节 续"), (1, 3, "其他"), (1, 4, "调节"), (2, 1, None)], "doc int, page int, text string")
    assert [r.page for r in notes.reconciliation_pages(pages, "doc", "page").orderBy("page").collect()] == [1, 2]
    assert notes.profile_pages(spark.createDataFrame([(profile,), ("x",)], "text string")).count() == 1
    toc = spark.createDataFrame([("d", "balance", 10), ("d", "income", 14)], "doc string, kind string, page int")
    assert [(r.first, r.last) for r in notes.statement_ranges(toc, "doc").orderBy("first").collect()] == [(10, 13), (14, None)]


def test_many_labels_in_many_pages(spark):
    """Each page is read once, not once for each pair of labels."""
    from time import time

    odd = spark.createDataFrame([("无形资产摊销、固定资产折旧 (7) 存货的减少9",), (None,), ("",), ("财务费用" + "x" * 47 + "12",)], "t string")
    got = [[tuple(x) for x in r.a] for r in odd.select(notes.reconciling_lines(F.col("t")).alias("a")).collect()]
    assert got == [[("固定资产折旧", -7.0, 15), ("存货的减少", 9.0, 24)], [], [], [("财务费用", 1.0, 52)]]
    pages = spark.range(6000).select(F.concat(F.lit(RECON), F.lit(" ".join(f"{x} 1,{k}00.5" for k, x in enumerate([*notes.DA_LINES[1:], *notes.OTHER_LINES]))), F.col("id").cast("string")).alias("t"))
    begun = time()
    assert pages.where(notes.reconcile(F.col("t"))["items"] == 17).count() == 6000
    assert time() - begun < 15


def test_share_structure_reads_its_page_once(spark):
    df = spark.createDataFrame([("发行股数 5 股 发行股数 9 股 发行前总股本 7 万股",), (None,), ("发行股数的 3 股",)], "t string").select(notes.share_structure(F.col("t")).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [(r.s.issued, r.s.after, r.s.before, r.s.inferred) for r in df.collect()] == [(5.0, 10.0, 5.0, "after"), (None, None, None, None), (None, None, None, None)]


def test_text_flow_rows_read_each_page_once(spark):
    df = spark.createDataFrame([(1, "货币资金 1 2 " * 8), (2, None), (3, "存货 3"), (4, "无")], "k int, t string")
    rows = notes.text_flow_rows(df, "t", notes.account_names())
    assert rows.columns == ["k", "row_no", "label", "note", "current", "prior", "flows"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(coalesce(") == 1
    got = [tuple(r) for r in rows.orderBy("k", "row_no").collect()]
    assert got == [(1, n, "货币资金", "", "1", "2", True) for n in range(8)] + [(3, 0, "存货", "", "3", "", False)]


def test_text_flow(spark):
    names = notes.account_names()
    flow = ["项目 货币资金 5 1,000.00 900.00 存货 20 10", "货币资金 1", " ".join(f"存货 {i}" for i in range(9)), None, "", "存货(12.5)—", "应收账款存货 - 7 x 固定资产", "存货 500 1 2 3 4 5 6 7", "存货 18 1 2", "表-货币资金 3"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(flow)], "k int, t string")
    got = {r.k: ([tuple(x) for x in r.rows], r.flows) for r in df.select("k", notes.text_flow(F.col("t"), names).alias("rows"), notes.is_text_flow(F.col("t"), names).alias("flows")).collect()}
    assert got[0] == ([("货币资金", "5", "1,000.00", "900.00"), ("存货", "", "20", "10")], False)
    assert got[2] == ([("存货", "", str(i), "") for i in range(9)], True) and not got[1][1]
    assert got[3] == got[4] == ([], False) and got[5][0] == [("存货", "", "(12.5)", "—")]
    assert got[6][0] == [("存货", "", "-", "7"), ("应收账款", "", "", "")] and got[7][0] == [("存货", "", "500", "1")]
    assert got[8][0] == [("存货", "18", "1", "2")] and got[9][0] == [("货币资金", "", "3", "")]
    runs = spark.createDataFrame([("合并货币资金存货",), ("归属于母公司股东的净利润",), ("无",)], "t string").select(notes.known_names(F.col("t"), names).alias("n")).collect()
    assert [r.n for r in runs] == [["存货", "货币资金"], ["归属于母公司股东的净利润"], []]


def test_ask_and_verify(spark):
    chunks = spark.createDataFrame([("S1", "净利润 grew"), ("S2", "net income fell"), ("S3", "weather")], "chunk_id string, text string")
    assert {r.chunk_id for r in recipes.ask(chunks, "净利润").collect()} == {"S1", "S2"}
    a = spark.createDataFrame([("see [S1]",), ("see [S9]",), (None,)], "text string")
    assert [r.sound for r in recipes.verify_answers(a, ["S1", "S2"]).collect()] == [True, False, True]


def test_advice_and_screening(spark):
    a = spark.createDataFrame([("revenue growth", "g", 0.3), ("capex ratio", "c", 0.1)], "name string, metric string, value double")
    p = spark.createDataFrame([("g", 0.1), ("g", 0.2), ("g", 0.4)], "metric string, value double")
    got = {r.name: r for r in recipes.advise(a, p).collect()}
    assert got["revenue growth"].share_at_or_below == pytest.approx(2 / 3) and got["revenue growth"].evidence_wanted == "signed orders and backlog"
    assert got["capex ratio"].n is None
    t = spark.createDataFrame([(1, "SaaS software subscription for 物流"), (2, None)], "id int, text string")
    assert [(r.industry, r.rank) for r in recipes.propose_industries(t, "id").orderBy("rank").collect()] == [("software", 1), ("logistics", 2)]
    c = spark.createDataFrame([("software", "US", True)], "industry string, geography string, listed_only boolean")
    assert recipes.screening_queries(c, ["Acme", "x"]).first().query == "software US 上市公司 可比公司"
    with pytest.raises(Exception, match="blocked company"):
        recipes.screening_queries(c.withColumn("geography", F.lit("ACME land")), ["Acme"]).collect()


def test_questions_and_utterances(spark):
    q = spark.createDataFrame([("tax", 1), ("wacc", 2), ("x", 3), ("growth", 4)], "key string, seq int")
    done = spark.createDataFrame([("tax",)], "key string")
    assert [r.key for r in recipes.question_plan(q, done, ["growth", "wacc"]).collect()] == ["growth", "wacc", "x"]
    u = spark.createDataFrame([("set growth to 8.5%",), ("hello",)], "t string").select(recipes.propose_field(F.col("t"), {"growth": "g", "margin": "m"}).alias("p")).collect()
    assert (u[0].p.value, u[0].p.is_percent, u[0].p.candidates) == (8.5, True, ["g"]) and u[1].p.candidates == [] and u[1].p.value is None
    assert recipes.evidence_library(spark).count() == len(recipes.EVIDENCE)
    runs = spark.createDataFrame([("m", 1, 3, 5), ("m", 2, 2, 5), ("n", 1, 4, 5)], "model string, at int, passed int, total int")
    assert [r.passed for r in recipes.last_per_model(runs, ["model"], "at").orderBy("model").collect()] == [2, 4]
    assert [r.model for r in recipes.worst_round(runs, ["model"]).collect()] == ["n", "m"]


def test_unreadable_documents_are_gaps(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(b"x")), ("b.pdf", bytearray(b"y"))], "path string, content binary")
    assert all(r.gap and r.value is None for r in documents.read_workbooks(files).collect())
    assert all(r.gap and r.text is None for r in documents.read_pdf_pages(files).collect())
    pages = spark.createDataFrame([("d", 1, " "), ("d", 2, "t"), ("e", 1, "")], "doc string, page int, text string")
    ocr = spark.createDataFrame([("d", 1, "read"), ("e", 1, "all")], "doc string, page int, text string")
    filled = documents.fill_blank_pages(pages, ocr, ["doc", "page"])
    assert {(r.doc, r.page): r.text for r in filled.collect()} == {("d", 1): "read", ("d", 2): "t", ("e", 1): "all"}
    assert {r.doc: r.scanned for r in documents.scan_advisory(filled, "doc").collect()} == {"d": False, "e": True}
    cells = spark.createDataFrame([("p", "合并", 0, 0, "项目"), ("p", "合并", 0, 1, "2023-12-31"), ("p", "合并", 1, 0, "资产总计"), ("p", "合并", 2, 0, "负债合计"), ("p", "x", 0, 0, "n")], "path string, sheet string, r int, c int, value string")
    assert [(r.sheet, r.stmt, r.hits) for r in documents.classify_sheets(cells).collect()] == [("合并", "balance", 2)]
    mapped = cells.withColumn("field", F.when(F.col("value").rlike("计"), F.lit("f")))
    assert {r.sheet: r.score for r in documents.sheet_scores(cells, mapped).collect()} == {"合并": 702, "x": 0}
