from __future__ import annotations

import random
import re
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import asof, audit, checks, facts, layout, overlap, peers, retrieval, statements, valuation


def plain_chunks(paras, target, overlap):
    """What the rule says, from the end of each chunk to the next."""
    ends = {}
    for f in range(len(paras)):
        ends[f] = next((e for e in range(f + 1, len(paras) + 1) if sum(map(len, paras[f:e])) >= target), len(paras))
    out, f = [], 0
    while f < len(paras):
        out.append((f + 1, ends[f], "\n".join(paras[f : ends[f]])))
        again = ends[f] - overlap  # what is repeated must leave something new
        f = ends[f] if again <= f else again
    return out


def test_chunks_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " \n\n ", "a" * 900 + "\n\nb", "x\u3000\n \n\u00a0y", *("\n\n".join("p" * rng.choice([3, 60, 200, 419, 420, 900]) for _ in range(rng.randint(1, 25))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for overlap in (0, 1, 3):
        got = {}
        for r in retrieval.chunk_documents(docs, "k", overlap=overlap).orderBy("k", "chunk_no").collect():
            got.setdefault(r.k, []).append((r.para_start, r.para_end, r.text))
        for k, t in enumerate(texts):
            paras = [p for p in (x.strip() for x in re.split(r"\n\s*\n", t or "")) if p]
            assert got.get(k, []) == plain_chunks(paras, 420, overlap), (k, overlap)


def test_query_expansion_takes_longest_forms(spark):
    terms = {"营运资金": ["working capital"], "资金": ["funds"], "净利润": ["net income"]}
    assert retrieval.query_terms(spark, "营运资金变动", terms)["working"] == 1
    assert retrieval.query_terms(spark, "a a b")["a"] == 2


def test_bm25_weighs_repeated_query_terms(spark):
    d = spark.createDataFrame([(1, "x y"), (2, "x z"), (3, None), (4, "")], "id int, text string")
    one, two = (retrieval.bm25(d, q, "id").collect() for q in ("y", "y y"))
    assert [r.id for r in one] == [1] and two[0].score == pytest.approx(2 * one[0].score)
    assert retrieval.bm25(d, "absent", "id").count() == 0


def test_overlap_reports_the_longest_run(spark):
    v = spark.createDataFrame([(1, "Alpha Beta, GAMMA!"), (2, "short"), (3, "nothing here at all")], "v int, value string")
    c = spark.createDataFrame([(10, "xx alphabetagamma yy alphabet")], "c int, text string")
    got = overlap.longest_overlaps(v, c, "v", "c")
    assert [tuple(r) for r in got.collect()] == [(1, 10, 0, 14)]
    allowed = overlap.outgoing_decision(v, got, ["here"], "v").orderBy("v").collect()
    assert [(r.allowed, r.reason) for r in allowed] == [(False, "corpus overlap"), (True, None), (False, "blocked term")]
    ok = spark.createDataFrame([("a",), ("x" * 65,), ("a\nb",), ("file:x",)], "t string").select(overlap.valid_parameter(F.col("t")).alias("k"))
    assert [r.k for r in ok.collect()] == [True, False, False, False]


def test_registered_overlaps_start_at_eight_characters(spark, tmp_path, monkeypatch):
    from ledgerlens.plans import registry

    items = [(1, "Net margin, 2024!"), (2, "abcdefg"), (3, None), (4, "the long run of a shared passage")]
    docs = [(10, "x NETmargin y"), (11, "abcdefg abcdefg"), (12, "a shared-passage; the long run of"), (13, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    form = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = set()
    for i, a in items:
        for d, b in docs:
            a, b = form(a), form(b)
            runs = [(n, -k) for k in range(len(a)) for n in range(8, len(a) - k + 1) if a[k : k + n] in b]
            want |= {(i, d, -max(runs)[1], max(runs)[0])} if runs else set()
    for bound in (overlap.MAX_BROADCAST_CHARS, 0):
        monkeypatch.setattr(overlap, "MAX_BROADCAST_CHARS", bound)
        assert {tuple(r) for r in registry.QUERIES["overlap_scan"](spark, str(tmp_path)).collect()} == want
    assert {n for _, _, _, n in want} == {9, 14}


def test_asof_keeps_rows_and_bounds_age(spark):
    left = spark.createDataFrame([("a", 10), ("a", 10), ("a", 99), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 9, 1.0), ("a", 10, 2.0), ("a", 11, 3.0)], "k string, r int, v double")
    got = asof.asof_backward(left, right, ["k"], "t", "r", ["v"], F.lit(20)).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.v) for r in got] == [("a", 10, 2.0), ("a", 10, 2.0), ("a", 99, None), ("b", 5, None)]


def test_sliced_asof_gives_the_same(spark):
    import random

    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randrange(300), i) for i in range(200)], "k string, t int, id int")
    right = spark.createDataFrame([(rng.choice("abc"), rng.randrange(300), float(i), i) for i in range(60)], "k string, r int, v double, q int")
    plain = asof.asof_backward(left, right, ["k"], "t", "r", ["v"], F.lit(40), "q")
    sliced = asof.asof_backward(left, right, ["k"], "t", "r", ["v"], F.lit(40), "q", lambda x: F.floor(x / 7))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(plain) == rows(sliced) and len(rows(plain)) == 200


def test_restatement_after_the_date_stays_out(spark):
    f = spark.createDataFrame([("1", "2020", 1.0, "2021", 0), ("1", "2020", 2.0, "2023", 1)], "k string, end string, val double, filed string, seq int")
    as_filed = facts.disclosed_by(f, ["k"], F.lit("2022")).first().val
    latest = facts.disclosed_by(f, ["k"], F.lit("2022"), value_as_filed=False).first().val
    assert (as_filed, latest) == (1.0, 2.0)


def test_concepts_in_one_pass(spark):
    f = spark.createDataFrame([("1", "LongTermDebtCurrent", 5.0), ("1", "ShortTermBorrowings", 7.0), ("1", "MarketableSecuritiesCurrent", 2.0), ("1", "CashAndCashEquivalentsAtCarryingValue", 1.0)], "k string, tag string, val double")
    r = facts.net_debt(facts.pivot_concepts(f, ["k"], facts.NET_DEBT_PARTS)).first()
    assert (r.current_debt, r.net_debt, r.gap) == (5.0, 2.0, None)


def test_nearest_instant_prefers_date_then_tag(spark):
    f = spark.createDataFrame([("1", "B", None, "2020-06-30", 2.0, "2020-07-01", 0), ("1", "A", None, "2020-06-30", 1.0, "2020-08-01", 1), ("1", "A", None, "2021-06-30", 9.0, "2021-08-01", 2)], "k string, tag string, start string, end string, val double, filed string, seq int")
    f = f.withColumn("end", F.to_date("end"))
    r = facts.nearest_instant(f, ["k"], ["A", "B"], F.lit("2021-01-01").cast("date")).first()
    assert (str(r.end), r.val, r.tag_used) == ("2020-06-30", 1.0, "A")


def test_too_few_peers_are_flagged(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 10.0), ("b", None)], "m string, x double")
    got = {r.m: r for r in peers.distribution(p, ["m"], "x").collect()}
    assert not got["a"].enough and got["a"].n == 2
    assert (got["b"].p25, got["b"].median, got["b"].p75) == (1.75, 3.0, 5.5)


def test_percentile_rank_without_peers_is_null(spark):
    t = spark.createDataFrame([(1, "a", 2.0), (2, "z", 2.0)], "id int, m string, v double")
    p = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "m string, v double")
    got = {r.id: r.share_at_or_below for r in peers.percentile_rank(t, p, ["m"], "v", "v", "id").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[2] is None


def test_percent_fields(spark):
    r = spark.sql("SELECT map('roe', 12.0D, 'pe', 15.0D) AS f")
    assert peers.percent_fields(r, "f", ["pe"]).first().f == {"roe": 0.12, "pe": 15.0}


def test_reverse_dcf_agrees_with_bisection(spark):
    from ledgerlens.plans.fixture_queries import PLANS

    plan = PLANS.base.frame(spark).where("id = 1")
    g = valuation.reverse_dcf(plan).first().implied_growth
    again = valuation.dcf(plan.withColumn("growth", F.lit(g))).first().equity_value
    assert again == pytest.approx(2200.0, rel=1e-9)
    assert valuation.dcf(plan, mid_year=True).first().pv_flows > valuation.dcf(plan).first().pv_flows


def test_broken_contracts_raise(spark):
    o = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.4, 2.0)], "id int, probability double, value double")
    with pytest.raises(Exception, match="sum to 1"):
        valuation.first_chicago(o, ["id"]).collect()
    m = spark.createDataFrame([(1.0, 3.0, 2.0, 1.0, 0.0)], "metric double, multiple_low double, multiple_mid double, multiple_high double, net_debt double")
    with pytest.raises(Exception, match="must rise"):
        valuation.by_multiples(m).collect()


def test_unlever_undoes_relever(spark):
    b, d, e, t = (F.lit(x) for x in (1.1, 30.0, 70.0, 0.25))
    assert spark.range(1).select(valuation.unlever(valuation.relever(b, d, e, t), d, e, t).alias("x")).first().x == pytest.approx(1.1)
    assert spark.range(1).select(valuation.size_premium(F.lit(7)).alias("x")).first().x == 0.0168


def test_gap_is_attributed_to_the_first_row(spark):
    rows = spark.createDataFrame([(1, 2, 1, "tax", 101.0), (1, 1, 5, "fees", -100.0), (1, 1, 9, "late", 100.0)], "k int, stmt_order int, row_no int, label string, value double")
    gaps = spark.createDataFrame([(1, 100.0), (2, 7.0)], "k int, gap double")
    got = {r.k: r.explained_by for r in checks.attribute_gap(rows, gaps, "k").collect()}
    assert got == {1: "fees", 2: None}


def test_all_hold_needs_an_applicable_check(spark):
    c = spark.createDataFrame([(1, "holds"), (1, "not_applicable"), (2, "not_applicable"), (3, "holds"), (3, "undecidable")], "k int, status string")
    assert {r.k: r.all_hold for r in checks.all_hold(c, "k").collect()} == {1: True, 2: False, 3: False}


def test_operating_income_follows_the_sign_of_costs(spark):
    r = spark.createDataFrame([(1, "revenue", 100.0), (1, "cost", -60.0), (1, "cost", -10.0), (2, "revenue", 100.0), (2, "cost", 60.0)], "k int, role string, value double")
    assert {x.k: x.operating_income for x in checks.operating_income_signs(r, "k").collect()} == {1: 30.0, 2: 40.0}


def test_mapping_rates_and_ownership(spark):
    rows = spark.createDataFrame([(1, "income", "营业收入"), (1, "income", "货币资金"), (1, "income", "???")], "doc int, stmt string, label string")
    owned = statements.owned_rows(statements.identify(rows)).orderBy("label").collect()
    assert {r.label: r.owned for r in owned} == {"营业收入": True, "货币资金": False, "???": False}
    r = statements.mapping_rates(statements.identify(rows), ["doc"]).first()
    assert (r.mapped, r.rows) == (2, 3)


def test_page_scores_need_two_groups(spark):
    p = spark.createDataFrame([(1, "total assets and total liabilities, cash"), (2, "total assets"), (3, None)], "page int, text string")
    s = statements.page_scores(p, {"balance": [["total assets"], ["total liabilities"], ["cash", "inventory"]]})
    assert {r.page: r.balance for r in s.collect()} == {1: 303, 2: 0, 3: 0}
    assert statements.accounts(spark).count() == len(statements.ACCOUNTS)


def test_anchor_clusters_and_pitch(spark):
    x = spark.sql("SELECT array(0.2D, 0.1D, 0.125D, 0.115D) AS xs").select(layout.column_anchors(F.col("xs")).alias("a")).first().a
    assert x == [0.1, 0.125, 0.2]
    p = spark.createDataFrame([(1, y) for y in (0.0, 10.0, 10.2, 22.0, 40.0)], "page int, y double")
    assert layout.pitch(p, ["page"]).first().pitch == pytest.approx(11.8)


def test_labels_carry_and_columns(spark):
    r = spark.createDataFrame([(1, 1, "a", "5"), (1, 2, None, "6")], "page int, n int, label string, v string")
    assert [x.label for x in layout.carry_labels(r, ["page"], "n").orderBy("n").collect()] == ["a", "a"]
    cells = spark.createDataFrame([("s", 0, "cash"), ("s", 0, "debt"), ("s", 1, "1,000"), ("s", 1, "—")], "sheet string, c int, value string")
    assert [x.c for x in layout.label_columns(cells, ["sheet"]).collect()] == [0]


def test_parameters_flatten(spark):
    r = spark.sql("SELECT 1 AS id, map('q', 'x', 'codes', '[\"a\",\"b\"]') AS params")
    got = {(x.name, x.value) for x in audit.flatten_parameters(r, "id").collect()}
    assert got == {("q", "x"), ("codes[0]", "a"), ("codes[1]", "b")}


def test_statement_pages_score_in_both_languages(spark):
    p = spark.createDataFrame([(1, "资产总计 流动资产合计 货币资金"), (2, "Revenue; profit before tax; income tax"), (3, None)], "page int, text string")
    got = {r.page: (r.balance, r.income, r.cash_flow) for r in statements.statement_scores(p).collect()}
    assert got[1] == (303, 0, 0) and got[2][1] > 300 and got[3] == (0, 0, 0)


def test_page_scores_lower_a_text_once(spark):
    df = statements.page_scores(spark.createDataFrame([("Total Assets inventory",), (None,)], "text string"), {"a": [["total assets"], ["cash", "inventory"]], "b": [["x"], ["total"]]})
    assert df.columns == ["text", "a", "b"] and df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r.a, r.b) for r in df.collect()] == [(202, 0), (0, 0)]
