"""Labels by rules, and what speaks for and against a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import labels, loading

CASES = [
    ("一、营业收入（附注12）", None, "revenue", "name"),
    ("營業收入", None, "revenue", "name"),
    ("Property, plant and equipment 物業、廠房及設備", None, "fixed_assets", "name"),
    ("期末现金及现金等价物余额", "us-gaap:Assets", "cash_end", "period"),
    ("Cash and cash equivalents at beginning of period", None, "cash_begin", "period"),
    ("beginning balance", None, None, None),
    ("固定资产折旧、油气资产折耗", None, "depreciation_amortization", "contains"),
    ("累计折旧及摊销", None, None, None),
    ("Accum. Depreciation - Furnitur", None, "accumulated_depreciation", "prefix"),
    ("anything", "us-gaap:Assets", "total_assets", "tag"),
    ("Cash generated from operations 45(a)", None, "cfo", "name"),
    ("31 December 2020", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_stages_of_labels(spark):
    df = spark.createDataFrame([(*c[:2], "mine") for c in CASES * 2], "label string, tag string, _label string").withColumn("field", F.lit("clash"))
    got = labels.identify(df, labels.default_rules(spark), tag="tag").collect()
    assert {(r.label, r.tag): (r.field, r.via) for r in got} == {c[:2]: c[2:] for c in CASES} and len(got) == 2 * len(CASES)
    assert {r._label for r in got} == {"mine"}
    assert labels.identify(df.limit(0), labels.default_rules(spark)).count() == 0


def test_rules_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_BROADCAST_ROWS", 0)
    rules = [("name", "Total Widgets", [], "widgets", 1), ("name", "total widgets", [], "later", 2), ("contains", "桂", ["丹"], "laurel", 3), ("contains", "widg", ["no"], "some", 4), ("prefix", "ab", [], "two", 5), ("prefix", "abc", [], "three", 6)]
    rules = labels.comparable(spark.createDataFrame(rules, labels.RULES))
    rows = spark.createDataFrame([("total widgets",), ("月桂",), ("丹桂",), ("my widgets",), ("no widgets",), ("abcd",), ("x",)], "label string")
    got = {r.label: r.field for r in labels.identify(rows, rules).collect()}
    assert got == {"total widgets": "widgets", "月桂": "laurel", "丹桂": None, "my widgets": "some", "no widgets": None, "abcd": "two", "x": None}
    assert all(r.field is None for r in labels.identify(rows, rules.limit(0)).collect())


def test_simplified_forms(spark):
    words = {"長期借款": "长期借款", "無形資產": "无形资产", "預付款項": "预付款项", "遞延所得稅資產": "递延所得税资产", "虧損": "亏损", "儲備": "储备", "應攤銷": "应摊销"}
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.simplified(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == words
    own = spark.createDataFrame([("鬱金",)], "t string").select(text.simplified(F.col("t"), {"鬱": "郁"}).alias("s"))
    assert own.first().s == "郁金"


BODY = " 保险服务收入 营业收入 营业利润 利润总额 净利润 所得税费用 分部信息 分部间 赔付支出 "


def scores(spark, *pages):
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(pages)], "k int, text string, rows int").withColumn("_cost", F.lit("clash"))
    return [(r.balance, r.income, r.cash_flow) for r in loading.page_evidence(df).orderBy("k").collect()]


def test_what_speaks_against_a_page(spark):
    got = scores(spark, ("合并利润表" + BODY, 30), ("四、分部报告（续）" + BODY, 30), ("合并利润表" + "填" * 260 + "分部报告" + BODY, 30), ("变动原因" + BODY, 30), ("x" * 300 + "变动原因" + BODY, 30), ("母公司利润表" + BODY, 30), (BODY, 1), (None, 9))
    plain = got[0][1]
    assert [g[1] - plain for g in got[:6]] == [0, -80, 0, -100, 0, -60] and got[6:] == [(0, 0, 0), (0, 0, 0)]


def test_each_detail_line_counts(spark):
    page = "资产总计 负债合计 流动资产合计 "
    lines = loading.DETAIL_LINES["balance"]
    got = scores(spark, (page, 5), (page + "预付款项", 5), (page + " ".join(lines), 5), ("segment results " + page, 5))
    assert got[1][0] - got[0][0] == 25 and got[2][0] - got[0][0] >= 25 * len(lines) and got[3][0] == got[0][0] - 80
    few = scores(spark, ("变动原因 分部报告 母公司资产负债表 资产总计 流动资产合计", 2))[0][0]
    assert few == 202 - 240  # may fall below 0
