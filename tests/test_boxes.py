"""Statement rows from word boxes."""

from __future__ import annotations

from ledgerlens.operators import boxes, labels

LEFT = ["货币资金", "应收账款", "存货", "资产总计"]
RIGHT = ["应付账款", "预收款项", "股东权益", "负债合计"]
SCHEMA = "doc string, page int, x0 double, top double, bottom double, seq int, text string"


def page(doc, number, *rows):
    """rows: lists of (x, text)."""
    return [(doc, number, x, 100.0 + 20 * y, 108.0 + 20 * y, s, t) for y, row in enumerate(rows) for s, (x, t) in enumerate(row)]


def two_sided(left, right, doc="d"):
    return page(doc, 1, *([(0.08, a), (0.26, f"{k + 1},000.00"), (0.36, f"{k + 5},000.00"), (0.52, b), (0.72, f"{k + 11},000.00"), (0.84, "—")] for k, (a, b) in enumerate(zip(left, right, strict=True))))


def rows(spark, words):
    got = boxes.table_rows(spark.createDataFrame(words, SCHEMA), ["doc", "page"]).orderBy("doc", "page", "side", "line").collect()
    return [(r.side, r.label, r.note, r.current, r.prior) for r in got]


def test_two_sides_and_their_guard(spark):
    got = rows(spark, two_sided(LEFT, RIGHT))
    assert got == [(0, a, "", f"{k + 1},000.00", f"{k + 5},000.00") for k, a in enumerate(LEFT)] + [(1, b, "", f"{k + 11},000.00", "—") for k, b in enumerate(RIGHT)]
    income = rows(spark, two_sided(["营业收入", "营业成本", "销售费用", "净利润"], ["甲", "乙", "丙", "丁"]))
    assert {r[0] for r in income} == {0} and len(income) == 4  # words of no balance sheet: not cut


def test_notes_totals_and_doubtful_amounts(spark):
    words = page("d", 1, [(0.1, "项目"), (0.45, "1"), (0.6, "1,000.00"), (0.8, "900.00")], [(0.1, "存货"), (0.45, "2"), (0.6, "334.719.50"), (0.8, "12.34.5")], [(0.21, "资产总计"), (0.45, "3"), (0.6, "5.00"), (0.8, "-")], [(0.6, "7.00")], [(0.1, "标题")])
    assert rows(spark, words) == [(0, "项目", "1", "1,000.00", "900.00"), (0, "存货", "2", "334719.50", "？12.34.5"), (0, "资产总计", "3", "5.00", "-"), (0, None, "", "", "7.00"), (0, "标题", "", "", "")]
    assert rows(spark, page("d", 1, [(0.1, "只有")], [(0.1, "文字"), (0.3, " ")])) == [] and rows(spark, []) == []


def test_the_reading_that_maps_most_rows_counts(spark):
    flow = page("f", 1, [(0.1, "货币资金 5 1,000.00 900.00 存货 20 10 应付账款 7 6")])
    df = spark.createDataFrame(two_sided(LEFT, RIGHT) + flow, SCHEMA)
    got = {(r.doc, r.way, r.field): (r.value, r.prior) for r in boxes.read_statements(df, "doc", "page", labels.default_rules(spark)).collect() if r.field}
    assert got[("d", "boxes", "cash")] == (1000.0, 5000.0) and got[("d", "boxes", "accounts_payable")] == (11000.0, None)
    assert got[("f", "flow", "cash")] == (1000.0, 900.0) and got[("f", "flow", "accounts_payable")] == (7.0, 6.0)
    assert {k[1] for k in got if k[0] == "d"} == {"boxes"}
