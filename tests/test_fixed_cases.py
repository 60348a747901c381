"""Single cells, labels and texts with the outcome that each must have."""

from __future__ import annotations

import pytest
from oracle import spark_rows
from pyspark.sql import functions as F

from ledgerlens.functions import identifiers, numbers, text
from ledgerlens.operators import audit, statements
from ledgerlens.plans.fixture import Fixture

AMOUNTS = Fixture("id int, cell string, value double, status string", [(1, "1,234.50", 1234.5, "ok"), (2, "334.719.50", 334719.5, "repaired"), (3, "45.508.51239", None, "suspect"), (4, "—", None, "dash"), (5, "", None, "empty"), (6, "1,234 5,678", None, "suspect"), (7, "(2,000)", -2000.0, "ok"), (8, "1, 234.50", 1234.5, "repaired")])
PERCENTS = Fixture("id int, cell string, value double, shares double", [(1, "8.5%", 0.085, 8.5), (2, "1,200", 1200.0, 1200.0), (3, "x", None, None), (4, "3.5万", None, 35000.0), (5, "2亿", None, 2e8)])
HEADERS = Fixture("id int, cell string, period date", [(1, "2023年12月31日", "2023-12-31"), (2, "2022-06-30", "2022-06-30"), (3, "二〇二一年", "2021-12-31"), (4, "2020年6月", "2020-06-30"), (5, "Note", None), (6, "Year 2019", "2019-12-31")])
LABELS = Fixture(
    "id int, label string, tag string, field string, via string",
    [
        (1, "一、营业收入", None, "revenue", "name"), (2, "Net sales", None, "revenue", "name"), (3, "Anything", "us-gaap:Assets", "total_assets", "tag"), (4, "经营活动产生的现金流量净额（合计）", None, "cfo", "name"),
        (5, "归属于母公司股东的净利润", None, "net_income_parent", "name"), (6, "Unknown line", None, None, None), (7, "存货 Inventories", None, "inventory", "name"), (8, "Net cash from operating activities", None, "cfo", "contains"),
        (9, "其中：利息费用", None, "interest_expense", "name"), (10, "Allowance for doubtful accounts", None, None, None),
    ],
)
TEXTS = Fixture("id int, t string, lang string, kind string, gaap string", [(1, "营业收入增长率", "zh", "growth", None), (2, "Terminal growth under IFRS", "en", "terminal_growth", "IFRS"), (3, "折现率 按企业会计准则", "zh", "wacc", "CAS"), (4, "gross margin", "en", "margin", None), (5, "plain", "en", None, None)])
CHUNKS = Fixture("id int, source string, t string, para int, label string", [(1, "a.pdf", "【第 3 页】x【第 5–6 页】", 2, "a.pdf 第 3–6 页"), (2, "b.txt", "no marks", 4, "b.txt 第 4 段"), (3, "c.pdf", "【第 7 页】", 1, "c.pdf 第 7 页")])
PAGES = Fixture("doc string, page int, field string, value double, seq int", [("d", 1, "assets", 100.0, 0), ("d", 2, "assets", 5000.0, 1), ("d", 1, "cash", 7.0, 2), ("d", 2, "cash", 70.0, 3), ("e", 1, "cash", 1.0, 4), ("e", 2, "cash", 2.0, 5), ("e", 2, "debt", 3.0, 6)])
RESOLVED = Fixture("doc string, field string, chosen double, basis string, rejected string", [("d", "assets", 5000.0, "page of largest scale", "100.0"), ("d", "cash", 70.0, "page of largest scale", "7.0"), ("e", "cash", 1.0, "first seen", "2.0"), ("e", "debt", 3.0, "only value", "")])
REQUESTS = Fixture("id int, host string, purpose string, decision string", [(1, "data.sec.gov", "facts", "ALLOW"), (2, "localhost:11434", "model", "ALLOW"), (3, "qt.gtimg.cn", "price", "ALLOW-CONSENT"), (4, "qt.gtimg.cn", "other", "CONSENT-REQUIRED"), (5, "example.com", "x", "BLOCK")])
CONSENTS = Fixture("host string, purpose string", [("qt.gtimg.cn", "price")])

C = F.col


def _conflicts(spark):
    r = statements.resolve_conflicts(PAGES.frame(spark), "doc", "field", "page", "value", "seq", ["assets", "liabilities", "equity"])
    return r.withColumn("rejected", F.array_join(F.transform("rejected", lambda x: x.cast("string")), ","))


CASES = {
    "amounts": (AMOUNTS, ["id", "value", "status"], lambda s: AMOUNTS.frame(s).select("id", numbers.amount(C("cell"))["value"].alias("value"), numbers.amount(C("cell"))["status"].alias("status"))),
    "percents": (PERCENTS, ["id", "value", "shares"], lambda s: PERCENTS.frame(s).select("id", numbers.percent_number(C("cell")).alias("value"), numbers.shares_number(C("cell")).alias("shares"))),
    "headers": (HEADERS, ["id", "period"], lambda s: HEADERS.frame(s).select("id", identifiers.period_key(C("cell")).alias("period"))),
    "labels": (LABELS, ["id", "field", "via"], lambda s: statements.identify(LABELS.frame(s).select("id", "label", "tag"), "label", "tag").select("id", "field", "via")),
    "texts": (TEXTS, ["id", "lang", "kind", "gaap"], lambda s: TEXTS.frame(s).select("id", text.language(C("t")).alias("lang"), text.ordered_case(C("t"), text.ASSUMPTION_KINDS).alias("kind"), text.gaap(C("t")).alias("gaap"))),
    "citations": (CHUNKS, ["id", "label"], lambda s: CHUNKS.frame(s).select("id", text.cite_label(C("source"), C("t"), C("para")).alias("label"))),
    "conflicts": (RESOLVED, ["doc", "field", "chosen", "basis", "rejected"], _conflicts),
    "requests": (REQUESTS, ["id", "decision"], lambda s: audit.decide(REQUESTS.frame(s).drop("decision"), CONSENTS.frame(s)).select("id", "decision")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_fixed_cases(spark, name):
    fixture, columns, run = CASES[name]
    assert spark_rows(run(spark)) == spark_rows(fixture.frame(spark).select(columns))
