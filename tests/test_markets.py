from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerlens.operators import layout
from ledgerlens.sources import files, markets


def test_mainland_records_pair_periods(spark):
    i = spark.sql("SELECT 'a' AS secucode, '2023-12-31' AS report_date, map('OPERATE_INCOME', '1,000', 'PARENT_NETPROFIT', 'n/a', 'OPERATE_PROFIT', 'true') AS row")
    b = spark.sql("SELECT 'a' AS secucode, '2022-12-31' AS report_date, map('TOTAL_EQUITY', '70') AS row")
    got = {r.report_date: r for r in markets.cn_records(i, b).collect()}
    one = got["2023-12-31"]
    assert one["values"]["revenue"].value == 1000.0 and one["values"]["revenue"].field == "OPERATE_INCOME"
    assert one.gaps == ["net_income_parent: not a number: n/a", "operating_income: not a number: true", "equity_parent: balance not disclosed for the period", "equity: balance not disclosed for the period"]
    assert got["2022-12-31"]["values"]["equity"].value == 70.0
    t = spark.createDataFrame([("a", "IBALANCE"), ("a", "SBALANCE"), ("b", "GINCOME")], "secucode string, suffix string")
    assert [tuple(r) for r in markets.detect_template(t).collect()] == [("a", "insurer")]


def test_hong_kong_rows(spark):
    raw = spark.sql("SELECT '00700' AS code, d AS report_date, map('PE_TTM', '15', 'BPS', x) AS row FROM VALUES ('2023-12-31', '1'), ('2022-12-31', 'bad'), ('2021-12-31', '3') AS t(d, x)")
    rows = markets.hk_rows(raw)
    assert [r.period for r in markets.history(rows, 2).orderBy("period").collect()] == ["2022-12-31", "2023-12-31"]
    assert markets.history(markets.visible(rows, F.lit("2022-12-31")), 1).first().fields == {"pe": 15.0}


def test_price_rows_of_other_sources(spark):
    objects = spark.createDataFrame([("x", json.dumps({"day": "2024-01-02", "open": "1", "close": "2.5", "high": "3", "low": "1"})), ("x", "[]")], "code string, value string")
    lists = spark.createDataFrame([("x", json.dumps(["2024-01-03", "1", "2", "3", "4", "5", {}])), ("x", json.dumps(["1"]))], "code string, value string")
    rows = markets.bars_from_objects(objects).unionByName(markets.bars_from_lists(lists))
    assert sorted((str(r.date), r.close) for r in files.parse_bars(rows, ["code"]).collect()) == [("2024-01-02", 2.5), ("2024-01-03", 2.0)]
    f = spark.createDataFrame([(json.dumps({"tag": "Assets", "data": [{"cik": 1, "end": "2020-12-31", "val": 5, "accn": "a"}]}),)], "value string")
    assert markets.frames(f).first().cik == "0000000001"
    young = markets.fresh(spark.sql("SELECT timestamp'2024-01-02 00:00:00' AS modified UNION ALL SELECT timestamp'2024-01-01 00:00:00'"), F.lit("2024-01-02 06:00:00").cast("timestamp"))
    assert young.count() == 1


def test_grids(spark):
    cells = [("s", 0, 0, "某公司"), ("s", 1, 0, "项目"), ("s", 1, 1, "行次"), ("s", 1, 2, "期末余额"), ("s", 1, 3, "期初余额"), ("s", 2, 0, "货币资金"), ("s", 2, 2, "5"), ("s", 2, 3, "4"), ("s", 3, 2, "9")]
    cells += [("t", 0, 0, "x"), ("t", 1, 1, "2022-12-31"), ("t", 1, 2, "2023-12-31"), ("t", 2, 0, "cash"), ("t", 2, 1, "1"), ("t", 2, 2, "2")]
    df = spark.createDataFrame(cells, "sheet string, r int, c int, value string")
    assert {r.sheet: r.header for r in layout.header_rows(df, ["sheet"]).collect()} == {"s": 1, "t": 1}
    got = sorted(tuple(r) for r in layout.grid_rows(df, ["sheet"]).collect())
    assert got == [("s", 2, "货币资金", "5", "4"), ("t", 2, "cash", "2", "1")]


def test_titled_ranges(spark):
    pages = [("d", 1, "balance sheet", 0), ("d", 5, "balance sheet", 30), ("d", 6, "more", 20), ("d", 7, "income statement", 25), ("d", 8, None, 3)]
    df = spark.createDataFrame(pages, "doc string, page int, text string, numeric_rows int")
    got = sorted(tuple(r) for r in layout.titled_range(df, "doc", {"balance": ["balance sheet"], "income": ["income statement"]}).collect())
    assert got == [("d", "balance", 5, 6), ("d", "income", 7, 8)]
