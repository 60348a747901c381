"""Folders of materials to files, the landing zone, sections of answers."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import appraisal
from ledgerlens.sources import landing

TABLE = "<table><tr><td>项目</td><td>附注</td><td>2023年12月31日</td><td>2022年12月31日</td></tr>{}</table>"


def row(label, now, before):
    return f"<tr><td>{label}</td><td>1</td><td>{now}</td><td>{before}</td></tr>"


@pytest.fixture
def root(tmp_path):
    sheet = TABLE.format(row("資產總計", "1,000.00", "900") + row("负债合计", "600.00", "500") + row("所有者权益合计", "400.00", "400") + row("货币资金", "100.00", "90") + row("短期借款", "50.00", "40") + row("长期借款", "150.00", "1"))
    income = TABLE.format(row("一、营业收入", "800.00", "700") + row("营业利润", "90.00", "80") + row("折旧与摊销", "30.00", "20") + row("净利润", "(7.50)", "5"))
    found = {"alpha/balance.html": sheet, "alpha/income.html": income, "alpha/answers.txt": "# filled in\nmultiple_low = 5\nmultiple_mid = 6\nmultiple_mid = 7 @high:peers\nmultiple_high = 9\ncash = 120\n", "beta/notes.txt": "营业收入 5 1,000.00 900.00 货币资金 20 10", "gamma/broken.xlsx": "no workbook", "gamma/empty.txt": ""}
    for name, text in found.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def test_folder_to_files(spark, root):
    found = {r.entity: r for r in appraisal.appraise_folder(spark, str(root / "in"), str(root / "out")).collect()}
    a = found["alpha"]
    assert (a.assets, a.revenue, a.net_income, a.cash, a.multiple_mid) == (1000.0, 800.0, -7.5, 120.0, 7.0)
    assert (a.ebitda, a.net_debt) == (120.0, 80.0) and (a.low, a.mid, a.high) == (520.0, 760.0, 1000.0) and a.gap is None
    assert a.checks == ["balance: holds", "cash_rollforward: undecidable"]
    assert (found["beta"].revenue, found["beta"].cash, found["beta"].gap) == (1000.0, 20.0, "no EBITDA") and found["gamma"].revenue is None
    names = sorted(str(p.relative_to(root / "out")) for p in (root / "out").rglob("*") if p.is_file())
    assert names == sorted(f"{e}/{n}" for e in ("alpha", "beta", "gamma") for n in ("template.txt", "config.json", "report.txt"))
    assert json.loads((root / "out/alpha/config.json").read_text())["figures"]["revenue"] == 800.0
    assert "Equity by multiples: 520.00 – 1,000.00, mid 760.00" in (root / "out/alpha/report.txt").read_text()
    assert "operating_income = \n" in (root / "out/beta/template.txt").read_text() and "No value: no EBITDA" in (root / "out/gamma/report.txt").read_text()


def test_landing_zone(spark, tmp_path):
    path, schema = str(tmp_path / "zone"), "doc string, page int, text string"
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "zz")], schema)
    assert landing.landed(spark, path, schema).count() == 0 and landing.missing(df, spark, path, schema, ["doc", "page"]).count() == 4
    assert landing.land(df, path, ["doc", "page"], buckets=4) == 3
    more = df.unionByName(spark.createDataFrame([(f"d{i}", 1, "t") for i in range(200)], schema))
    assert landing.land(more, path, ["doc", "page"], buckets=4) == 200 and landing.land(more, path, ["doc", "page"], buckets=4) == 0
    assert len([p for p in os.listdir(path) if p.startswith("bucket=")]) == 4
    assert {r.text for r in landing.landed(spark, path, schema).where("doc = 'b'").collect()} == {"z"}
    assert landing.landed(spark, path, schema, F.lit("2000-01-01").cast("timestamp")).count() == 203
    assert landing.landed(spark, path, schema, F.current_timestamp() + F.expr("INTERVAL 1 HOUR")).count() == 0


def test_sections_of_answers(spark):
    text = "intro\n## Conclusion: yes\nmore\n\n2. **Evidence**: [S1]\n结论：好\nEvidence\nagain"
    df = spark.createDataFrame([(text,), (None,), ("plain",)], "t string").select(appraisal.sections(F.col("t"), ["Conclusion", "Evidence", "结论", "Risk"]).alias("s"))
    assert [r.s for r in df.collect()] == [{"Conclusion": "yes\nmore", "Evidence": "[S1]", "结论": "好"}, {}, {}]
