from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import identifiers, numbers, text


def one(spark, column, *values):
    names = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], names).select(column.alias("x")).first().x


def test_tokens_mix_words_characters_and_bigrams(spark):
    assert one(spark, text.tokenize(F.col("c0")), "Net 8.5% 营收，增长 x") == ["net", "8.5%", "x", "营", "收", "增", "长", "营收", "收增", "增长"]
    assert one(spark, text.tokenize(F.col("c0")), None) == []


def test_nfkc_is_idempotent(spark):
    once = one(spark, text.nfkc(F.col("c0")), "ﬁ①Ａ")
    assert once == "fi1A" and one(spark, text.nfkc(F.col("c0")), once) == once
    assert one(spark, text.compatibility_characters(F.col("c0")), "ﬁxﬁ①") == ["ﬁ", "①"]


def test_html_text_drops_hidden_parts(spark):
    page = "<head><title>t</title></head><p>a &amp; b</p><script>x<1</script><!-- c --> d"
    assert one(spark, text.html_text(F.col("c0")), page) == "a & b d"


def test_unit_splits_scale_and_currency(spark):
    assert tuple(one(spark, text.unit(F.col("c0")), "(in thousands)")) == (1e3, None)
    assert tuple(one(spark, text.unit(F.col("c0")), "单位：人民币万元")) == (1e4, "CNY")


def test_scope_and_slug_and_digest(spark):
    assert one(spark, text.scope(F.col("c0")), "Consolidated balance sheet") == "consolidated"
    assert one(spark, text.slug(F.col("c0")), " A/B 公司 ") == "a-b-公司"
    assert tuple(one(spark, text.digest(F.col("c0")), "abc")) == (3, "ba7816bf8f01cfea")


def test_percent_text_and_small_numbers(spark):
    assert one(spark, numbers.as_percent_text(F.col("c0")), "8, 9.5；x%") == "8%,9.5%,x%"
    assert one(spark, numbers.row_number_like(F.col("c0")), "400") and not one(spark, numbers.row_number_like(F.col("c0")), "401")
    assert one(spark, numbers.looks_like_amount(F.col("c0")), "(1,234)") and not one(spark, numbers.looks_like_amount(F.col("c0")), "cash")


def test_tolerance_is_relative_to_the_first(spark):
    row = spark.sql("SELECT 3e6D AS a, 3000002.9D AS b").select(numbers.close_to(F.col("a"), F.col("b")).alias("x"), numbers.close_to(F.lit(0.0), F.lit(1.0)).alias("y")).first()
    assert row.x and row.y


def test_dates_and_lists(spark):
    assert one(spark, identifiers.days_between(F.col("c0"), F.col("c1")), "2020-01-01", "2020-12-31") == 365
    assert one(spark, identifiers.days_between(F.col("c0"), F.col("c1")), "2020-01-01", "soon") is None
    assert one(spark, identifiers.ticker_list(F.col("c0")), "aapl, msft；700、") == ["AAPL", "MSFT", "700"]
    for raw, want in (("CIK320193", "0000320193"), ("000000320193", "0000320193"), ("12345678901", "12345678901"), ("0", "0000000000"), ("x1", None), (None, None)):
        assert one(spark, identifiers.filer_key(F.col("c0")), raw) == want
    for raw, want in (("700", "00700"), ("0700.HK", "00700"), ("000700", "000700"), ("600519", "600519"), ("abc", None), (None, None)):
        assert one(spark, identifiers.hk_code(F.col("c0")), raw) == want
    for raw, want in (("600519", "600519.SH"), ("1", "000001.SZ"), ("6001234", None), ("500123", None), ("92000", "092000.SZ"), ("830001", "830001.BJ")):
        assert one(spark, identifiers.cn_security(F.col("c0")), raw) == want
    assert str(one(spark, identifiers.strict_report_date(F.col("c0")), "20231231")) == "2023-12-31"
    with pytest.raises(Exception, match="not a report date"):
        one(spark, identifiers.strict_report_date(F.col("c0")), "2023-12-30")
    with pytest.raises(ValueError, match="unknown duration"):
        identifiers.duration_between(F.lit(1), "decade")


def test_radicals_become_characters(spark):
    assert one(spark, text.normal_form(F.col("c0")), "⻔⼀①") == "门一1" and len(text.RADICALS) == len(text.RADICALS_AS) == 55
    assert one(spark, text.unmapped_radicals(F.col("c0")), "⺀门") == ["⺀"]
