"""Queries of recipes over whole tables: checklists, references, analysis, advice, comparisons of listed companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checklist as c
from .table_queries import query, read

_KEYS = ", ".join(f"('{n}', {k}, {'true' if col in ('ebitda_margin', 'net_debt') else 'false'}, {'true' if need == 'external' else 'false'})" for k, (n, _, need, _, col) in enumerate(c.ASSUMPTIONS))


@query(
    f"""SELECT c_custkey, a.name AS assumption, CAST(a.seq AS INTEGER) AS seq, CASE WHEN a.name = 'ebitda_margin' THEN CASE WHEN c_custkey % 2 = 0 THEN 0.25 END WHEN a.name = 'net_debt_scope' THEN c_acctbal END::DOUBLE AS value,
CASE WHEN (a.name = 'ebitda_margin' AND c_custkey % 2 = 0) OR a.name = 'net_debt_scope' THEN 'from_history' WHEN a.ext AND c_custkey % 3 = 0 THEN 'from_peers' ELSE 'ask' END AS status FROM customer, (VALUES {_KEYS}) AS a(name, seq, hist, ext)"""
)
def assumption_checklist(spark, sf_dir):
    """What a discounted flow needs of each company, and where it comes from (H9, K20): customers as companies."""
    k = F.col("c_custkey")
    h = read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, 0.25).alias("ebitda_margin"), F.col("c_acctbal").alias("net_debt"))
    return c.checklist(h, "c_custkey", k % 3 == 0).select("c_custkey", "assumption", "seq", "value", "status")


_CHECKS = ", ".join(f"('{n}', {k}, '{check}', {'true' if need == 'external' else 'false'})" for k, (n, _, need, check, _) in enumerate(c.ASSUMPTIONS))


@query(
    f"""WITH x AS (SELECT c_custkey, a.seq AS k, a.name || ': ' || a.chk AS question, CASE WHEN a.name = 'net_debt_scope' THEN c_acctbal END AS reference, CASE WHEN a.name = 'net_debt_scope' THEN 2 WHEN a.ext AND c_custkey % 3 = 0 THEN 0 ELSE 1 END AS o FROM customer, (VALUES {_CHECKS}) AS a(name, seq, chk, ext))
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o, k) AS INTEGER) AS seq, question, reference, ['peers', 'open', 'confirm'][o + 1] AS origin FROM x"""
)
def question_lists(spark, sf_dir):
    """What is still asked of each company, with references and origins (H7): customers as companies."""
    h = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("net_debt"))
    return c.question_list(c.checklist(h, "c_custkey", F.col("c_custkey") % 3 == 0), "c_custkey")


@query(
    """WITH x AS (SELECT c_custkey, c_acctbal AS oi, CASE WHEN c_custkey % 3 <> 0 THEN 10.0 END AS da, 100.0 + c_custkey AS rev, CASE WHEN c_custkey % 2 = 0 THEN 7.0 END AS pay FROM customer),
m AS (SELECT c_custkey, 'revenue' AS metric, CAST(rev AS DOUBLE) AS value FROM x UNION ALL SELECT c_custkey, 'ebit', oi FROM x UNION ALL SELECT c_custkey, 'ebitda', oi + da FROM x UNION ALL SELECT c_custkey, 'sde', oi + da + pay FROM x)
SELECT c_custkey, metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'missing row' WHEN value <= 0 THEN 'not positive' END AS reason FROM m"""
)
def metric_references(spark, sf_dir):
    """What multiples may be put on, and why not (H11, M19): customers as companies."""
    k = F.col("c_custkey")
    s = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("operating_income"), F.when(k % 3 != 0, 10.0).alias("da"), (F.lit(100.0) + k).alias("revenue"), F.when(k % 2 == 0, 7.0).alias("owner_pay"))
    return c.metric_reference(s, "c_custkey").withColumn("value", F.round("value", 6))


@query(
    """WITH x AS (SELECT c_custkey, c_acctbal AS ni, 5000.0 + c_custkey AS rev, 9000.0 AS a, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 3000.0 END AS e FROM customer), y AS (SELECT *, e > 0 AS ok FROM x),
f AS (SELECT c_custkey, ok, 'roe' AS factor, ni / rev * (rev / a) * (a / e) AS v FROM y UNION ALL SELECT c_custkey, ok, 'net_margin', ni / rev FROM y UNION ALL SELECT c_custkey, ok, 'asset_turnover', rev / a FROM y UNION ALL SELECT c_custkey, ok, 'equity_multiplier', a / e FROM y UNION ALL SELECT c_custkey, ok, 'roa', ni / a FROM y)
SELECT c_custkey, factor, round(CASE WHEN ok THEN v END::DOUBLE, 8) AS value, ok AS applicable FROM f"""
)
def return_analysis(spark, sf_dir):
    """The return on equity and its factors (H17, M21): customers as companies."""
    k = F.col("c_custkey")
    s = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("net_income"), (F.lit(5000.0) + k).alias("revenue"), F.lit(9000.0).alias("assets"), F.when(k % 4 == 0, 0.0).otherwise(3000.0).alias("equity"), F.lit(1.0).alias("pretax"), F.lit(1.0).alias("operating_income"))
    return c.analysis(s, "c_custkey").withColumn("value", F.round("value", 8))


@query(
    """WITH r AS (SELECT o_custkey AS code, year(o_orderdate) AS y, sum(o_totalprice) AS rev, sum(o_totalprice) / 10 - 9000 AS ni FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1996 GROUP BY ALL), l AS (SELECT code, max(y) AS y, arg_max(rev, y) AS rev, arg_max(ni, y) AS ni FROM r GROUP BY code)
SELECT c_custkey AS code, CAST(y AS INTEGER) AS fiscal_year, round(CASE WHEN ni > 0 THEN c_acctbal * 100 / ni END, 6) AS pe, round(CASE WHEN rev > 0 THEN c_acctbal * 100 / rev END, 6) AS price_to_revenue,
CASE WHEN y IS NULL THEN 'no statement of 1993 to 1996' WHEN ni <= 0 THEN 'pe: net_income_parent not positive' ELSE 'pb: no equity_parent' END AS gap FROM customer LEFT JOIN l ON code = c_custkey"""
)
def listed_multiples(spark, sf_dir):
    """Multiples of listed companies on the last statement within three years back (J8, U8): customers' yearly orders as statements."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum("o_totalprice").alias("revenue"))
    records = o.withColumn("net_income_parent", F.col("revenue") / 10 - 9000).withColumn("equity_parent", F.lit(None).cast("double"))
    quotes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("price"), F.lit(100.0).alias("shares"))
    got = c.listed_multiples(records, quotes, 1996)
    return got.select("code", "fiscal_year", F.round("pe", 6).alias("pe"), F.round("price_to_revenue", 6).alias("price_to_revenue"), "gap")


@query(
    """SELECT s_suppkey AS entity, '<table><tr><td>a&amp;b</td><td><div style="margin-left:0px;width:' || CASE WHEN s_suppkey % 2 = 0 THEN '600' ELSE '300' END || 'px">1.50</div></td></tr><tr><td>c</td><td>' || CASE WHEN s_suppkey % 2 = 0 THEN 'no share count' ELSE '<div style="margin-left:300px;width:300px">2.50</div>' END || '</td></tr></table>' AS html FROM supplier"""
)
def football_pages(spark, sf_dir):
    """Bands of methods as bars on one scale (B8): suppliers as entities."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(k.alias("entity"))
    one = s.select("entity", F.lit("a&b").alias("method"), F.lit(1.0).alias("band_low"), F.lit(1.5).alias("band_mid"), F.lit(2.0).alias("band_high"), F.lit(None).cast("string").alias("note"))
    odd = F.col("entity") % 2 != 0
    two = s.select("entity", F.lit("c").alias("method"), F.when(odd, 2.0).alias("band_low"), F.when(odd, 2.5).alias("band_mid"), F.when(odd, 3.0).alias("band_high"), F.when(~odd, "no share count").alias("note"))
    return c.football_html(one.unionByName(two))


@query(
    """SELECT 'n' || c_custkey AS name, 'n' || c_custkey || ' | ' || printf('%.4f', c_custkey % 9 / 100) || ' | ' || CASE WHEN c_custkey % 2 = 0 THEN 'peers 5, median 0.0500, at or below 40.0%' ELSE 'no peers' END AS line FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'terminal_growth', 'terminal_growth | ' || printf('%.4f', c_custkey % 90 / 1000) || ' | peers 5, median 0.0500, at or below 40.0%' || CASE WHEN c_custkey % 90 / 1000 > 0.04 THEN ' | error: above long-term nominal growth' WHEN c_custkey % 90 / 1000 > 0.9 * 0.04 THEN ' | warning: near long-term nominal growth' WHEN c_custkey % 90 / 1000 < 0.02 THEN ' | warning: below inflation' ELSE '' END FROM customer WHERE c_custkey % 10 = 0"""
)
def advice_lines(spark, sf_dir):
    """Assumptions beside their peers in sentences, with the bounds of perpetual growth (H16, P21): customers as assumptions."""
    k = F.col("c_custkey")
    ten = k % 10 == 0
    a = read(spark, sf_dir, "customer").select(
        F.when(ten, "terminal_growth").otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.when(ten, k % 90 / F.lit(1000.0)).otherwise(k % 9 / F.lit(100.0)).alias("value"),
        F.when(k % 2 == 0, 5).alias("n"), F.lit(0.05).alias("median"), F.lit(0.4).alias("share_at_or_below"),
    )
    return c.advice_lines(a)
