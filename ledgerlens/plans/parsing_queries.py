"""Queries over whole tables for parsing, detectors, rules on single rows and small judgements, each with SQL that computes the same.

Their inputs are made from the tables' keys, so that every form occurs in turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, numbers, text
from ..operators import audit, derived, layout, peers, recipes, statements
from ..operators import valuation as v
from ..sources import files
from .table_queries import query, read

_AMOUNT = """CASE o_orderkey % 8 WHEN 0 THEN concat(CAST(o_orderkey % 900 + 1 AS {t}), ',', lpad(CAST(o_orderkey % 1000 AS {t}), 3, '0'), '.50') WHEN 1 THEN concat('3.', lpad(CAST(o_orderkey % 1000 AS {t}), 3, '0'), '.7', CAST(o_orderkey % 10 AS {t}))
WHEN 2 THEN concat('45.508.', CAST(o_orderkey + 10000 AS {t})) WHEN 3 THEN '—' WHEN 4 THEN '' WHEN 5 THEN concat('1,234 ', CAST(o_orderkey AS {t})) WHEN 6 THEN concat('(', CAST(o_orderkey AS {t}), ')') ELSE concat('1, ', lpad(CAST(o_orderkey % 1000 AS {t}), 3, '0'), '.25') END"""


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN (o_orderkey % 900 + 1) * 1000 + o_orderkey % 1000 + 0.5 WHEN 1 THEN 3000 + o_orderkey % 1000 + 0.7 + (o_orderkey % 10) / 100 WHEN 6 THEN -o_orderkey WHEN 7 THEN 1000 + o_orderkey % 1000 + 0.25 END::DOUBLE AS value,
['ok', 'repaired', 'suspect', 'dash', 'empty', 'suspect', 'ok', 'repaired'][o_orderkey % 8 + 1] AS status FROM orders"""
)
def amount_parse(spark, sf_dir):
    """OCR amounts with status and systematic repair (M2, M3)."""
    a = numbers.amount(F.expr(_AMOUNT.format(t="STRING")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(a["value"], 4).alias("value"), a["status"].alias("status"))


_PERCENT = """CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_orderkey % 90 AS {t}), '.5%') WHEN 1 THEN concat('1,', lpad(CAST(o_orderkey % 1000 AS {t}), 3, '0')) WHEN 2 THEN 'x' WHEN 3 THEN concat(CAST(o_orderkey % 90 AS {t}), '.5万') ELSE concat(CAST(o_orderkey % 9 AS {t}), '亿') END"""


@query(
    """SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 90 + 0.5) / 100 WHEN 1 THEN 1000 + o_orderkey % 1000 END::DOUBLE, 9) AS value,
CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 90 + 0.5 WHEN 1 THEN 1000 + o_orderkey % 1000 WHEN 3 THEN (o_orderkey % 90 + 0.5) * 10000 WHEN 4 THEN (o_orderkey % 9) * 100000000 END::DOUBLE AS shares FROM orders"""
)
def percent_and_shares(spark, sf_dir):
    """Percent-aware numbers and share counts (M5, M7)."""
    t = F.expr(_PERCENT.format(t="STRING"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.percent_number(t), 9).alias("value"), numbers.shares_number(t).alias("shares"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) WHEN 2 THEN make_date(year(o_orderdate), 12, 31) WHEN 3 THEN make_date(year(o_orderdate), 12, 31) END AS period FROM orders"""
)
def period_keys(spark, sf_dir):
    """Periods that headers name: a day, a month, a year in digits or in Chinese numerals, or none."""
    y, m, d = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.dayofmonth))
    k = F.col("o_orderkey") % 5
    header = F.when(k == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(k == 1, F.concat(y, F.lit("年"), m, F.lit("月"))).when(k == 2, F.concat(F.translate(y, "0123456789", "〇一二三四五六七八九"), F.lit("年"))).when(k == 3, F.concat(F.lit("Year "), y)).otherwise("Note")
    return read(spark, sf_dir, "orders").select("o_orderkey", identifiers.period_key(header).alias("period"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'revenue' WHEN 1 THEN 'accounts_payable' WHEN 2 THEN 'cfo' WHEN 3 THEN 'capex' WHEN 4 THEN 'total_liabilities' END AS field,
CASE p_partkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'contains' WHEN 3 THEN 'prefix' WHEN 4 THEN 'tag' END AS via FROM part"""
)
def label_map(spark, sf_dir):
    """Labels to accounting fields in stages (J10, J11, F6): labels in turn on parts."""
    k, number = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    label = (
        F.when(k == 0, F.concat(F.lit("一、营业收入（附注"), number, F.lit("）"))).when(k == 1, "Accounts  Payable").when(k == 2, F.concat(F.lit("经营活动产生之现金流量净额"), number))
        .when(k == 3, F.concat(F.lit("购建固定资产支付第"), number)).when(k == 4, F.concat(F.lit("anything "), number)).otherwise(F.concat(F.lit("Allowance "), number))
    )
    rows = read(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.when(k == 4, "us-gaap:Liabilities").alias("tag"))
    return statements.identify(rows, "label", "tag").select("p_partkey", "field", "via")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'zh' ELSE 'en' END AS lang, ['growth', 'terminal_growth', 'wacc', 'margin'][doc_id % 4 + 1] AS kind, CASE doc_id % 4 WHEN 1 THEN 'IFRS' WHEN 2 THEN 'CAS' END AS gaap FROM documents"""
)
def text_detectors(spark, sf_dir):
    """Language, kind of assumption and accounting standard of a text."""
    k = F.col("doc_id") % 4
    t = F.when(k == 0, "营业收入增长率").when(k == 1, "Terminal growth under IFRS").when(k == 2, "折现率 按企业会计准则").otherwise("gross margin")
    return read(spark, sf_dir, "documents").select("doc_id", text.language(t).alias("lang"), text.ordered_case(t, text.ASSUMPTION_KINDS).alias("kind"), text.gaap(t).alias("gaap"))


@query(
    """SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN ' 第 ' || doc_id || '–' || (doc_id + 2) || ' 页' WHEN 1 THEN ' 第 ' || doc_id || ' 页' ELSE ' 第 ' || n_chars || ' 段' END AS label FROM documents"""
)
def cite_labels(spark, sf_dir):
    """Citations by page range, page or paragraph."""
    d, k = F.col("doc_id"), F.col("doc_id") % 3
    marks = F.when(k == 0, F.concat(F.lit("【第 "), d, F.lit(" 页】x【第 "), d + 1, F.lit("–"), d + 2, F.lit(" 页】"))).when(k == 1, F.concat(F.lit("【第 "), d, F.lit(" 页】"))).otherwise("no marks")
    return read(spark, sf_dir, "documents").select("doc_id", text.cite_label(F.col("source"), marks, F.col("n_chars")).alias("label"))


@query(
    """WITH r AS (SELECT l_orderkey AS doc, l_suppkey AS page, CASE l_partkey % 3 WHEN 0 THEN 'assets' WHEN 1 THEN 'cash' ELSE 'debt' END AS field, l_extendedprice AS value, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + CAST(round(l_extendedprice) AS BIGINT) AS seq FROM lineitem),
s AS (SELECT doc, page, max(abs(value)) AS big FROM r WHERE field = 'assets' GROUP BY ALL), u AS (SELECT doc FROM s GROUP BY doc HAVING count(*) >= 2), k AS (SELECT r.*, CASE WHEN u.doc IS NOT NULL THEN s.big END AS big FROM r LEFT JOIN s ON r.doc = s.doc AND r.page = s.page LEFT JOIN u ON r.doc = u.doc),
g AS (SELECT doc, field, count(DISTINCT value) AS n, max(big) AS top, arg_max(value, (coalesce(big, -1.0), -seq)) AS by_page, arg_min(value, seq) AS first FROM k GROUP BY doc, field)
SELECT doc, field, round(CASE WHEN n > 1 AND top IS NOT NULL THEN by_page ELSE first END, 4) AS chosen, CASE WHEN n = 1 THEN 'only value' WHEN top IS NOT NULL THEN 'page of largest scale' ELSE 'first seen' END AS basis, CAST(n - 1 AS INTEGER) AS n_rejected FROM g"""
)
def page_conflicts(spark, sf_dir):
    """Conflicting values of a document's pages, by the page of largest scale (J23, J24, R14): lines as figures on pages of suppliers."""
    k = F.col("l_partkey") % 3
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("page"), F.when(k == 0, "assets").when(k == 1, "cash").otherwise("debt").alias("field"), F.col("l_extendedprice").alias("value"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.round("l_extendedprice").cast("long")).alias("seq"))
    r = statements.resolve_conflicts(rows, "doc", "field", "page", "value", "seq", ["assets", "liabilities", "equity"])
    return r.select("doc", "field", F.round("chosen", 4).alias("chosen"), "basis", F.size("rejected").alias("n_rejected"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'ALLOW' WHEN 2 THEN CASE WHEN event_type = 'purchase' THEN 'ALLOW-CONSENT' ELSE 'CONSENT-REQUIRED' END ELSE 'BLOCK' END AS decision FROM events"""
)
def egress_decisions(spark, sf_dir):
    """Who may be asked for what (P11, P12): events as requests, consent to one purpose."""
    k = F.col("event_id") % 5
    host = F.when(k == 0, "data.sec.gov").when(k == 1, "localhost:11434").when(k == 2, "qt.gtimg.cn").when(k == 3, "example.com").otherwise("localhost.example.com")
    asked = read(spark, sf_dir, "events").select("event_id", host.alias("host"), F.col("event_type").alias("purpose"))
    consents = spark.createDataFrame([("qt.gtimg.cn", "purchase"), ("example.com", "view")], "host string, purpose string")
    return audit.decide(asked, consents).select("event_id", "decision")


@query(
    """SELECT event_id, 'codes[0]' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 'codes[1]', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'q', 'x' FROM events"""
)
def request_parameters(spark, sf_dir):
    """Outgoing parameters one by one."""
    e = read(spark, sf_dir, "events")
    codes = F.concat(F.lit('["'), F.col("event_type"), F.lit('","'), F.col("user_id").cast("string"), F.lit('"]'))
    return audit.flatten_parameters(e.select("event_id", F.create_map(F.lit("q"), F.lit("x"), F.lit("codes"), codes).alias("params")), "event_id").select("event_id", "name", "value")


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND (c_custkey % 70 + 1) * 100 / c_acctbal <= 0.6 THEN round((c_custkey % 70 + 1) * 100 / c_acctbal, 8) END AS tax_rate, CASE WHEN c_custkey % 4 <> 0 AND 10.0 / (c_custkey % 4 * 20) <= 0.5 THEN round(10.0 / (c_custkey % 4 * 20), 8) END::DOUBLE AS debt_cost FROM customer"""
)
def implied_rates(spark, sf_dir):
    """Tax rate and cost of debt, withheld outside their bounds."""
    k = F.col("c_custkey")
    tax = v.effective_tax((k % 70 + 1) * 100, F.col("c_acctbal"))
    cost = v.implied_debt_cost(F.lit(10.0), F.when(k % 4 != 0, (k % 4 * 20).cast("double")), F.lit(None).cast("double"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(tax, 8).alias("tax_rate"), F.round(cost, 8).alias("debt_cost"))


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN n < 3 THEN 'fewer than 3 peers' END, CASE WHEN c_custkey % 2 = 0 THEN 'no date' END, CASE WHEN c_custkey % 3 = 0 THEN 'no metric' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""
)
def comparison_readiness(spark, sf_dir):
    """What a comparison lacks (V13): a customer's orders as peers."""
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_peers"))
    k = F.col("c_custkey")
    asked = read(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumns({"as_of": F.when(k % 2 != 0, "2024-01-01"), "metric": F.when(k % 3 != 0, "pe"), "market": F.lit("us"), "currency": F.lit("USD")})
    return peers.readiness(asked).select("c_custkey", F.array_join("problems", ",").alias("problems"))


@query(
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Revenues' AS tag, 'USD' AS unit, CAST(s AS INTEGER) AS seq, CASE WHEN s = 0 THEN CAST(o_orderdate AS DATE) END AS "end", CASE WHEN s = 0 THEN o_totalprice ELSE 1.0 END AS val
FROM orders, (SELECT unnest([0, 1]) AS s) WHERE o_orderkey % 10 <> 0"""
)
def company_facts(spark, sf_dir):
    """Observations of companies' fact files, broken files and dates among them (A19, D14, D6): orders as files."""
    json = F.concat(
        F.lit('{"cik":'), F.col("o_custkey").cast("string"), F.lit(',"entityName":"x","facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"start":"2020-01-01","end":"'), F.col("o_orderdate").cast("date").cast("string"),
        F.lit('","val":'), F.col("o_totalprice").cast("string"), F.lit(',"filed":"2021-02-01"},{"end":"oops","val":1,"filed":"2021-02-01"}]}}}}}'),
    )
    landed = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, json).otherwise("broken").alias("value"))
    return files.flatten_facts(landed).select("cik", "tag", "unit", "seq", "end", "val")


@query("SELECT o_orderkey AS code, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close FROM orders WHERE o_orderkey % 3 = 0")
def price_bars(spark, sf_dir):
    """Bars from rows of text, broken ones dropped."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("date").cast("string")
    row = F.when(k == 0, F.concat(d, F.lit(",1,"), F.col("o_totalprice").cast("string"), F.lit(",3,0.5,9"))).when(k == 1, "bad").otherwise(F.concat(F.substring(d, 1, 5), F.lit("13-02,1,2,3,4,5")))
    return files.parse_bars(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"), row.alias("row")), ["code"])


@query(
    """SELECT 'k' || o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN '8.5%' ELSE CAST(o_orderkey AS VARCHAR) END AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'high' END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN 'note ' || o_orderkey END AS source FROM orders WHERE o_orderkey % 4 IN (0, 1)"""
)
def answer_lines(spark, sf_dir):
    """Answers with confidence and source, comments and noise left out."""
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("k"), n, F.lit(" = 8.5% @high:note "), n)).when(k == 1, F.concat(F.lit("k"), n, F.lit("="), n)).when(k == 2, F.concat(F.lit("# k=v "), n)).otherwise("noise")
    return files.parse_answers(read(spark, sf_dir, "orders").select(line.alias("value")))


@query(
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'cash_flow' ELSE 'income' END AS stmt, CASE l_partkey % 3 WHEN 0 THEN 'operating_income' WHEN 1 THEN 'capex' ELSE 'x' END AS field, CASE WHEN l_quantity > 25 THEN l_quantity END AS value FROM lineitem),
m AS (SELECT l_orderkey, 'ebitda_margin' AS measure, bool_or(stmt = 'income') AS t, bool_or(stmt = 'income' AND field = 'operating_income') AS f, bool_or(stmt = 'income' AND field = 'operating_income' AND value IS NOT NULL) AS v FROM r GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'capex_share', bool_or(stmt = 'cash_flow'), bool_or(stmt = 'cash_flow' AND field = 'capex'), bool_or(stmt = 'cash_flow' AND field = 'capex' AND value IS NOT NULL) FROM r GROUP BY l_orderkey)
SELECT l_orderkey, measure, CASE WHEN f THEN 'no value' WHEN t THEN 'no row' ELSE 'no table' END AS reason FROM m WHERE NOT v"""
)
def missing_reasons(spark, sf_dir):
    """Why a measure has no value: no table, no row, no number (P23, P25): lines as rows of an order's statements."""
    k = F.col("l_partkey") % 3
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "cash_flow").otherwise("income").alias("stmt"), F.when(k == 0, "operating_income").when(k == 1, "capex").otherwise("x").alias("field"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("value"))
    return derived.history_reasons(rows, "l_orderkey", {"ebitda_margin": ["income", "operating_income"], "capex_share": ["cash_flow", "capex"]})


@query(
    """SELECT p_partkey, 'software' AS industry, 1 AS rank FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'logistics', 2 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'restaurants', 1 FROM part WHERE p_partkey % 3 = 1"""
)
def industry_proposals(spark, sf_dir):
    """Industries a description speaks for."""
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("SaaS software subscription for 物流 "), F.col("p_name"))).when(k == 1, "a restaurant")
    return recipes.propose_industries(read(spark, sf_dir, "part").select("p_partkey", t.alias("t")), "p_partkey", "t").select("p_partkey", "industry", "rank")


@query(
    """WITH p AS (SELECT user_id AS doc, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS page, count(*) FILTER (event_type IN ('view', 'click')) AS balance, count(*) FILTER (event_type IN ('purchase', 'signup')) AS income FROM events GROUP BY ALL),
l AS (SELECT doc, page, 'balance' AS kind, balance AS mine, income AS other FROM p UNION ALL SELECT doc, page, 'income', income, balance FROM p), a AS (SELECT doc, kind, arg_max(page, (mine, -page)) AS a FROM l GROUP BY doc, kind HAVING max(mine) > 0),
k AS (SELECT l.*, a, (mine > 0 AND mine >= other) OR page = a AS ok FROM l JOIN a USING (doc, kind)),
w AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc, kind, page >= a ORDER BY page) AS up, bool_and(ok) OVER (PARTITION BY doc, kind, page <= a ORDER BY page DESC) AS down FROM k)
SELECT doc, kind, CAST(page AS INTEGER) AS page FROM w WHERE CASE WHEN page >= a THEN up ELSE down END"""
)
def statement_pages(spark, sf_dir):
    """The pages of each statement, from its best page outwards (W11, W12): a user's days as pages."""
    e = F.col("event_type")
    scores = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.unix_date(F.col("ts").cast("date")).alias("page")).agg(F.count_if(e.isin("view", "click")).alias("balance"), F.count_if(e.isin("purchase", "signup")).alias("income"))
    return layout.pick_pages(scores, "doc", "page", ["balance", "income"])
