"""Queries over whole tables for operators that work on statements, pages, filings and runs, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, numbers, text
from ..operators import comps, derived, facts, layout, loading, notes, overlap, recipes, statements
from ..operators import checks as checks_
from ..sources import documents, files, markets
from .table_queries import query, read

#: Orders as filed facts: a tag by turn, a year's span, two months to the filing.
_FACTS = """facts AS (SELECT o_custkey AS cik, o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'SalesRevenueNet' WHEN 2 THEN 'OperatingIncomeLoss' WHEN 3 THEN 'NetIncomeLoss' WHEN 4 THEN 'StockholdersEquity' ELSE 'DepreciationAndAmortization' END AS tag,
make_date(year(o_orderdate), 12, 31) AS "end", make_date(year(o_orderdate), 1, 1) AS "start", CAST(o_orderdate AS DATE) + 60 AS filed, o_totalprice AS val FROM orders)"""
_LINES = """pick AS (SELECT cik, "end", arg_max(val, (filed, -seq)) AS val, tag FROM facts GROUP BY cik, "end", tag),
lines AS (SELECT cik, "end", coalesce(max(val) FILTER (tag = 'Revenues'), max(val) FILTER (tag = 'SalesRevenueNet')) AS revenue, max(val) FILTER (tag = 'OperatingIncomeLoss') AS ebit, max(val) FILTER (tag = 'DepreciationAndAmortization') AS da,
max(val) FILTER (tag = 'NetIncomeLoss') AS net_income, max(val) FILTER (tag = 'StockholdersEquity') AS equity FROM pick GROUP BY cik, "end")"""


def _facts(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    tag = F.when(k == 0, "Revenues").when(k == 1, "SalesRevenueNet").when(k == 2, "OperatingIncomeLoss").when(k == 3, "NetIncomeLoss").when(k == 4, "StockholdersEquity").otherwise("DepreciationAndAmortization")
    year, day = F.year("o_orderdate"), F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("seq"), tag.alias("tag"), F.make_date(year, F.lit(12), F.lit(31)).alias("end"), F.make_date(year, F.lit(1), F.lit(1)).alias("start"),
        F.date_add(day, 60).alias("filed"), F.col("o_totalprice").alias("val"),
    )


@query(f"WITH {_FACTS}, {_LINES} SELECT cik, \"end\", round(revenue, 6) AS revenue, round(ebit, 6) AS ebit, round(ebit + da, 6) AS ebitda, round(net_income, 6) AS net_income, round(equity, 6) AS equity FROM lines")
def derived_lines(spark, sf_dir):
    """Lines by their tags from the last filings."""
    last = facts.latest_filed(facts.series(_facts(spark, sf_dir)), ["cik", "tag"])
    return comps.derived_lines(last, ["cik", "end"]).select("cik", "end", *(F.round(c, 6).alias(c) for c in ("revenue", "ebit", "ebitda", "net_income", "equity")))


@query(
    f"""WITH {_FACTS}, s AS (SELECT * FROM facts WHERE filed <= DATE '1997-06-30'), p AS (SELECT cik, max("end") AS "end" FROM facts WHERE filed <= DATE '1997-06-30' AND "end" <= DATE '1997-06-30' GROUP BY cik),
pick AS (SELECT cik, "end", tag, arg_max(val, (filed, -seq)) AS val FROM s JOIN p USING (cik, "end") GROUP BY cik, "end", tag),
l AS (SELECT cik, "end", coalesce(max(val) FILTER (tag = 'Revenues'), max(val) FILTER (tag = 'SalesRevenueNet')) AS revenue, max(val) FILTER (tag = 'OperatingIncomeLoss') AS ebit, max(val) FILTER (tag = 'DepreciationAndAmortization') AS da,
max(val) FILTER (tag = 'NetIncomeLoss') AS net_income FROM pick GROUP BY cik, "end"),
b AS (SELECT user_id AS cik, CAST(ts AS DATE) AS d, arg_max(value, event_id) AS close FROM events GROUP BY ALL),
q AS (SELECT c_custkey AS cik, arg_max(close, d) AS price FROM customer JOIN b ON cik = c_custkey AND d <= DATE '1997-06-30' AND d >= DATE '1997-06-15' GROUP BY c_custkey)
SELECT c_custkey AS cik, l."end" AS period, round(price * 1000, 4) AS market_cap, round(CASE WHEN net_income > 0 THEN price * 1000 / net_income END, 6) AS pe, round(CASE WHEN ebit + da > 0 THEN (price * 1000 + c_acctbal) / (ebit + da) END, 6) AS ev_ebitda
FROM customer LEFT JOIN l ON l.cik = c_custkey LEFT JOIN q ON q.cik = c_custkey"""
)
def company_records(spark, sf_dir):
    """A company's record as of a day: disclosed period, lines, price, shares, multiples (J9, J3, J5, W3, W5): events as prices."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_acctbal").alias("net_debt"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("cik"), F.col("ts").cast("date").alias("date"), "value", "event_id")
    bars = e.groupBy("cik", "date").agg(F.max_by("value", "event_id").alias("close"))
    shares = c.select("cik", F.lit("1990-01-01").cast("date").alias("end"), F.lit(1000.0).alias("n"))
    got = comps.company_records(c, _facts(spark, sf_dir), bars, shares, "1997-06-30")
    return got.select("cik", F.col("end").alias("period"), F.round("market_cap", 4).alias("market_cap"), F.round("pe", 6).alias("pe"), F.round("ev_ebitda", 6).alias("ev_ebitda"))


@query(
    """SELECT s_suppkey, n_nationkey AS cik, n_nationkey IS NULL AS unmatched FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'nowhere' WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE ' ' || n_name END AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)
LEFT JOIN nation ON upper(trim(t)) = n_name"""
)
def ticker_lookup(spark, sf_dir):
    """Filers by ticker, those without one said (J6): nations' names as tickers in any case."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cik"), F.col("n_name").alias("ticker"))
    s = read(spark, sf_dir, "supplier").join(F.broadcast(n.withColumnRenamed("ticker", "name")), F.col("s_nationkey") == F.col("cik"))  # 25 rows
    k = F.col("s_suppkey")
    asked = s.select("s_suppkey", F.when(k % 4 == 0, "nowhere").when(k % 2 == 0, F.lower("name")).otherwise(F.concat(F.lit(" "), "name")).alias("ticker"))
    return comps.with_filers(asked, n).select("s_suppkey", "cik", "unmatched")


@query(
    """WITH r AS (SELECT c_custkey AS id, c_nationkey % 3 AS m, c_acctbal AS ni, 50000.0 + c_custkey AS rev, c_acctbal / (50000.0 + c_custkey) AS op FROM customer), t AS (SELECT * FROM r WHERE id = 3),
u AS (SELECT 'op_margin' AS metric, r.op AS v, t.op AS t FROM r, t WHERE r.id <> 3 UNION ALL SELECT 'revenue_scale', r.rev, t.rev FROM r, t WHERE r.id <> 3 AND r.m = t.m)
SELECT metric, count(*) AS n, round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.75), 8) AS p75, count(*) >= 3 AS enough, round(max(t), 8) AS target,
round(avg(CASE WHEN v <= t THEN 1.0 ELSE 0.0 END), 8) AS share_at_or_below FROM u GROUP BY metric"""
)
def compare_with_peers(spark, sf_dir):
    """A company among its peers, by the metric tables and the market rule (H6, U6, U8, U9, P24): nations as markets."""
    c = read(spark, sf_dir, "customer")
    m = (F.col("c_nationkey") % 3).cast("string")
    rows = c.select(F.col("c_custkey").alias("cik"), m.alias("market"), m.alias("currency"), F.col("c_acctbal").alias("operating_income"), (F.lit(50000.0) + F.col("c_custkey")).alias("revenue"))
    got = comps.compare(rows.where("cik = 3"), rows, "cn", ["op_margin", "revenue_scale"])
    return got.select("metric", "n", *(F.round(x, 8).alias(x) for x in ("p25", "median", "p75")), "enough", F.round("target", 8).alias("target"), F.round("share_at_or_below", 8).alias("share_at_or_below"))


#: A supplier's balance sheet and income statement as a grid: a title, a header, rows with line numbers and figures.
_SHEET_ROWS = [("貨幣資金", "cash"), ("應收賬款", "accounts_receivable"), ("短期借款", "short_term_debt"), ("负债合计", "total_liabilities"), ("营业收入", "revenue"), ("杂项说明", None)]


def _cells(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    latest = F.when(F.col("s_suppkey") % 2 == 0, 2).otherwise(3)  # which column has the later year
    grid = [F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit("报表").alias("value"))]
    for c, v in ((0, F.lit("项目")), (1, F.lit("行次")), (2, F.when(latest == 2, "2023年12月31日").otherwise("2022年12月31日")), (3, F.when(latest == 2, "2022年12月31日").otherwise("2023年12月31日"))):
        grid.append(F.struct(F.lit(1).alias("r"), F.lit(c).alias("c"), v.alias("value")))
    for k, (label, _) in enumerate(_SHEET_ROWS):
        n = F.col("s_suppkey") * (k + 2)
        figure = F.concat(F.lit("("), n.cast("string"), F.lit(",000.5)")) if k == 2 else F.concat(n.cast("string"), F.lit(",000"))
        for c, v in ((0, F.lit(label)), (1, F.lit(str(k + 1))), (2, figure), (3, F.lit("—") if k == 1 else F.lit(str(k + 7)))):
            grid.append(F.struct(F.lit(k + 2).alias("r"), F.lit(c).alias("c"), v.alias("value")))
    return s.select(F.col("s_suppkey").alias("doc"), F.explode(F.array(*grid)).alias("g")).select("doc", "g.*")


@query(
    """SELECT s_suppkey AS doc, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 2000 ELSE 7 END AS DOUBLE) AS cash, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3000 END AS DOUBLE) AS accounts_receivable,
CAST(CASE WHEN s_suppkey % 2 = 0 THEN -(s_suppkey * 4000 + 0.5) ELSE 9 END AS DOUBLE) AS short_term_debt, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 5000 ELSE 10 END AS DOUBLE) AS total_liabilities, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 6000 ELSE 11 END AS DOUBLE) AS revenue FROM supplier"""
)
def statements_from_sheets(spark, sf_dir):
    """Statements of many workbooks: header, roles, numbers, labels in either script, fields (A14-A18, W20-W22, W28, F8, M1): sheets made from suppliers."""
    rows = loading.statement_rows(_cells(spark, sf_dir), ["doc"])
    return loading.document_fields(rows, "doc", [f for _, f in _SHEET_ROWS if f])


@query(
    """SELECT s_suppkey AS doc, 5 AS mapped, 6 AS "rows", round(5 / 6, 6) AS rate, 4 AS owned, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 3000 AS DOUBLE) END AS found FROM supplier"""
)
def mapping_coverage(spark, sf_dir):
    """Mapping rates, rows that belong to the statement, and a row by its words."""
    rows = loading.statement_rows(_cells(spark, sf_dir), ["doc"], F.lit("balance"))
    rates = statements.mapping_rates(rows, ["doc"]).select("doc", F.col("mapped").cast("int").alias("mapped"), F.col("rows").cast("int").alias("rows"), F.round("rate", 6).alias("rate"))
    owned = rows.groupBy("doc").agg(F.count_if("owned").cast("int").alias("owned"))
    found = loading.row_in(rows, "doc", "balance", ["應收"]).select("doc", F.col("value").alias("found"))
    return rates.join(owned, "doc").join(found, "doc", "left")


@query("SELECT s_suppkey AS doc, CAST(c AS INTEGER) AS c, c >= 1 AS numeric, c IN (1, 3) AS note FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS c)")
def column_kinds(spark, sf_dir):
    """Columns of numbers and of line numbers."""
    return loading.column_kinds(_cells(spark, sf_dir).where("r >= 2"), ["doc"])


@query("SELECT s_suppkey AS doc, '| 报表 |\n|---|\n| 项目 | 行次 | ' || CASE WHEN s_suppkey % 2 = 0 THEN '2023年12月31日 | 2022年12月31日' ELSE '2022年12月31日 | 2023年12月31日' END || ' |\n| 貨幣資金 | 1 | ' || s_suppkey * 2 || ',000 | 7 |' AS markdown FROM supplier")
def sheet_markdown(spark, sf_dir):
    """A grid in markdown."""
    return loading.markdown(_cells(spark, sf_dir).where("r <= 2"), ["doc"])


@query("SELECT l_orderkey, round(quantile_disc(l_quantity, 0.5), 6) AS median FROM lineitem GROUP BY l_orderkey")
def lower_medians(spark, sf_dir):
    """The lower middle value."""
    return loading.lower_median(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@query("SELECT l_orderkey, CAST(quantile_disc(CAST(round((1000 + l_partkey % 700) * 72 / l_quantity) AS INTEGER), 0.5) AS INTEGER) AS dpi FROM lineitem WHERE l_quantity * 40 / (50 * 40) >= 0.5 GROUP BY l_orderkey")
def image_resolution(spark, sf_dir):
    """The resolution of scanned pages by the images that cover them (A10): lines as images of an order's page."""
    q = F.col("l_quantity")
    images = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.lit(1000) + F.col("l_partkey") % 700).alias("width_px"), q.alias("width_pt"), F.lit(40.0).alias("height_pt"), F.lit(50.0).alias("page_width_pt"), F.lit(40.0).alias("page_height_pt"))
    return loading.image_resolution(images, ["l_orderkey"])


@query("SELECT event_id, arg_max(l, k) AS label FROM (SELECT a.event_id, b.event_id AS k, b.event_type AS l FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id <= a.event_id AND b.event_type IN ('signup', 'purchase')) GROUP BY event_id UNION ALL SELECT event_id, NULL FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE a.user_id = b.user_id AND b.event_id <= a.event_id AND b.event_type IN ('signup', 'purchase'))")
def carried_labels(spark, sf_dir):
    """Rows without a label take the last one before (W16): events of a user as rows of a page."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("label"))
    return layout.carry_labels(e, ["user_id"], "event_id").select("event_id", "label")


@query("WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS g FROM (SELECT DISTINCT user_id, value FROM events)) SELECT user_id, round(list_sort(list(g))[len(list(g)) // 2 + 1], 6) AS pitch FROM d WHERE g > 0.5 GROUP BY user_id")
def line_pitch(spark, sf_dir):
    """The usual distance of lines (W15): values of a user as places on a page."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("value").alias("y")).distinct()
    return layout.pitch(e, ["user_id"]).select("user_id", F.round("pitch", 6).alias("pitch"))


_AMOUNTS = "CASE o_orderkey % 5 WHEN 0 THEN concat('(', CAST(o_orderkey AS {t}), '.50)') WHEN 1 THEN '—' WHEN 2 THEN concat('1.', lpad(CAST(o_orderkey % 1000 AS {t}), 3, '0'), '.50') WHEN 3 THEN 'x1' ELSE CAST(o_orderkey % 900 AS {t}) END"


@query(
    f"""SELECT status, count(*) AS n, count(*) FILTER (k IN (0, 1, 2, 4)) AS amounts, count(*) FILTER (k = 4 AND v <= 400) AS line_numbers FROM (SELECT o_orderkey % 5 AS k, o_orderkey % 900 AS v, CASE o_orderkey % 5 WHEN 1 THEN 'dash' WHEN 2 THEN 'repaired' WHEN 3 THEN 'suspect' ELSE 'ok' END AS status FROM orders) GROUP BY status"""
)
def amount_statuses(spark, sf_dir):
    """How amounts were read, and which cells look like amounts or line numbers."""
    cells = read(spark, sf_dir, "orders").select(F.expr(_AMOUNTS.format(t="STRING")).alias("text"))
    t = F.col("text")
    seen = cells.groupBy(numbers.amount(t)["status"].alias("status")).agg(F.count_if(numbers.looks_like_amount(t)).alias("amounts"), F.count_if(numbers.row_number_like(t)).alias("line_numbers"))
    return layout.amount_statistics(cells, []).join(seen, "status")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def first_occurrence(spark, sf_dir):
    """The first row of each key."""
    return statements.first_occurrence(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query(
    """WITH x AS (SELECT c_custkey, CAST(c_custkey * 100 + 100 AS DOUBLE) AS rev, c_acctbal AS oi, CASE WHEN c_custkey % 3 = 0 THEN 0.0 WHEN c_custkey % 3 = 1 THEN 5.0 END AS n, CASE WHEN c_custkey % 2 = 0 THEN 7.0 END AS i FROM customer),
y AS (SELECT *, CAST(coalesce(nullif(n, 0.0), i, 11.0) AS DOUBLE) AS da FROM x)
SELECT c_custkey, da, round((oi + da) / rev, 6) AS ebitda_margin, round(da / rev, 8) AS da_share, c_custkey % 5 <> 0 AS minority_defaulted, CASE WHEN da / rev < 0.001 OR da / rev > 0.8 THEN 1 ELSE 0 END AS doubts, 'cfo' AS missing_keys, round(rev / 90 - 1, 8) AS growth FROM y"""
)
def statement_ratios(spark, sf_dir):
    """Derived figures of a statement: depreciation by source, margins, minority interest, doubts, missing fields, growth (G11, G15, G16, G21, G24, G44, P15, P17, P26): customers as companies."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", (k * 100 + 100).cast("double").alias("revenue"), F.col("c_acctbal").alias("operating_income"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 5.0).alias("n"), F.when(k % 2 == 0, 7.0).alias("i"), F.when(k % 5 == 0, 1.0).alias("minority_interest"))
    c = c.withColumn("da", derived.total_da(F.col("n"), F.col("i"), F.array(F.lit(4.0), F.lit(None).cast("double"), F.lit(7.0)))).withColumn("before", F.lit(90.0))
    c = derived.prefill(derived.missing_key_fields(derived.history_notes(derived.history(derived.minority_interest(c)))), "revenue", "before", "growth")
    doubts = F.size(F.filter("notes", lambda x: x.startswith("depreciation")))
    return c.select("c_custkey", "da", F.round("ebitda_margin", 6).alias("ebitda_margin"), F.round("da_share", 8).alias("da_share"), "minority_defaulted", doubts.alias("doubts"), F.array_join("missing_keys", ",").alias("missing_keys"), F.round("growth", 8).alias("growth"))


@query(
    """WITH x AS (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_linenumber = 1) AS rev, sum(CASE WHEN l_orderkey % 2 = 0 THEN -l_tax ELSE l_tax END) FILTER (l_linenumber > 1) AS cost, count(*) FILTER (l_linenumber > 1) AS n FROM lineitem GROUP BY l_orderkey)
SELECT x.l_orderkey, round(rev - abs(cost), 6) AS operating_income FROM x WHERE n > 0 AND (SELECT count(*) FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber > 1 AND y.l_tax > 0) = n"""
)
def operating_income_again(spark, sf_dir):
    """Operating income from its rows, costs signed either way (G25): an order's first line as revenue, the others' taxes as costs."""
    l = read(spark, sf_dir, "lineitem")
    clean = l.where("l_linenumber > 1").groupBy("l_orderkey").agg(F.min("l_tax").alias("least")).where("least > 0").select("l_orderkey")
    value = F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice")).when(F.col("l_orderkey") % 2 == 0, -F.col("l_tax")).otherwise(F.col("l_tax"))
    rows = l.join(clean, "l_orderkey", "left_semi").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "revenue").otherwise("cost").alias("role"), value.alias("value"))
    return checks_.operating_income_signs(rows, "l_orderkey").select("l_orderkey", F.round("operating_income", 6).alias("operating_income"))


@query(
    """WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey * 10 AS VARCHAR) END AS a, CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE '1,000' END AS b FROM customer WHERE c_custkey % 7 <> 0)
SELECT c_custkey, CASE WHEN i.c_custkey IS NULL THEN NULL WHEN a IS NOT NULL THEN CAST(a AS DOUBLE) WHEN b = 'true' THEN NULL ELSE 1000.0 END AS revenue, CAST(c_custkey AS DOUBLE) AS equity,
CASE WHEN i.c_custkey IS NULL THEN 'income not disclosed for the period' WHEN a IS NULL AND b = 'true' THEN 'not a number: true' END AS gap, CASE WHEN c_custkey % 5 = 0 THEN 'bank' ELSE 'general' END AS template FROM customer LEFT JOIN i USING (c_custkey)"""
)
def listed_records(spark, sf_dir):
    """Records of listed companies from landed rows, and their report template (A22-A24, D11, M4): customers as companies."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.lit("2023-12-31").alias("report_date"))
    text_of = lambda x: x.cast("string")
    income = c.where(k % 7 != 0).select("c_custkey", "report_date", F.map_filter(F.create_map(F.lit("TOTAL_OPERATE_INCOME"), F.when(k % 3 != 0, text_of(k * 10)), F.lit("OPERATE_INCOME"), F.when(k % 4 == 0, "true").otherwise("1,000")), lambda _, v: v.isNotNull()).alias("row"))
    balance = c.select("c_custkey", "report_date", F.create_map(F.lit("TOTAL_EQUITY"), text_of(k)).alias("row"))
    got = markets.cn_records(income, balance, "c_custkey")
    gap = F.get(F.filter(F.transform(F.filter("gaps", lambda g: g.startswith("revenue: ")), lambda g: F.substring(g, F.lit(10), F.length(g))), lambda g: g.isNotNull()), F.lit(0))
    suffixes = c.select("c_custkey", F.when(k % 5 == 0, F.array(F.lit("BBALANCE"))).otherwise(F.array(F.lit("BBALANCE"), F.lit("GBALANCE"))).alias("s"))
    template = markets.detect_template(suffixes.select("c_custkey", F.explode("s").alias("suffix")), "c_custkey")
    return got.join(template, "c_custkey").select("c_custkey", F.col("values")["revenue"]["value"].alias("revenue"), F.col("values")["equity"]["value"].alias("equity"), gap.alias("gap"), "template")


@query(
    """SELECT code, period, round(m, 6) AS net_margin FROM (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS period, o_totalprice / 1000 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS k FROM orders)
WHERE k <= 4 AND code NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1)"""
)
def indicator_history(spark, sf_dir):
    """The last periods of each company's indicators (A25, A26, K14): orders as periods, customers without two orders on a day."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("report_date"), F.create_map(F.lit("NET_PROFIT_RATIO"), (F.col("o_totalprice") / 1000).cast("string"), F.lit("EPS_TTM"), F.lit("")).alias("row"))
    twice = o.groupBy("code", "report_date").count().where("count > 1").select("code").distinct()
    got = markets.history(markets.hk_rows(o.join(twice, "code", "left_anti")), 4)
    return got.select("code", "period", F.round(F.col("fields")["net_margin"], 6).alias("net_margin"))


@query("SELECT 'Assets' AS tag, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, DATE '2023-12-31' AS \"end\", c_acctbal AS val FROM customer")
def tag_frames(spark, sf_dir):
    """One tag and period over all filers from landed JSON."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit('{"tag":"Assets","data":[{"cik":'), F.col("c_custkey").cast("string"), F.lit(',"end":"2023-12-31","val":'), F.col("c_acctbal").cast("string"), F.lit(',"accn":"x"}]}')).alias("value"))
    return markets.frames(c).select("tag", "cik", "end", "val")


@query(
    """SELECT o_orderkey AS code, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderkey % 90 + 1 AS DOUBLE) END AS close FROM orders WHERE o_orderkey % 3 <> 2"""
)
def bar_shapes(spark, sf_dir):
    """Price rows of several sources in the common form, bad ones dropped."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"), F.col("o_orderdate").cast("date").cast("string").alias("d"), (F.col("o_orderkey") % 90 + 1).cast("string").alias("p"), (F.col("o_orderkey") % 3).alias("k"))
    objects = o.where("k = 0").select("code", F.concat(F.lit('{"day":"'), "d", F.lit('","open":"1","close":"'), "p", F.lit('","high":"9","low":"1"}')).alias("value"))
    lists = o.where("k = 1").select("code", F.concat(F.lit('["'), "d", F.lit('","1","'), "p", F.lit('","9","1","5"]')).alias("value"))
    short = o.where("k = 2").select("code", F.concat(F.lit('["'), "d", F.lit('","1"]')).alias("value"))
    rows = markets.bars_from_objects(objects).unionByName(markets.bars_from_lists(lists.unionByName(short)))
    return files.parse_bars(rows, ["code"]).select("code", "date", "close")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN make_date(year(o_orderdate), 6, 30) ELSE make_date(year(o_orderdate), 12, 31) END AS report_date, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, 'AB,C.D,X' AS tickers,
CAST(length(o_orderpriority) AS BIGINT) AS "bytes", substr(sha256(o_orderpriority), 1, 16) AS sha16, trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, round(o_orderkey / 1000, 8) AS percent FROM orders"""
)
def code_forms(spark, sf_dir):
    """Report dates, day spans, ticker lists, digests, slugs and percentages of bare numbers."""
    o = read(spark, sf_dir, "orders")
    raw = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "-06-30").otherwise("1231"))
    d = text.digest(F.col("o_orderpriority"))
    percent = numbers.percent_number(numbers.as_percent_text((F.col("o_orderkey") / F.lit(10.0)).cast("decimal(20,1)").cast("string")))
    return o.select(
        "o_orderkey", identifiers.strict_report_date(raw).alias("report_date"), identifiers.days_between(F.lit("1992-01-01"), F.col("o_orderdate").cast("date")).alias("days"), F.array_join(identifiers.ticker_list(F.lit("ab, c.d；x ")), ",").alias("tickers"),
        d["bytes"].alias("bytes"), d["sha16"].alias("sha16"), text.slug(F.col("o_orderpriority")).alias("slug"), F.round(percent, 8).alias("percent"),
    )


_NOTICE = """concat(CASE p_partkey % 3 WHEN 0 THEN '合并' WHEN 1 THEN '母公司' ELSE '' END, ' 单位：', CASE p_partkey % 4 WHEN 0 THEN '万元' WHEN 1 THEN '人民币千元' WHEN 2 THEN '元' ELSE '-' END, CASE WHEN p_partkey % 5 = 0 THEN ' 港元' ELSE '' END)"""


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'parent' ELSE 'single' END AS scope, CASE p_partkey % 4 WHEN 0 THEN 1e4 WHEN 1 THEN 1e3 WHEN 2 THEN 1.0 END::DOUBLE AS scale,
CASE WHEN p_partkey % 4 = 1 THEN 'CNY' WHEN p_partkey % 5 = 0 THEN 'HKD' WHEN p_partkey % 4 <> 3 THEN 'CNY' END AS currency FROM part"""
)
def scope_and_unit(spark, sf_dir):
    """What a page says of scope, unit and currency."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.expr(_NOTICE).alias("t"))
    u = text.unit(F.col("t"))
    return p.select("p_partkey", text.scope(F.col("t")).alias("scope"), u["scale"].alias("scale"), u["currency"].alias("currency"))


@query("SELECT o_orderkey, abs(o_totalprice - (o_totalprice + o_orderkey % 4)) <= greatest(abs(o_totalprice) * 1e-5, 1.0) AS same, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS finite FROM orders")
def near_equality(spark, sf_dir):
    """Equality within a relative tolerance, and infinities as missing."""
    v = F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.close_to(F.col("o_totalprice"), F.col("o_totalprice") + F.col("o_orderkey") % 4, 1e-5).alias("same"), numbers.finite(v).alias("finite"))


@query(
    """WITH c AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page, o_orderkey AS k FROM orders)
SELECT doc, k, page AS first, lead(page) OVER (PARTITION BY doc ORDER BY page) - 1 AS last FROM c"""
)
def contents_ranges(spark, sf_dir):
    """Page ranges from a table of contents (W26): a customer's orders as entries."""
    from pyspark.sql.window import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), page.alias("page"))
    return notes.statement_ranges(o, "doc", kind="k")


@query(
    """WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 4 AS k FROM orders),
r AS (SELECT a.doc, a.page FROM p a WHERE k = 0 UNION SELECT b.doc, b.page FROM p a JOIN p b ON a.doc = b.doc AND b.page = a.page + 1 WHERE a.k = 0 AND b.k IN (0, 1)
UNION SELECT c.doc, c.page FROM p a JOIN p b ON a.doc = b.doc AND b.page = a.page + 1 JOIN p c ON a.doc = c.doc AND c.page = a.page + 2 WHERE a.k = 0 AND b.k IN (0, 1) AND c.k IN (0, 1))
SELECT doc, CAST(page AS INTEGER) AS page FROM r"""
)
def note_pages(spark, sf_dir):
    """Pages of the reconciliation and those that go on with it (P29, W19): a customer's orders as pages."""
    from pyspark.sql.window import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.col("o_orderkey") % 4
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), F.when(k == 0, "现金流量表补充资料").when(k == 1, "续 净利润").otherwise("其他").alias("text"))
    return notes.reconciliation_pages(o, "doc", "page").select("doc", "page")


@query(
    """WITH r AS (SELECT user_id AS model, CAST(ts AS DATE) AS run, count(*) FILTER (value > 50) AS passed, count(*) AS total FROM events GROUP BY ALL)
SELECT model, min(passed) AS passed FROM r GROUP BY model"""
)
def worst_rounds(spark, sf_dir):
    """A model counts by its worst round (G41, T5): a user's days as rounds."""
    r = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("model"), F.col("ts").cast("date").alias("run")).agg(F.count_if(F.col("value") > 50).alias("passed"), F.count(F.lit(1)).alias("total"))
    return recipes.worst_round(r, ["model"]).select("model", "passed")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_runs(spark, sf_dir):
    """The last file of each model counts."""
    return recipes.last_per_model(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ocr ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN ' ' ELSE 'own' END AS text, o_orderkey % 3 = 0 AS from_ocr, bool_and(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS scanned FROM orders"""
)
def blank_pages(spark, sf_dir):
    """Blank pages filled from the OCR cache, and documents that are scans throughout (A9, P20): orders as pages."""
    k = F.col("o_orderkey")
    pages = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 == 2, "own").otherwise(" ").alias("text"))
    ocr = pages.where(k % 3 != 1).select("o_orderkey", F.concat(F.lit("ocr "), k.cast("string")).alias("text"))
    filled = documents.fill_blank_pages(pages, ocr, ["o_orderkey"])
    return filled.join(documents.scan_advisory(filled, "o_custkey"), "o_custkey").select("o_orderkey", "text", "from_ocr", "scanned")


@query("SELECT s_suppkey, s_name || '有限公司' AS company, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS code FROM supplier")
def cover_facts(spark, sf_dir):
    """Company and code on the cover (A45, F20, F21): covers made from suppliers."""
    k = F.col("s_suppkey")
    code = F.when(k % 2 == 0, F.concat(F.lit("股票代码： "), F.lpad(k.cast("string"), 6, "0"))).otherwise("无")
    first = read(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("page"), F.concat(F.lit("某集团\n"), "s_name", F.lit("有限公司\n年度报告")).alias("text"))
    second = read(spark, sf_dir, "supplier").select("s_suppkey", F.lit(2).alias("page"), code.alias("text"))
    return notes.cover_facts(first.unionByName(second), "s_suppkey")


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS valid FROM orders")
def parameter_checks(spark, sf_dir):
    """Values that may go out as parameters (P10)."""
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, "600519").when(k % 4 == 1, "AAPL").when(k % 4 == 2, "a\nb").otherwise(F.repeat(F.lit("x"), 65))
    return read(spark, sf_dir, "orders").select("o_orderkey", overlap.valid_parameter(v).alias("valid"))


@query(
    """WITH f AS (SELECT l_orderkey, l_partkey, min(CAST(l_shipdate AS DATE)) AS first_filed FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_partkey, first_filed FROM f"""
)
def first_filings(spark, sf_dir):
    """When each period was first disclosed."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("end"), F.col("l_shipdate").cast("date").alias("filed"))
    return facts.first_filed(l, ["l_orderkey"]).select("l_orderkey", F.col("end").alias("l_partkey"), "first_filed")


@query(
    """SELECT cik, "end", val, tag AS tag_used FROM (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS "end", o_totalprice AS val, o_orderpriority AS tag, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS k
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30') WHERE k = 1"""
)
def nearest_instants(spark, sf_dir):
    """The last balance by a date over several tags, the first listed of equal dates (J2, J3, J22, P3): priorities as tags."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("tag"), F.lit(None).cast("date").alias("start"), F.col("o_orderdate").cast("date").alias("end"), F.col("o_totalprice").alias("val"), F.lit("1990-01-01").alias("filed"), F.col("o_orderkey").alias("seq"))
    return facts.nearest_instant(o, ["cik"], ["1-URGENT", "2-HIGH"], F.lit("1996-06-30").cast("date"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS label, p_partkey % 4 < 2 AS derivable, CASE p_partkey % 4 WHEN 2 THEN 'no debt or no cash row' WHEN 3 THEN 'no balance sheet' END AS net_debt_reason FROM part")
def label_and_debt_gates(spark, sf_dir):
    """Labels that may head a row, and whether statements give net debt."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, "货币资金").when(k % 3 == 1, "其中：").otherwise("资金2").alias("t"), F.when(k % 4 < 2, 1.0).alias("net_debt"), F.when(k % 4 != 3, 1.0).alias("cash"))
    return loading.net_debt_derivable(p).select("p_partkey", loading.plausible_label(F.col("t")).alias("label"), "derivable", "net_debt_reason")


@query(
    """WITH w AS (SELECT l_orderkey AS page, l_linenumber AS y, l_suppkey AS x0, l_partkey AS seq, 'w' || l_partkey AS text FROM lineitem), d AS (SELECT page, y, dense_rank() OVER (PARTITION BY page ORDER BY y) - 1 AS line FROM (SELECT DISTINCT page, y FROM w))
SELECT page, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY x0, seq, text) AS text FROM w JOIN d USING (page, y) GROUP BY page, line"""
)
def page_lines(spark, sf_dir):
    """Words to visual lines (W13, F31): an order's lines as words, some a little lower than others."""
    top = F.col("l_linenumber") * 10.0 + (F.col("l_partkey") % 2)
    w = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("seq"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_suppkey").cast("double").alias("x0"), top.alias("top"), (top + 8).alias("bottom"))
    return layout.line_texts(w, ["page"]).select("page", "line", "text")


@query("SELECT s_suppkey AS sheet, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS \"current\", CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS prior FROM supplier")
def grid_roles(spark, sf_dir):
    """Which column holds which period, by dates or by words (W21): headers made from suppliers."""
    k = F.col("s_suppkey")
    first = F.when(k % 3 == 0, "期末余额").when(k % 2 == 0, "2022年12月31日").otherwise("2023年12月31日")
    second = F.when(k % 3 == 0, "期初余额").when(k % 2 == 0, "2023年12月31日").otherwise("2022年12月31日")
    cells = F.array(*(F.struct(F.lit(c).alias("c"), v.alias("value")) for c, v in ((0, F.lit("项目")), (1, first), (2, second))))
    h = read(spark, sf_dir, "supplier").select(k.alias("sheet"), F.explode(cells).alias("x")).select("sheet", "x.*")
    return layout.column_roles(h, ["sheet"])


@query(
    """SELECT s_suppkey AS page, 'cash' AS label, 'a' || s_suppkey AS amount FROM supplier UNION ALL SELECT s_suppkey, 'debt', CASE WHEN s_suppkey % 2 = 0 THEN 'b' END FROM supplier UNION ALL SELECT s_suppkey, 'tax', 'c' FROM supplier"""
)
def label_pairing(spark, sf_dir):
    """Labels with their nearest amounts, each amount once (J18): pages made from suppliers."""
    k = F.col("s_suppkey")
    rows = [(10.0, "cash", None), (11.0, None, F.concat(F.lit("a"), k.cast("string"))), (20.0, "debt", None), (F.when(k % 2 == 0, 21.0).otherwise(45.0), None, F.lit("b")), (30.0, "tax", None), (29.5, None, F.lit("c"))]
    cells = F.array(*(F.struct((y if not isinstance(y, float) else F.lit(y)).alias("y"), F.lit(label).cast("string").alias("label"), (F.lit(None).cast("string") if v is None else v).alias("amount")) for y, label, v in rows))
    return layout.pair_labels(read(spark, sf_dir, "supplier").select(k.alias("page"), F.explode(cells).alias("x")).select("page", "x.*"), ["page"])


@query(
    """SELECT s_suppkey, 1 AS table_no, CAST(r AS INTEGER) AS row_no, CAST(c AS INTEGER) AS col_no, CASE c * 10 + r WHEN 1 THEN s_name WHEN 11 THEN '$' WHEN 21 THEN '(' || s_suppkey WHEN 31 THEN ')' ELSE CAST(s_suppkey * 7 AS VARCHAR) END AS "text", CASE WHEN r = 2 THEN 'us-gaap_Assets' END AS tag
FROM supplier, (VALUES (1, 0), (1, 1), (1, 2), (1, 3), (2, 1)) AS v(r, c)"""
)
def html_cells(spark, sf_dir):
    """Cells of HTML tables on their grid, with spans and tags (A5, A6, Q7): filings made from suppliers."""
    from ..sources import html

    k = F.col("s_suppkey").cast("string")
    page = F.concat(
        F.lit("<html><style>td{}</style><table><tr><td rowspan=2><b>"), F.col("s_name"), F.lit("</b></td><td>$</td><td>("), k, F.lit("</td><td>)</td></tr><tr><td><a class='defref_us-gaap_Assets'>"), (F.col("s_suppkey") * 7).cast("string"), F.lit("</a></td></tr></table>")
    )
    return html.extract_tables(read(spark, sf_dir, "supplier").select("s_suppkey", page.alias("html")), "s_suppkey")
