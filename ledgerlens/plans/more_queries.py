"""Queries over inline inputs: sources, notes, derived figures, recipes and reports, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import checks, derived, facts, notes, peers, recipes, reports, retrieval, statements
from ..operators import valuation as v

from .fixture import Fixture, Repeated, Spread
from .fixture_queries import MULTIPLES, PLANS
from .table_queries import SQL, query, read

BALANCES = Spread(Fixture(
    "id int, short_term_debt double, long_term_debt double, cash double, short_term_investments double, total_liabilities double, accounts_payable double",
    [(1, 50.0, 200.0, 80.0, None, 400.0, 100.0), (2, None, None, 70.0, 5.0, 300.0, 300.0), (3, None, 10.0, 70.0, 5.0, 300.0, 200.0), (4, 0.0, 0.0, None, None, 9.0, 9.0)],
))


@query(
    f"""WITH s AS (SELECT *, short_term_debt IS NOT NULL AND long_term_debt IS NOT NULL AS full_, coalesce(abs(total_liabilities - coalesce(accounts_payable, 0)) <= greatest(abs(total_liabilities) * 1e-6, 1), false) AS rec FROM {BALANCES.sql()})
SELECT id, CASE WHEN full_ AND (short_term_debt <> 0 OR long_term_debt <> 0 OR coalesce(cash, 0) <> 0 OR coalesce(short_term_investments, 0) <> 0) THEN short_term_debt + long_term_debt - coalesce(cash, 0) - coalesce(short_term_investments, 0)
WHEN NOT full_ AND rec AND (coalesce(cash, 0) <> 0 OR coalesce(short_term_investments, 0) <> 0) THEN 0.0 - coalesce(cash, 0) - coalesce(short_term_investments, 0) END AS net_debt FROM s"""
)
def statement_net_debt(spark, sf_dir):
    """Net debt from a balance sheet, zero debt only where shown."""
    return derived.statement_net_debt(BALANCES.frame(spark, sf_dir)).select("id", "net_debt")


YEARS = Spread(Fixture("id int, revenue double, operating_income double, da double, capex double, accounts_receivable double, inventory double, accounts_payable double, total_current_assets double", [(1, 1000.0, 150.0, 50.0, -80.0, 200.0, None, 90.0, 500.0), (2, 1000.0, None, 950.0, 10.0, 700.0, 5.0, 90.0, 500.0), (3, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None)]))


@query(
    f"""SELECT id, round((operating_income + da) / nullif(revenue, 0), 6) AS ebitda_margin, round(da / nullif(revenue, 0), 6) AS da_share, round(abs(capex) / nullif(revenue, 0), 6) AS capex_share,
round((accounts_receivable + coalesce(inventory, 0) - accounts_payable) / nullif(revenue, 0), 6) AS nwc_share FROM {YEARS.sql()}"""
)
def history_ratios(spark, sf_dir):
    """Ratios of the past year."""
    return derived.history(YEARS.frame(spark, sf_dir)).select("id", *(F.round(c, 6).alias(c) for c in ("ebitda_margin", "da_share", "capex_share", "nwc_share")))


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN revenue <> 0 AND NOT da / revenue BETWEEN 0.001 AND 0.8 THEN 'depreciation out of proportion to revenue' END, CASE WHEN inventory IS NULL AND accounts_receivable IS NOT NULL THEN 'working capital without inventory' END,
CASE WHEN abs(accounts_receivable) > abs(total_current_assets) * 1.02 THEN 'receivables above current assets' END, CASE WHEN abs(inventory) > abs(total_current_assets) * 1.02 THEN 'inventory above current assets' END], lambda x: x IS NOT NULL), '; ') AS notes FROM {YEARS.sql()}"""
)
def history_doubts(spark, sf_dir):
    """Doubts about the ratios."""
    return derived.history_notes(YEARS.frame(spark, sf_dir)).select("id", F.array_join("notes", "; ").alias("notes"))


CANDIDATES = Repeated(Fixture("path string, kind string, mapped int, rate double, statements int", [("a", "pdf", 12, 0.5, 3), ("b", "pdf", 12, 0.7, 2), ("c", "pdf", 40, 0.9, 1), ("d", "excel", 8, 0.2, 2), ("e", "html", 7, 0.9, 3)]), ('path', 'kind'))


@query(f"SELECT kind, arg_max(path, (mapped, rate)) AS path FROM {CANDIDATES.sql()} WHERE mapped >= 8 AND statements >= 2 GROUP BY kind")
def best_files(spark, sf_dir):
    """The best file of each kind."""
    return derived.best_candidates(CANDIDATES.frame(spark, sf_dir)).select("kind", "path")


GIVEN = Repeated(Fixture("id int, wacc double, tax double", [(1, 0.1, None), (2, None, None)]), ('id',))
KNOWN = Repeated(Fixture("id int, wacc double, tax double", [(1, 0.2, 0.25)]), ('id',))


@query(
    f"""SELECT g.id, coalesce(g.wacc, k.wacc) AS wacc, CASE WHEN g.wacc IS NOT NULL THEN 'given' WHEN k.wacc IS NOT NULL THEN 'statements' ELSE 'missing' END AS wacc_source, coalesce(g.tax, k.tax) AS tax,
CASE WHEN g.tax IS NOT NULL THEN 'given' WHEN k.tax IS NOT NULL THEN 'statements' ELSE 'missing' END AS tax_source FROM {GIVEN.sql()} g LEFT JOIN {KNOWN.sql()} k ON g.id = k.id"""
)
def config_fill(spark, sf_dir):
    """Facts only where a configuration has nothing."""
    return derived.fill_absent(GIVEN.frame(spark, sf_dir), KNOWN.frame(spark, sf_dir), "id", ["wacc", "tax"])


_LINES = [*notes.RECON_START, *notes.RECON_TARGET, *notes.DA_LINES, *notes.OTHER_LINES]


def _pages(of: str) -> str:
    """A page of a reconciliation made from an order: its lines in a row, each with a figure, some left out or negative."""
    parts = []
    for k, label in enumerate(_LINES):
        figure = f"CAST(o_orderkey * {k + 3} % 900 AS {of})"
        text = f"concat('{label} ', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '－' ELSE '(' END, {figure}, ',', lpad(CAST(o_orderkey * {k + 7} % 1000 AS {of}), 3, '0'), CASE WHEN o_orderkey % 3 = 2 THEN ')' ELSE '.50' END, ' ')"
        parts.append(text if k < 2 else f"CASE WHEN (o_orderkey + {k}) % 4 < 2 THEN {text} ELSE '' END")
    return f"concat({', '.join(parts)})"


def _sql_amount(k: int) -> str:
    sign = "CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE -1 END"
    return f"{sign} * (CAST(o_orderkey * {k + 3} % 900 AS DOUBLE) * 1000 + o_orderkey * {k + 7} % 1000 + CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE 0.5 END)"


def _sql_sum(first: int, end: int) -> str:
    return " + ".join(f"CASE WHEN (o_orderkey + {k}) % 4 < 2 THEN {_sql_amount(k)} ELSE 0 END" for k in range(first, end))


_DA_END = 2 + len(notes.DA_LINES)


@query(
    f"""WITH x AS (SELECT o_orderkey, {_sql_amount(0)} AS net, {_sql_amount(1)} AS cfo, {_sql_sum(2, _DA_END)} AS da, {_sql_sum(2, len(_LINES))} AS lines FROM orders)
SELECT o_orderkey, round(da, 2) AS da, round(net + lines - cfo, 2) AS diff, abs(net + lines - cfo) <= greatest(1.0, abs(cfo) * 0.0005) AS ok FROM x"""
)
def note_depreciation(spark, sf_dir):
    """Depreciation from the notes, and how the reconciliation holds (F24, G22, V8): pages made from orders."""
    t, lines = F.col("t"), F.col("lines")
    pages = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_pages("STRING")).alias("t")).withColumn("lines", notes.reconciling_lines(t))
    total = F.aggregate(F.map_values(notes.depreciation(t, lines)), F.lit(0.0), lambda a, x: a + x)
    held = pages.select("o_orderkey", F.round(total, 2).alias("da"), notes.reconcile(t, lines).alias("r"))
    return held.select("o_orderkey", "da", F.round("r.diff", 2).alias("diff"), "r.ok")


_PROFILE = """concat('发行概况 发行股数 的比例为 10% 本次发行股数 ', CASE WHEN c_custkey % 2 = 0 THEN '共 9 股, 不超过 ' ELSE '' END, CAST(c_custkey AS {t}), ',500 ', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '万' END, '股 每股面值 1.00 元 每股发行价格 ',
CASE WHEN c_custkey % 5 = 0 THEN '【】' ELSE CAST(c_custkey % 40 + 1 AS {t}) END, ' 元 ', repeat('填', 90), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' 发行后总股本 90,000 万股' END)"""


@query(
    """SELECT c_custkey, issued, CASE WHEN c_custkey % 7 <> 0 THEN 900000000.0 - issued END AS before, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 40 + 1 AS DOUBLE) END AS price
FROM (SELECT c_custkey, (c_custkey * 1000 + 500) * CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 10000.0 END AS issued FROM customer)"""
)
def share_structure(spark, sf_dir):
    """Shares of a prospectus (F22, F23): profile pages made from customers."""
    pages = read(spark, sf_dir, "customer").select("c_custkey", notes.share_structure(F.expr(_PROFILE.format(t="STRING"))).alias("s"))
    return pages.select("c_custkey", "s.issued", "s.before", "s.price")


QUESTIONS = Repeated(Fixture("key string, seq int", [("tax", 1), ("wacc", 2), ("x", 3), ("growth", 4)]), ('seq',))
DONE = Fixture("key string", [("tax",)])


@query(f"SELECT key, seq, CASE key WHEN 'growth' THEN 0 WHEN 'wacc' THEN 1 ELSE 2 END AS impact FROM {QUESTIONS.sql()} WHERE key NOT IN (SELECT key FROM {DONE.sql()})")
def open_questions(spark, sf_dir):
    """What is still to be answered, most impact first."""
    return recipes.question_plan(QUESTIONS.frame(spark, sf_dir), DONE.frame(spark), ["growth", "wacc"])


@query(
    """WITH s AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, CAST(contains(t, 'the ') AS INTEGER) + CAST(contains(t, ' of ') AS INTEGER) AS a, CAST(contains(t, 'license') AS INTEGER) AS b, CAST(contains(t, 'idiot') AS INTEGER) + CAST(contains(t, 'scum') AS INTEGER) AS c FROM s)
SELECT doc_id, CASE WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT >= 2 THEN 100 * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) + a + b + c ELSE 0 END AS score FROM h"""
)
def keyword_evidence(spark, sf_dir):
    """Scores by groups of keywords."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return statements.page_scores(docs, {"score": [["the ", " of "], ["license"], ["idiot", "scum"]]}).select("doc_id", "score")


@query(
    f"""SELECT 'e' || id AS entity, 'multiples' AS method, round(CASE WHEN metric > 0 THEN (metric * multiple_mid - net_debt - coalesce(minority_interest, 0)) * (1 - coalesce(dlom, 0)) END, 4) AS mid,
CAST(metric <= 0 OR net_debt IS NULL AS INTEGER) AS n FROM {MULTIPLES.sql()}"""
)
def appraisal(spark, sf_dir):
    """Results of methods in one schema, reasons kept."""
    plans = PLANS.frame(spark, sf_dir).withColumn("entity", F.concat(F.lit("e"), "id"))
    found = reports.appraise(plans, MULTIPLES.frame(spark, sf_dir).withColumn("entity", F.concat(F.lit("e"), "id")))
    return found.where("method = 'multiples'").select("entity", "method", F.round("mid", 4).alias("mid"), F.size("notes").alias("n"))


_FACTS = json.dumps({"cik": 320193, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-12-31", "val": 5, "filed": "2021-02-01"}, {"end": "oops", "val": 1, "filed": "2021-02-01"}]}}}}})


GAPS = Repeated(Fixture("id int, gap double", [(1, 100.0), (2, 7.0)]), ('id',))
LINES = Repeated(Fixture("id int, stmt_order int, row_no int, label string, value double", [(1, 2, 1, "tax", 101.0), (1, 1, 5, "fees", -100.0), (1, 1, 9, "late", 100.0)]), ('id',))


@query(f"SELECT g.id, gap, arg_min(label, stmt_order * 1000 + row_no) AS explained_by FROM {GAPS.sql()} g LEFT JOIN {LINES.sql()} l ON g.id = l.id AND abs(abs(value) - abs(gap)) <= greatest(abs(gap) * 0.02, 1) GROUP BY g.id, gap")
def gap_attribution(spark, sf_dir):
    """The row that explains a difference."""
    return checks.attribute_gap(LINES.frame(spark, sf_dir), GAPS.frame(spark, sf_dir), "id")


TAGGED = Repeated(Fixture("cik string, tag string, val double", [("1", "LongTermDebtCurrent", 5.0), ("1", "ShortTermBorrowings", 7.0), ("1", "CashAndCashEquivalentsAtCarryingValue", 1.0), ("2", "LongTermDebt", 9.0), ("2", "LongTermDebtNoncurrent", 8.0), ("3", "LongTermDebt", 20.0), ("3", "LongTermDebtCurrent", 6.0), ("3", "CashAndCashEquivalentsAtCarryingValue", 2.0), ("3", "MarketableSecuritiesCurrent", 3.0), ("4", "ShortTermInvestments", 1.0), ("4", "CashAndCashEquivalentsAtCarryingValue", 4.0)]), ('cik',))


_TAG_ORDER = {k: ", ".join(f"max(val) FILTER (tag = '{t}')" for t in tags) for k, tags in facts.NET_DEBT_PARTS.items()}


@query(
    f"""WITH p AS (SELECT cik, {", ".join(f"coalesce({tags}) AS {k}" for k, tags in _TAG_ORDER.items())} FROM {TAGGED.sql()} GROUP BY cik)
SELECT cik, CASE WHEN cash IS NOT NULL AND coalesce(total_debt, current_debt, noncurrent_debt, finance_lease) IS NOT NULL THEN coalesce(total_debt, coalesce(current_debt, 0) + coalesce(noncurrent_debt, 0)) + coalesce(finance_lease, 0) - cash - coalesce(short_investments, 0) END AS net_debt,
CASE WHEN cash IS NULL THEN 'no cash' WHEN coalesce(total_debt, current_debt, noncurrent_debt, finance_lease) IS NULL THEN 'no debt item' END AS gap FROM p"""
)
def net_debt_by_tags(spark, sf_dir):
    """Net debt from tagged facts, all concepts in one pass."""
    return facts.net_debt(facts.pivot_concepts(TAGGED.frame(spark, sf_dir), ["cik"], facts.NET_DEBT_PARTS)).select("cik", "net_debt", "gap")


HK = Repeated(Fixture("code string, metric string, value double", [("00700", "roe", 20.0), ("00700", "pe", 15.0)]), ('code',))


@query(f"SELECT code, CASE WHEN metric = 'pe' THEN value ELSE value / 100 END AS value, metric FROM {HK.sql()}")
def percent_figures(spark, sf_dir):
    """Percent figures as shares of one, multiples as they are."""
    m = HK.frame(spark, sf_dir).groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("f"))
    return peers.percent_fields(m, "f", ["pe"]).select("code", F.explode("f").alias("metric", "value"))


@query(SQL["bm25_topk"].replace("['worthless', 'thing', 'of', 'the', 'station']", "['营业收入', 'worthless', 'thing', 'revenue', 'net', 'sales']").replace("doc_id, round(", "doc_id AS chunk_id, round(").replace("ORDER BY score DESC, doc_id", "ORDER BY score DESC, chunk_id"))
def ask(spark, sf_dir):
    """Passages for a question in two languages (H1, J13, K1): its term adds the other language's words."""
    return recipes.ask(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "营业收入 worthless thing").select("chunk_id", F.round("score", 6).alias("score"))


BETAS = Spread(Fixture("id int, beta double, debt double, equity double, tax double", [(1, 1.2, 30.0, 70.0, 0.25), (2, 1.0, 5.0, 0.0, 0.2)]))


@query(f"SELECT id, round(CASE WHEN equity > 0 THEN beta / (1 + (1 - tax) * debt / equity) END, 6) AS unlevered FROM {BETAS.sql()}")
def unlevered_beta(spark, sf_dir):
    """Beta without leverage."""
    c = F.col
    return BETAS.frame(spark, sf_dir).select("id", F.round(v.unlever(c("beta"), c("debt"), c("equity"), c("tax")), 6).alias("unlevered"))


@query(
    r"""SELECT conv_id, turn, lower(regexp_replace(text, '[\s　，。、；：？！“”‘’（）《》【】,.;:?!"''()\[\]{}<>\-—_/\\|*#]+', '', 'g')) AS norm FROM conversations"""
)
def overlap_form(spark, sf_dir):
    """The form in which texts are compared."""
    from ..functions import text

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.overlap_form(F.col("text")).alias("norm"))


@query("SELECT conv_id, turn, 'S' || row_number() OVER (ORDER BY conv_id, turn, text) AS chunk_id FROM conversations")
def chunk_ids(spark, sf_dir):
    """Chunks numbered over the corpus (A3)."""
    return retrieval.numbered(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
