"""Queries over small inline inputs: valuation models, checks, parsing and mapping, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, numbers
from ..operators import asof, checks, early_stage, facts
from ..operators import valuation as v
from .fixture import Fixture, Repeated, Spread
from .table_queries import query, read

RATES = Spread(Fixture(
    "id int, risk_free double, equity_premium double, beta_unlevered double, tax_rate double, cost_of_debt double, debt double, equity double, size_premium double",
    [(1, 0.025, 0.06, 0.9, 0.25, 0.045, 3000.0, 7000.0, 0.0168), (2, 0.03, 0.055, 1.2, 0.2, 0.05, 0.0, 5000.0, None), (3, 0.03, 0.055, None, 0.2, 0.05, 100.0, 900.0, 0.01)],
))


@query(
    f"""SELECT id, round(bl, 6) AS beta_levered, round(re, 6) AS cost_of_equity, round(equity / (debt + equity) * re + debt / (debt + equity) * cost_of_debt * (1 - tax_rate), 6) AS wacc, CASE WHEN beta_unlevered IS NULL THEN 'beta_unlevered' ELSE '' END AS gaps
FROM (SELECT *, risk_free + bl * equity_premium + coalesce(size_premium, 0) AS re FROM (SELECT *, beta_unlevered * (1 + (1 - tax_rate) * debt / equity) AS bl FROM {RATES.sql()}))"""
)
def wacc(spark, sf_dir):
    """Cost of capital with missing inputs named."""
    return v.wacc(RATES.frame(spark, sf_dir)).select("id", *(F.round(c, 6).alias(c) for c in ("beta_levered", "cost_of_equity", "wacc")), F.array_join("gaps", ",").alias("gaps"))


@query(
    f"""SELECT id, d AS delta, round(equity / (debt + equity) * re + debt / (debt + equity) * cost_of_debt * (1 - tax_rate) + d, 6) AS wacc FROM (SELECT *, risk_free + beta_unlevered * (1 + (1 - tax_rate) * debt / equity) * equity_premium + coalesce(size_premium, 0) AS re FROM {RATES.sql()}),
(SELECT unnest([CAST(-0.02 AS DOUBLE), -0.01, 0.0, 0.01, 0.02]) AS d)"""
)
def wacc_sensitivity(spark, sf_dir):
    """Cost of capital shifted up and down."""
    return v.wacc_grid(v.wacc(RATES.frame(spark, sf_dir)), [-0.02, -0.01, 0.0, 0.01, 0.02]).select("id", "delta", F.round("wacc", 6).alias("wacc"))


PLANS = Spread(Fixture(
    "id int, revenue array<double>, margin array<double>, base_revenue double, tax_rate double, da_pct double, capex_pct double, nwc_pct double, wacc double, growth double, net_debt double, minority_interest double, non_operating_assets double, target_equity double",
    [
        (1, [1100.0, 1210.0, 1320.0], [0.2, 0.21, 0.22], 1000.0, 0.25, 0.04, 0.05, 0.1, 0.1, 0.025, 300.0, None, 50.0, 2200.0),
        (2, [500.0, 520.0], [0.3, 0.3], 480.0, 0.2, 0.03, 0.04, 0.08, 0.09, 0.02, 0.0, 10.0, None, 900000.0),
        (3, [500.0, 520.0], [0.3, 0.3], 480.0, 0.2, 0.03, 0.04, 0.08, 0.09, 0.09, None, 10.0, None, 1500.0),
    ],
))
_FLOWS = f"""p AS {PLANS.sql()}, y AS (SELECT *, unnest(range(1, len(revenue) + 1)) AS i FROM p),
f AS (SELECT *, revenue[i] * margin[i] AS e, revenue[i] * margin[i] * (1 - tax_rate) + revenue[i] * da_pct * tax_rate - revenue[i] * capex_pct - (revenue[i] - CASE WHEN i = 1 THEN base_revenue ELSE revenue[i - 1] END) * nwc_pct AS fcff FROM y)"""


@query(
    f"""WITH {_FLOWS}, s AS (SELECT id, sum(fcff / pow(1 + wacc, i)) AS pv, arg_max(fcff, i) AS last, max(i) AS n FROM f GROUP BY id),
t AS (SELECT p.*, pv, n, CASE WHEN growth < wacc THEN last * (1 + growth) / (wacc - growth) END AS tv FROM p JOIN s USING (id)),
e AS (SELECT *, tv / pow(1 + wacc, n) AS pvt, pv + tv / pow(1 + wacc, n) AS ev FROM t)
SELECT id, round(ev, 6) AS enterprise_value, round(ev - net_debt - coalesce(minority_interest, 0) + coalesce(non_operating_assets, 0), 6) AS equity_value, round(pvt / ev, 6) AS terminal_share, minority_interest IS NULL OR non_operating_assets IS NULL AS bridge_defaulted,
CASE WHEN growth >= wacc THEN 'growth not below the rate' WHEN net_debt IS NULL THEN 'no net debt' END AS gap FROM e"""
)
def dcf(spark, sf_dir):
    """Discounted flows, terminal value and bridge."""
    return v.dcf(PLANS.frame(spark, sf_dir)).select("id", *(F.round(c, 6).alias(c) for c in ("enterprise_value", "equity_value", "terminal_share")), "bridge_defaulted", "gap")


@query(
    f"""WITH {_FLOWS}, g AS (SELECT w, g FROM (SELECT unnest([CAST(0.08 AS DOUBLE), 0.1, 0.12]) AS w), (SELECT unnest([CAST(0.02 AS DOUBLE), 0.03, 0.09]) AS g)),
s AS (SELECT id, w, g, sum(fcff / pow(1 + w, i)) AS pv, arg_max(fcff, i) AS last, max(i) AS n FROM f, g GROUP BY id, w, g)
SELECT id, w AS wacc, g AS growth, CASE WHEN g >= w THEN 'none' ELSE CAST(CAST(round(pv + last * (1 + g) / (w - g) / pow(1 + w, n) - net_debt - coalesce(minority_interest, 0) + coalesce(non_operating_assets, 0), 3) * 1000 AS BIGINT) AS VARCHAR) END AS equity_milli FROM s JOIN p USING (id)"""
)
def dcf_grid(spark, sf_dir):
    """Equity value over rates and growths; no value where growth reaches the rate."""
    g = v.dcf_grid(PLANS.frame(spark, sf_dir), [0.08, 0.1, 0.12], [0.02, 0.03, 0.09])
    return g.select("id", "wacc", "growth", F.when(F.isnan("equity_value"), "none").otherwise(F.round(F.round("equity_value", 3) * 1000).cast("long").cast("string")).alias("equity_milli"))


@query(
    f"""WITH {_FLOWS}, s AS (SELECT id, sum(fcff / pow(1 + wacc, i)) AS pv, arg_max(fcff, i) AS last, max(i) AS n FROM f GROUP BY id),
b AS (SELECT p.*, pv, last, n, -net_debt - coalesce(minority_interest, 0) + coalesce(non_operating_assets, 0) AS bridge, least(1.0, wacc - 0.0001) AS top FROM p JOIN s USING (id)),
r AS (SELECT *, (target_equity - bridge - pv) * pow(1 + wacc, n) AS tv, pv + last * (1 - 0.3) / (wacc + 0.3) / pow(1 + wacc, n) + bridge AS lo, pv + last * (1 + top) / (wacc - top) / pow(1 + wacc, n) + bridge AS hi FROM b)
SELECT id, lo <= target_equity AND target_equity <= hi AS feasible, CASE WHEN lo <= target_equity AND target_equity <= hi THEN round((tv * wacc - last) / (tv + last), 6) END AS implied_growth FROM r"""
)
def reverse_dcf(spark, sf_dir):
    """The growth that a price implies, in closed form."""
    return v.reverse_dcf(PLANS.frame(spark, sf_dir)).select("id", "feasible", F.round("implied_growth", 6).alias("implied_growth"))


MULTIPLES = Spread(Fixture(
    "id int, metric double, multiple_low double, multiple_mid double, multiple_high double, net_debt double, minority_interest double, dlom double",
    [(1, 200.0, 6.0, 7.5, 9.0, 300.0, None, 0.2), (2, -10.0, 6.0, 7.5, 9.0, 300.0, 5.0, None), (3, 50.0, 1.0, 1.0, 2.0, None, None, None)],
))


@query(
    f"""SELECT id, round(CASE WHEN metric > 0 THEN (metric * multiple_low - net_debt - coalesce(minority_interest, 0)) * (1 - coalesce(dlom, 0)) END, 6) AS low, round(CASE WHEN metric > 0 THEN (metric * multiple_mid - net_debt - coalesce(minority_interest, 0)) * (1 - coalesce(dlom, 0)) END, 6) AS mid,
round(CASE WHEN metric > 0 THEN (metric * multiple_high - net_debt - coalesce(minority_interest, 0)) * (1 - coalesce(dlom, 0)) END, 6) AS high, CASE WHEN metric <= 0 THEN 'metric not positive' WHEN net_debt IS NULL THEN 'no net debt' END AS gap FROM {MULTIPLES.sql()}"""
)
def multiples(spark, sf_dir):
    """Value by multiples."""
    return v.by_multiples(MULTIPLES.frame(spark, sf_dir)).select("id", *(F.round(c, 6).alias(c) for c in ("low", "mid", "high")), "gap")


OWNERS = Spread(Fixture("id int, net_income double, interest double, taxes double, da double, owner_pay double, market_pay double, personal double, gains double, losses double", [(1, 120.0, 10.0, 30.0, 25.0, 80.0, 50.0, 6.0, 4.0, None), (2, 50.0, None, 10.0, 5.0, 20.0, 30.0, None, None, 3.0)]))


@query(f"SELECT id, net_income + interest + taxes + da AS ebitda, net_income + interest + taxes + da + owner_pay - market_pay + coalesce(personal, 0) - coalesce(gains, 0) + coalesce(losses, 0) AS sde FROM {OWNERS.sql()}")
def sde(spark, sf_dir):
    """Seller's discretionary earnings."""
    return v.sde(OWNERS.frame(spark, sf_dir)).select("id", "ebitda", "sde")


RATIOS = Spread(Fixture("id int, revenue double, net_income double, pretax double, operating_income double, assets double, equity double, equity_parent double", [(1, 1000.0, 80.0, 100.0, 110.0, 2000.0, 800.0, 700.0), (2, 500.0, 10.0, None, 12.0, 900.0, None, 90.0), (3, 0.0, 5.0, 6.0, 7.0, 100.0, 50.0, 50.0)]))


@query(
    f"""SELECT id, ok AS applicable, round(CASE WHEN ok THEN net_income / revenue END, 6) AS net_margin, round(CASE WHEN ok THEN net_income / revenue * (revenue / assets) * (assets / e) END, 6) AS roe, round(CASE WHEN ok THEN net_income / assets END, 6) AS roa,
round(CASE WHEN ok THEN pretax / operating_income END, 6) AS interest_burden, coalesce(CASE WHEN ok THEN assets / e END > 8, false) AS leverage_warning FROM (SELECT *, coalesce(equity, equity_parent) AS e, coalesce(revenue > 0 AND assets > 0 AND coalesce(equity, equity_parent) > 0 AND net_income IS NOT NULL, false) AS ok FROM {RATIOS.sql()})"""
)
def dupont(spark, sf_dir):
    """Return on equity taken apart."""
    return v.dupont(RATIOS.frame(spark, sf_dir)).select("id", "applicable", *(F.round(c, 6).alias(c) for c in ("net_margin", "roe", "roa", "interest_burden")), "leverage_warning")


RISKS = Repeated(Fixture("id int, factor string, low double, mid double, high double, cap_low double, cap_mid double, cap_high double, revenue_component double", [(1, a, x, x + 0.1, x + 0.2, 300.0, 350.0, 400.0, 50.0) for a, x in (("idea", 0.5), ("prototype", 0.4), ("team", 0.6), ("relations", 0.2), ("rollout", 0.1))]), ('id',), ('low', 'mid', 'high'))


@query(f"SELECT id, count(*) AS n_factors, round(sum(low) * max(cap_low) + max(revenue_component), 6) AS low, round(sum(mid) * max(cap_mid) + max(revenue_component), 6) AS mid, round(sum(high) * max(cap_high) + max(revenue_component), 6) AS high FROM {RISKS.sql()} GROUP BY id")
def berkus(spark, sf_dir):
    """Value by achieved shares of capped factors."""
    return v.berkus(RISKS.frame(spark, sf_dir), ["id"]).select("id", "n_factors", *(F.round(c, 6).alias(c) for c in ("low", "mid", "high")))


SCORES = Repeated(Fixture("id int, factor string, low double, mid double, high double, base_low double, base_mid double, base_high double", [(k, f, 0.8, 1.0 + i / 20, 1.2 + i / 20, 500.0, 600.0, 800.0) for k, fs in ((1, list(v.SCORECARD_WEIGHTS)), (2, ["team", "product"])) for i, f in enumerate(fs)]), ('id',), ('low', 'mid', 'high'))
_WEIGHT = "CASE factor " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in v.SCORECARD_WEIGHTS.items()) + " END"


@query(f"SELECT id, count(*) AS n_factors, round(sum(low * {_WEIGHT}) / sum({_WEIGHT}) * max(base_low), 6) AS low, round(sum(mid * {_WEIGHT}) / sum({_WEIGHT}) * max(base_mid), 6) AS mid, round(sum(high * {_WEIGHT}) / sum({_WEIGHT}) * max(base_high), 6) AS high FROM {SCORES.sql()} GROUP BY id")
def scorecard(spark, sf_dir):
    """Weighted scorecard, scaled where factors are missing."""
    return v.scorecard(SCORES.frame(spark, sf_dir), ["id"]).select("id", "n_factors", *(F.round(c, 6).alias(c) for c in ("low", "mid", "high")))


OUTCOMES = Repeated(Fixture("id int, label string, probability double, value double", [(1, "good", 0.25, 9000.0), (1, "fair", 0.5, 3000.0), (1, "bad", 0.25, 0.0), (2, "only", 1.0, 70.0)]), ('id',), ('probability',))


@query(f"SELECT id, count(*) AS n, min(value) AS low, round(sum(probability * value), 6) AS mid, max(value) AS high FROM {OUTCOMES.sql()} GROUP BY id")
def first_chicago(spark, sf_dir):
    """Probability-weighted outcomes."""
    return v.first_chicago(OUTCOMES.frame(spark, sf_dir), ["id"]).select("id", "n", "low", F.round("mid", 6).alias("mid"), "high")


ROUNDS = Spread(Fixture("id int, exit_value double, investment double, years double, target_multiple double, target_irr double, dilution double, pre_money double", [(1, 50000.0, 1000.0, 5.0, 10.0, 0.5, 0.3, 4000.0), (2, 50000.0, 1000.0, 5.0, 8.0, 0.515, None, 4000.0), (3, 20000.0, 500.0, 4.0, None, 0.6, 0.2, 100.0)]))


@query(
    f"""SELECT id, round(m, 6) AS multiple, round(investment / (m * investment / exit_value / (1 - coalesce(dilution, 0))) - investment, 6) AS pre_money, coalesce(abs(pow(1 + target_irr, years) - target_multiple) / target_multiple > 0.05, false) AS inconsistent
FROM (SELECT *, coalesce(target_multiple, pow(1 + target_irr, years)) AS m FROM {ROUNDS.sql()})"""
)
def vc_method(spark, sf_dir):
    """Value today from an exit."""
    return v.vc_method(ROUNDS.frame(spark, sf_dir).drop("pre_money")).select("id", F.round("multiple", 6).alias("multiple"), F.round("pre_money", 6).alias("pre_money"), "inconsistent")


@query(
    f"""SELECT id, round(x, 6) AS required_exit, round(pow(x / (pre_money + investment), 1 / years) - 1, 6) AS implied_cagr, false AS is_valuation FROM (SELECT *, target_multiple * investment / (investment / (pre_money + investment) * (1 - coalesce(dilution, 0))) AS x FROM {ROUNDS.sql()})"""
)
def vc_required_exit(spark, sf_dir):
    """The exit that a price requires."""
    return v.vc_required_exit(ROUNDS.frame(spark, sf_dir)).select("id", F.round("required_exit", 6).alias("required_exit"), F.round("implied_cagr", 6).alias("implied_cagr"), "is_valuation")


RESULTS = Repeated(Fixture("entity string, method string, low double, mid double, high double, is_valuation boolean, shares double", [("a", "dcf", 900.0, 1000.0, 1300.0, True, 100.0), ("a", "multiples", 950.0, 1200.0, 1250.0, True, 100.0), ("a", "reverse", 5.0, 5.0, 5.0, False, 100.0), ("b", "dcf", 10.0, 20.0, 30.0, True, None), ("c", "dcf", 10.0, 20.0, 30.0, True, 10.0), ("c", "vc", 50.0, 60.0, 70.0, True, 10.0)]), ('entity',))


@query(
    f"""SELECT entity, method, CASE WHEN NOT is_valuation THEN 'not a valuation' WHEN shares IS NULL THEN 'no share count' END AS note, CASE WHEN is_valuation THEN low / shares END AS band_low, CASE WHEN is_valuation THEN high / shares END AS band_high, round(CASE WHEN is_valuation THEN (high / shares - low / shares) / abs(mid / shares) END, 6) AS span FROM {RESULTS.sql()}"""
)
def football(spark, sf_dir):
    """Per-share bands."""
    return v.bands(RESULTS.frame(spark, sf_dir)).select("entity", "method", "note", "band_low", "band_high", F.round("span", 6).alias("span"))


@query(
    f"""SELECT entity, count(*) AS n, CASE WHEN max(low / shares) <= min(high / shares) THEN max(low / shares) END AS consensus_low, CASE WHEN max(low / shares) <= min(high / shares) THEN min(high / shares) END AS consensus_high,
round(CASE WHEN count(*) >= 2 THEN (max(mid / shares) - min(mid / shares)) / ((max(mid / shares) + min(mid / shares)) / 2) END, 6) AS mid_spread FROM {RESULTS.sql()} WHERE is_valuation AND shares > 0 GROUP BY entity"""
)
def football_consensus(spark, sf_dir):
    """Where all methods overlap, and how far they spread."""
    return v.consensus(v.bands(RESULTS.frame(spark, sf_dir)), ["entity"]).withColumn("mid_spread", F.round("mid_spread", 6))


GROWTHS = Spread(Fixture("id int, g double, gdp double, inflation double", [(1, 0.02, 0.05, 0.02), (2, 0.06, 0.05, 0.02), (3, 0.047, 0.05, 0.02), (4, 0.01, 0.05, 0.02)]))


@query(f"SELECT id, CASE WHEN g > gdp THEN 'error: above long-term nominal growth' WHEN g > 0.9 * gdp THEN 'warning: near long-term nominal growth' WHEN g < inflation THEN 'warning: below inflation' ELSE '' END AS problems FROM {GROWTHS.sql()}")
def terminal_growth(spark, sf_dir):
    """Bounds on perpetual growth."""
    return GROWTHS.frame(spark, sf_dir).select("id", F.array_join(v.terminal_growth_problems(F.col("g"), F.col("gdp"), F.col("inflation")), ",").alias("problems"))


DEBTS = Spread(Fixture("id int, total_debt double, current_debt double, noncurrent_debt double, finance_lease double, cash double, short_investments double", [(1, 500.0, 100.0, 400.0, None, 120.0, 30.0), (2, None, 100.0, None, 20.0, 50.0, None), (3, None, None, None, None, 50.0, 1.0), (4, 10.0, None, None, None, None, None)]))


@query(
    f"""SELECT id, CASE WHEN cash IS NOT NULL AND coalesce(total_debt, current_debt, noncurrent_debt, finance_lease) IS NOT NULL THEN coalesce(total_debt, coalesce(current_debt, 0) + coalesce(noncurrent_debt, 0)) + coalesce(finance_lease, 0) - cash - coalesce(short_investments, 0) END AS net_debt,
CASE WHEN cash IS NULL THEN 'no cash' WHEN coalesce(total_debt, current_debt, noncurrent_debt, finance_lease) IS NULL THEN 'no debt item' END AS gap FROM {DEBTS.sql()}"""
)
def net_debt(spark, sf_dir):
    """Net debt without double counting."""
    return facts.net_debt(DEBTS.frame(spark, sf_dir)).select("id", "net_debt", "gap")


FACTS = Repeated(Fixture(
    "cik string, tag string, start date, end date, val double, filed date, seq int",
    [
        ("1", "Revenues", "2020-01-01", "2020-12-31", 100.0, "2021-02-20", 0), ("1", "Revenues", "2020-01-01", "2020-12-31", 104.0, "2022-02-20", 1), ("1", "Revenues", "2021-01-01", "2021-12-31", 120.0, "2022-02-20", 2),
        ("1", "Revenues", "2021-10-01", "2021-12-31", 30.0, "2022-02-20", 3), ("1", "SalesRevenueNet", "2019-01-01", "2019-12-31", 90.0, "2020-02-20", 4), ("2", "Revenues", "2021-01-01", "2021-12-31", None, "2022-03-01", 5),
        ("2", "SalesRevenueNet", "2021-01-01", "2021-12-31", 55.0, "2022-03-01", 6), ("2", "Assets", None, "2021-12-31", 500.0, "2022-03-01", 7), ("2", "Assets", None, "2021-12-31", 505.0, "2022-03-01", 8),
    ],
), ('cik',))


@query(f"""SELECT cik, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed DESC, seq) AS k FROM {FACTS.sql()} WHERE tag = 'Revenues' AND val IS NOT NULL AND date_diff('day', start, "end") BETWEEN 330 AND 400) WHERE k = 1""")
def annual_series(spark, sf_dir):
    """Annual values, the last filed of each period."""
    f = facts.series(FACTS.frame(spark, sf_dir).where("tag = 'Revenues'"), "annual")
    return facts.latest_filed(f, ["cik", "tag"]).select("cik", "end", "val")


@query(f"""SELECT cik, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed DESC, seq) AS k FROM {FACTS.sql()} WHERE tag = 'Revenues' AND val IS NOT NULL AND filed <= DATE '2021-12-31' AND date_diff('day', start, "end") BETWEEN 330 AND 400) WHERE k = 1""")
def annual_series_asof(spark, sf_dir):
    """The same as known at a date, restatements after it left out."""
    f = facts.series(FACTS.frame(spark, sf_dir).where("tag = 'Revenues'"), "annual")
    return facts.disclosed_by(f, ["cik", "tag"], F.lit("2021-12-31").cast("date")).select("cik", "end", "val")


@query(f"""SELECT cik, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed DESC, seq) AS k FROM {FACTS.sql()} WHERE start IS NULL) WHERE k = 1""")
def instant_series(spark, sf_dir):
    """Values at a date, the first read of equal filings."""
    return facts.latest_filed(facts.series(FACTS.frame(spark, sf_dir), "instant"), ["cik", "tag"]).select("cik", "end", "val")


@query(f"""SELECT cik, "end", arg_min(val, p) AS val, arg_min(tag, p) AS tag_used FROM (SELECT *, CASE tag WHEN 'Revenues' THEN 1 WHEN 'SalesRevenueNet' THEN 2 END * 100 - seq AS p FROM {FACTS.sql()} WHERE val IS NOT NULL AND tag IN ('Revenues', 'SalesRevenueNet') AND date_diff('day', start, "end") BETWEEN 330 AND 400) GROUP BY cik, "end\"""")
def revenue_by_tag(spark, sf_dir):
    """Revenue by the first tag that has one, restated values last."""
    f = facts.latest_filed(facts.series(FACTS.frame(spark, sf_dir), "annual"), ["cik", "tag"])
    return facts.first_tag(f, ["cik", "end"], facts.REVENUE_TAGS).select("cik", "end", "val", "tag_used")


SHEETS = Spread(Fixture(
    "id int, assets double, liabilities double, equity double, minority_interest double, net_assets double, cash_begin double, cash_end double, cfo double, cfi double, cff double, fx_effect double",
    [(1, 1000.0, 600.0, 400.0, None, None, 10.0, 25.0, 30.0, -20.0, 5.0, None), (2, 1000.0, 600.0, 380.0, 20.0, None, 10.0, 25.0, 30.0, -20.0, 9.0, None), (3, None, 600.0, 380.0, None, 380.5, 10.0, None, 1.0, 1.0, 1.0, 1.0), (4, 1000.0, 500.0, 400.0, None, None, 5.0, 9.0, 3.0, 2.0, 1.0, -2.0)],
))


@query(
    f"""WITH s AS {SHEETS.sql()} SELECT id, 'balance' AS "check", CASE WHEN assets IS NULL OR liabilities IS NULL OR equity IS NULL THEN 'undecidable' WHEN abs(assets - liabilities - equity) <= greatest(abs(assets) * 1e-6, 1) OR abs(assets - liabilities - equity - coalesce(minority_interest, 0)) <= greatest(abs(assets) * 1e-6, 1) THEN 'holds' ELSE 'fails' END AS status FROM s
UNION ALL SELECT id, 'cash_rollforward', CASE WHEN cash_begin IS NULL OR cash_end IS NULL OR cfo IS NULL OR cfi IS NULL OR cff IS NULL THEN 'undecidable' WHEN abs(cash_end - cash_begin - cfo - cfi - cff - coalesce(fx_effect, 0)) <= greatest(abs(cash_end) * 1e-6, 1) THEN 'holds' ELSE 'fails' END FROM s
UNION ALL SELECT id, 'net_assets', CASE WHEN assets IS NOT NULL THEN 'not_applicable' WHEN net_assets IS NULL OR equity IS NULL THEN 'undecidable' WHEN abs(net_assets - equity) <= greatest(abs(net_assets) * 1e-6, 1) THEN 'holds' ELSE 'fails' END FROM s"""
)
def accounting_checks(spark, sf_dir):
    """Identities with four outcomes (V1-V4, V7)."""
    return checks.all_checks(SHEETS.frame(spark, sf_dir), [checks.balance(), checks.cash_rollforward(), checks.net_assets()], "id").select("id", "check", "status")


RECON = Repeated(Fixture("id int, label string, value double", [(1, "Depreciation", 30.0), (1, "Change in receivables", -12.0), (1, "Total adjustments", 18.0), (2, "Depreciation", 5.0), (2, "Other", None), (3, "Cash received from customers", 99.0)]), ('id',))
HEADS = Repeated(Fixture("id int, net_income double, cfo double", [(1, 100.0, 118.0), (2, 10.0, 30.0), (3, 1.0, 2.0), (4, None, 3.0)]), ('id',))


@query(
    f"""SELECT h.id, CASE WHEN coalesce(direct, false) THEN 'not_applicable' WHEN net_income IS NULL OR cfo IS NULL THEN 'undecidable' WHEN abs(cfo - net_income - coalesce(a, 0)) <= greatest(abs(cfo) * 1e-6, 1) THEN 'holds' ELSE 'fails' END AS status, coalesce(n, 0) AS counted
FROM {HEADS.sql()} h LEFT JOIN (SELECT id, sum(value) FILTER (NOT contains(lower(label), 'total')) AS a, count(value) FILTER (NOT contains(lower(label), 'total')) AS n, bool_or(contains(lower(label), 'cash received from customers')) AS direct FROM {RECON.sql()} GROUP BY id) r ON h.id = r.id"""
)
def indirect_method(spark, sf_dir):
    """Net income reconciled to operating cash flow."""
    return checks.indirect_method(RECON.frame(spark, sf_dir), HEADS.frame(spark, sf_dir), "id").select("id", "status", "counted")


NUMBERS = Repeated(Fixture("id int, cell string", list(enumerate(["1,234.5", "(3,552)", "$ (102,777)", "—", "", "12.5%", "abc", "￥1,000", "-7", "(0.5)", "2016-12-31", "334.719.50", None], 1))), ('id',))
_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(cell), '[\\s 　]', '', 'g'), '^(\\()?(us\\$|hk\\$|rmb|usd|[$¥￥€£])', '\\1'), '[,，]', '', 'g'), '^[(（]|[)）]$', '', 'g')"


@query(f"SELECT id, CASE WHEN regexp_full_match({_BODY}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CASE WHEN contains(cell, '(') THEN -1 ELSE 1 END * TRY_CAST({_BODY} AS DOUBLE) END AS value FROM {NUMBERS.sql()}")
def number_parse(spark, sf_dir):
    """Table cells as numbers (M1)."""
    return NUMBERS.frame(spark, sf_dir).select("id", numbers.lenient_number(F.col("cell")).alias("value"))


_RAW_CODES = """CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey * 37 % 1000000 AS {t}) WHEN 1 THEN lpad(CAST(o_orderkey * 41 % 1000000 AS {t}), 6, '0') WHEN 2 THEN concat(CAST(o_orderkey % 10000 AS {t}), '.hk')
WHEN 3 THEN concat('92', lpad(CAST(o_orderkey % 10000 AS {t}), 4, '0')) WHEN 4 THEN concat('000000', CAST(320193 + o_orderkey AS {t})) WHEN 5 THEN concat('CIK', CAST(o_orderkey AS {t})) ELSE concat(' T', chr(CAST(65 + o_orderkey % 26 AS INTEGER)), ' ') END"""
_FIVE, _TEN, _SIX = (f"CASE WHEN length({c}) < {n} THEN lpad({c}, {n}, '0') ELSE {c} END" for c, n in (("d", 5), ("k", 10), ("trim(code)", 6)))


@query(
    f"""WITH r AS (SELECT o_orderkey, {_RAW_CODES.format(t="VARCHAR")} AS code FROM orders),
x AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d, regexp_replace(regexp_replace(trim(code), '^CIK', ''), '^0+([0-9])', '\\1') AS k, {_SIX} AS c FROM r),
y AS (SELECT *, CASE WHEN length(c) <> 6 OR NOT regexp_matches(c, '^[0-9]+$') THEN NULL WHEN c[1] IN ('4', '8') OR c[1:2] = '92' THEN c || '.BJ' WHEN c[1] = '6' THEN c || '.SH' WHEN c[1] IN ('0', '3') THEN c || '.SZ' END AS cn, upper(trim(code)) AS u FROM x)
SELECT o_orderkey, cn, CASE WHEN d <> '' THEN {_FIVE} END AS hk, CASE WHEN regexp_matches(k, '^[0-9]+$') THEN {_TEN} END AS filer,
CASE WHEN cn IS NOT NULL AND regexp_matches(u, '^[0-9]{{6}}$') THEN 'cn' WHEN regexp_matches(u, '^[0-9]{{1,5}}([.]HK)?$') THEN 'hk' WHEN regexp_matches(u, '^[A-Z][A-Z.-]{{0,9}}$') THEN 'us' END AS market FROM y"""
)
def security_codes(spark, sf_dir):
    """Codes of securities and filers and their market, also malformed and over-long ones (D6-D10): made from order keys."""
    c = F.col("code")
    codes = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW_CODES.format(t="STRING")).alias("code"))
    return codes.select("o_orderkey", identifiers.cn_security(c).alias("cn"), identifiers.hk_code(c).alias("hk"), identifiers.filer_key(c).alias("filer"), identifiers.market_of(c).alias("market"))


QUOTES = Repeated(Fixture("code string, d date, src int, close double", [("x", "2024-01-05", 0, 10.0), ("x", "2024-01-03", 0, 9.0), ("y", "2023-12-01", 0, 4.0), ("y", "2024-02-01", 0, 6.0)]), ('code',))
DATES = Repeated(Fixture("code string, as_of date", [("x", "2024-01-06"), ("x", "2024-01-04"), ("y", "2024-01-06"), ("z", "2024-01-06")]), ('code',))


@query(f"""SELECT a.code, as_of, arg_max(close, d) AS close FROM {DATES.sql()} a LEFT JOIN {QUOTES.sql()} q ON a.code = q.code AND d BETWEEN as_of - INTERVAL 15 DAY AND as_of GROUP BY a.code, as_of""")
def price_on_date(spark, sf_dir):
    """The last close at or before a date, at most 15 days old, never a later one."""
    return asof.asof_backward(DATES.frame(spark, sf_dir), QUOTES.frame(spark, sf_dir), ["code"], "as_of", "d", ["close"], F.expr("INTERVAL 15 DAYS")).select("code", "as_of", "close")


_CONFIG = """concat('{"unit": "wan", "berkus": {"per_factor_cap": {"low": ', c_custkey % 50 + 200, ', "mid": ', c_custkey % 50 + 250, ', "high": ', c_custkey % 50 + 300, '}, "factors": {"idea": [0.', c_custkey % 4 + 1, ', 0.5, 0.', c_custkey % 3 + 6, '], "team": 0.25}}, ',
'"scorecard": {"base": ', c_custkey % 900 + 100, ', "factors": {"team": ', CASE WHEN c_custkey % 7 = 0 THEN '9' ELSE '1.25' END, ', "other": [0.5, 1, 1.5]}}, "vc_method": {"exit_value": {"value": ', c_custkey % 700 + 50000, '}, "investment": 1000, "years_to_exit": 5, ',
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"target_multiple": 8, ' END, '"future_dilution": 0.25, "reverse": true, "ask_price": ', c_custkey % 300 + 4000, '}, "first_chicago": {"outcomes": [{"label": "up", "probability": 0.25, "value": ', c_custkey % 800 + 1000, '}, {"label": "down", "probability": ', CASE WHEN c_custkey % 11 = 0 THEN '0.5' ELSE '0.75' END, ', "value": 0}]}}')"""
_TEAM, _OTHER = v.SCORECARD_WEIGHTS["team"], v.SCORECARD_WEIGHTS["other"]
_SCORED = f"(c_custkey % 900 + 100) * (1.25 * {_TEAM} + {{}} * {_OTHER}) / ({_TEAM} + {_OTHER})"


@query(
    f"""WITH c AS (SELECT c_custkey, c_custkey % 7 = 0 AS odd, c_custkey % 5 = 0 AS aimless, c_custkey % 11 = 0 AS unsure FROM customer)
SELECT c_custkey AS entity, 'berkus' AS method, round(((c_custkey % 4 + 1) / 10.0 + 0.25) * (c_custkey % 50 + 200), 6)::DOUBLE AS low, round(0.75 * (c_custkey % 50 + 250), 6)::DOUBLE AS mid, round(((c_custkey % 3 + 6) / 10.0 + 0.25) * (c_custkey % 50 + 300), 6)::DOUBLE AS high, NULL AS problem FROM c
UNION ALL SELECT c_custkey, 'scorecard', CASE WHEN NOT odd THEN round({_SCORED.format(0.5)}, 6) END, CASE WHEN NOT odd THEN round({_SCORED.format(1)}, 6) END, CASE WHEN NOT odd THEN round({_SCORED.format(1.5)}, 6) END, CASE WHEN odd THEN 'team: out of bounds or not known' END FROM c
UNION ALL SELECT c_custkey, 'vc', x, x, x, CASE WHEN aimless THEN 'target_multiple or target_irr: missing' END FROM (SELECT *, CASE WHEN NOT aimless THEN round((c_custkey % 700 + 50000) * 0.75 / 8 - 1000, 6) END AS x FROM c)
UNION ALL SELECT c_custkey, 'vc_required_exit', x, x, x, CASE WHEN aimless THEN 'target_multiple: missing' END FROM (SELECT *, CASE WHEN NOT aimless THEN round(8 * (c_custkey % 300 + 5000) / 0.75, 6) END AS x FROM c)
UNION ALL SELECT c_custkey, 'first_chicago', CASE WHEN NOT unsure THEN 0 END, CASE WHEN NOT unsure THEN round(0.25 * (c_custkey % 800 + 1000), 6) END, CASE WHEN NOT unsure THEN c_custkey % 800 + 1000 END, CASE WHEN unsure THEN 'probabilities must sum to 1' END FROM c"""
)
def early_stage_configs(spark, sf_dir):
    """Nested configurations to the methods they have, what is wrong named (H4, H18, K16, K17): one for each customer."""
    configs = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_CONFIG).alias("config"))
    return early_stage.build(configs, "c_custkey").select("entity", "method", *(F.round(e, 6).alias(e) for e in ("low", "mid", "high")), "problem")
