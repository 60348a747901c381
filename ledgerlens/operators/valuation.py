"""Valuation models as column expressions over tables of companies or scenarios.

A missing input gives NULL and a named gap; only broken contracts raise. Bridge items
(minority interest, non-operating assets) alone default to 0, and ``bridge_defaulted`` says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size premium by decile, smallest companies first.
SIZE_PREMIUM = {1: 0.0525, 2: 0.0424, 3: 0.0368, 4: 0.031, 5: 0.0266, 6: 0.022, 7: 0.0168, 8: 0.011, 9: 0.006, 10: 0.0}
#: Weights of the scorecard's seven factors.
SCORECARD_WEIGHTS = {"team": 0.30, "opportunity": 0.25, "product": 0.15, "competition": 0.10, "channels": 0.10, "financing": 0.05, "other": 0.05}
SCORECARD_BOUNDS = (0.5, 1.5)
LEVERAGE_WARNING = 8.0


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def missing(df: DataFrame, columns: list[str], out: str = "gaps") -> DataFrame:
    """Adds the names of the columns that are NULL in a row."""
    return df.withColumn(out, F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull()))


def size_premium(decile: Column) -> Column:
    out = F.when(decile == 1, SIZE_PREMIUM[1])
    for k in range(2, 11):
        out = out.when(decile == k, SIZE_PREMIUM[k])
    return out


def relever(beta: Column, debt: Column, equity: Column, tax: Column) -> Column:
    """NULL where equity isn't positive (M9)."""
    return F.when(equity > 0, beta * (1 + (1 - tax) * debt / equity))


def unlever(beta: Column, debt: Column, equity: Column, tax: Column) -> Column:
    return F.when(equity > 0, beta / (1 + (1 - tax) * debt / equity))


def wacc(df: DataFrame) -> DataFrame:
    """Adds beta_levered, cost_of_equity, wacc and gaps.

    Needs risk_free, equity_premium, beta_unlevered, tax_rate, cost_of_debt, debt, equity;
    size_premium and country_premium default to 0.
    """
    c = F.col
    optional = lambda n: F.coalesce(c(n), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    out = missing(df, ["risk_free", "equity_premium", "beta_unlevered", "tax_rate", "cost_of_debt", "debt", "equity"])
    out = out.withColumn("beta_levered", relever(c("beta_unlevered"), c("debt"), c("equity"), c("tax_rate")))
    out = out.withColumn("cost_of_equity", c("risk_free") + c("beta_levered") * c("equity_premium") + optional("size_premium") + optional("country_premium"))
    total = c("debt") + c("equity")
    return out.withColumn("wacc", c("equity") / total * c("cost_of_equity") + c("debt") / total * c("cost_of_debt") * (1 - c("tax_rate")))


def wacc_grid(df: DataFrame, deltas: list[float]) -> DataFrame:
    """A row for each delta, moving wacc and cost of equity alike."""
    d = df.withColumn("delta", F.explode(F.array(*(F.lit(x) for x in deltas))))
    return d.withColumn("wacc", F.col("wacc") + F.col("delta")).withColumn("cost_of_equity", F.col("cost_of_equity") + F.col("delta"))


def _flows(mid_year: bool) -> Column:
    """array<struct<t, ebitda, fcff, nwc>> of a row's arrays of revenue and margin."""
    c = F.col
    shift = 0.5 if mid_year else 0.0

    def year(pair: Column, i: Column) -> Column:
        revenue, ebitda = pair["revenue"], pair["revenue"] * pair["margin"]
        before = F.when(i == 0, c("base_revenue")).otherwise(F.get(c("revenue"), i - 1))
        nwc_change = (revenue - before) * c("nwc_pct")
        fcff = ebitda * (1 - c("tax_rate")) + revenue * c("da_pct") * c("tax_rate") - revenue * c("capex_pct") - nwc_change
        return F.struct((i + 1 - F.lit(shift)).alias("t"), ebitda.alias("ebitda"), fcff.alias("fcff"))

    pairs = F.zip_with("revenue", "margin", lambda r, m: F.struct(r.alias("revenue"), m.alias("margin")))
    return F.transform(pairs, year)


def dcf(df: DataFrame, mid_year: bool = False) -> DataFrame:
    """Adds pv_flows, terminal_value, pv_terminal, enterprise_value, equity_value, terminal_share, gap.

    A row holds revenue and margin arrays, base_revenue, tax_rate, da_pct, capex_pct, nwc_pct, wacc, net_debt
    and growth or exit_multiple; an exit multiple goes before growth. Growth at or above the
    rate has no value: gap says so and the figures are NULL. Array lengths that differ raise.
    """
    c = F.col
    optional = lambda n: c(n) if n in df.columns else F.lit(None).cast("double")
    same = F.when(F.size("revenue") == F.size("margin"), F.lit(True)).otherwise(F.raise_error(F.lit("revenue and margin differ in length")).cast("boolean"))
    out = df.where(same).withColumn("_f", _flows(mid_year)).withColumn("_l", F.element_at("_f", -1))
    out = out.withColumn("pv_flows", F.aggregate(F.transform("_f", lambda x: x["fcff"] / F.pow(1 + c("wacc"), x["t"])), F.lit(0.0), lambda a, x: a + x))
    multiple, growth = optional("exit_multiple"), optional("growth")
    out = out.withColumn("terminal_value", F.when(multiple.isNotNull(), c("_l.ebitda") * multiple).when(growth < c("wacc"), c("_l.fcff") * (1 + growth) / (c("wacc") - growth)))
    out = out.withColumn("pv_terminal", c("terminal_value") / F.pow(1 + c("wacc"), c("_l.t"))).withColumn("enterprise_value", c("pv_flows") + c("pv_terminal"))
    minority, other = optional("minority_interest"), optional("non_operating_assets")
    out = out.withColumn("equity_value", c("enterprise_value") - c("net_debt") - F.coalesce(minority, F.lit(0.0)) + F.coalesce(other, F.lit(0.0)))
    gap = F.when(multiple.isNull() & growth.isNull(), "no terminal growth").when(multiple.isNull() & (growth >= c("wacc")), "growth not below the rate").when(c("net_debt").isNull(), "no net debt")
    return out.withColumn("terminal_share", c("pv_terminal") / c("enterprise_value")).withColumn("bridge_defaulted", minority.isNull() | other.isNull()).withColumn("gap", gap).drop("_f", "_l")


def dcf_grid(df: DataFrame, rates: list[float], growths: list[float], mid_year: bool = False) -> DataFrame:
    """A row for each rate and growth; equity_value is NaN where growth isn't below the rate."""
    cells = df.drop("wacc", "growth", "exit_multiple").withColumn("wacc", F.explode(F.array(*map(F.lit, rates)))).withColumn("growth", F.explode(F.array(*map(F.lit, growths))))
    return dcf(cells, mid_year).withColumn("equity_value", F.when(F.col("growth") >= F.col("wacc"), F.lit(float("nan"))).otherwise(F.col("equity_value")))


def reverse_dcf(df: DataFrame, low: float = -0.30, high: float = 1.00, mid_year: bool = False) -> DataFrame:
    """Adds implied_growth and feasible for target_equity (M17), in closed form.

    Equity value is a rational function of growth, so the growth that gives a terminal value TV from a last flow F
    at rate w is (TV * w - F) / (TV + F). Feasible as a search between ``low`` and the lesser of ``high`` and
    w - 0.0001 would find it.
    """
    c = F.col
    top = F.least(F.lit(high), c("wacc") - 0.0001)
    base = dcf(df.drop("growth", "exit_multiple").withColumn("growth", F.lit(low)), mid_year).withColumn("_low", c("equity_value"))
    flows = base.withColumn("_f", _flows(mid_year)).withColumn("_l", F.element_at("_f", -1))
    factor = F.pow(1 + c("wacc"), c("_l.t"))
    bridge = c("equity_value") - c("enterprise_value")
    at_top = c("pv_flows") + c("_l.fcff") * (1 + top) / (c("wacc") - top) / factor + bridge
    wanted = (c("target_equity") - bridge - c("pv_flows")) * factor
    growth = (wanted * c("wacc") - c("_l.fcff")) / (wanted + c("_l.fcff"))
    feasible = (c("_low") <= c("target_equity")) & (c("target_equity") <= at_top)
    done = flows.withColumn("feasible", feasible).withColumn("implied_growth", F.when(c("feasible"), growth))
    return done.select(*(x for x in df.columns if x not in ("growth", "exit_multiple")), "feasible", "implied_growth")


def by_multiples(df: DataFrame) -> DataFrame:
    """Adds low, mid, high equity value from metric and three multiples.

    NULL with a gap for a metric that isn't positive; multiples that don't rise raise; dlom (0 if missing)
    takes its share of all three.
    """
    c = F.col
    optional = lambda n: F.coalesce(c(n), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    rise = F.when((c("multiple_low") <= c("multiple_mid")) & (c("multiple_mid") <= c("multiple_high")), F.lit(True)).otherwise(F.raise_error(F.lit("multiples must rise")).cast("boolean"))
    bridge = -c("net_debt") - optional("minority_interest") + optional("non_operating_assets")
    value = lambda m: F.when(c("metric") > 0, (c("metric") * c(m) + bridge) * (1 - optional("dlom")))
    gap = F.when(c("metric").isNull(), "no metric").when(c("metric") <= 0, "metric not positive").when(c("net_debt").isNull(), "no net debt")
    return df.where(rise).withColumns({"low": value("multiple_low"), "mid": value("multiple_mid"), "high": value("multiple_high"), "gap": gap})


def sde(df: DataFrame) -> DataFrame:
    """Adds ebitda and sde: seller's discretionary earnings."""
    c = F.col
    extra = lambda n: F.coalesce(c(n), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    out = df.withColumn("ebitda", c("net_income") + c("interest") + c("taxes") + c("da"))
    return out.withColumn("sde", c("ebitda") + c("owner_pay") - c("market_pay") + extra("personal") - extra("gains") + extra("losses"))


def dupont(df: DataFrame) -> DataFrame:
    """Adds the three factors, roe, roa, the five-factor parts and gaps.

    Nothing is computed where revenue, assets or equity is missing or not positive; equity falls back to the parent's
    only where it is NULL. five_factor_product tells whether the five parts multiply to roe.
    """
    c = F.col
    equity = F.coalesce(c("equity"), c("equity_parent")) if "equity_parent" in df.columns else c("equity")
    out = df.withColumn("_e", equity).withColumn("_ok", F.coalesce((c("revenue") > 0) & (c("assets") > 0) & (c("_e") > 0) & c("net_income").isNotNull(), F.lit(False)))
    when = lambda x: F.when(c("_ok"), x)
    out = out.withColumns({"net_margin": when(F.try_divide("net_income", "revenue")), "asset_turnover": when(F.try_divide("revenue", "assets")), "equity_multiplier": when(F.try_divide("assets", "_e")), "roa": when(F.try_divide("net_income", "assets"))})
    out = out.withColumn("roe", c("net_margin") * c("asset_turnover") * c("equity_multiplier"))
    out = out.withColumns({"tax_burden": when(F.try_divide("net_income", "pretax")), "ebit_margin": when(F.try_divide("pretax", "revenue")), "interest_burden": when(F.try_divide("pretax", "operating_income"))})
    out = out.withColumn("five_factor_product", c("tax_burden") * c("interest_burden") * c("ebit_margin") * c("asset_turnover") * c("equity_multiplier"))
    return out.withColumn("applicable", c("_ok")).withColumn("leverage_warning", F.coalesce(c("equity_multiplier") > LEVERAGE_WARNING, F.lit(False))).drop("_e", "_ok")


def berkus(factors: DataFrame, keys: list[str]) -> DataFrame:
    """low, mid, high: achieved shares (0 to 1) times the cap of each end, plus revenue_component."""
    fits = F.when((F.col("low") >= 0) & (F.col("high") <= 1) & (F.col("cap_low") > 0), F.lit(True)).otherwise(F.raise_error(F.lit("shares must lie in 0 to 1 and caps above 0")).cast("boolean"))
    end = lambda e: (F.sum(e) * F.max(f"cap_{e}") + F.coalesce(F.max("revenue_component"), F.lit(0.0))).alias(e)
    return factors.where(fits).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_factors"), end("low"), end("mid"), end("high"))


def scorecard(factors: DataFrame, keys: list[str]) -> DataFrame:
    """low, mid, high: base times the weighted multipliers; given weights are scaled to 1.

    Columns: factor, low, mid, high, base_low, base_mid, base_high. An unknown factor or a multiplier outside the bounds raises.
    """
    weight = F.lit(None).cast("double")
    for name, w in SCORECARD_WEIGHTS.items():
        weight = F.when(F.col("factor") == name, w).otherwise(weight)
    lo, hi = SCORECARD_BOUNDS
    fits = F.when(weight.isNotNull() & (F.col("low") >= lo) & (F.col("high") <= hi), weight).otherwise(F.raise_error(F.lit("unknown factor or multiplier out of bounds")).cast("double"))
    end = lambda e: (F.sum(F.col(e) * F.col("_w")) / F.sum("_w") * F.max(f"base_{e}")).alias(e)
    return factors.withColumn("_w", fits).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_factors"), end("low"), end("mid"), end("high"))


def first_chicago(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Probability-weighted value with its range; probabilities that don't sum to 1 raise."""
    p = F.sum("probability")
    mid = F.when(F.abs(p - 1) <= 0.001, F.sum(F.col("probability") * F.col("value"))).otherwise(F.raise_error(F.lit("probabilities must sum to 1")).cast("double"))
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), mid.alias("mid"), F.max("value").alias("high"))


def vc_method(df: DataFrame) -> DataFrame:
    """Adds multiple, ownership_exit, ownership_today, post_money, pre_money, inconsistent.

    Multiple from target_multiple, else from target_irr; both given and over 5 % apart: inconsistent.
    """
    c = F.col
    dilution = F.coalesce(c("dilution"), F.lit(0.0))
    implied = F.pow(1 + c("target_irr"), c("years"))
    out = df.withColumn("multiple", F.coalesce(c("target_multiple"), implied))
    out = out.withColumn("inconsistent", F.coalesce(F.abs(implied - c("target_multiple")) / c("target_multiple") > 0.05, F.lit(False)))
    fits = (c("exit_value") > 0) & (c("investment") > 0) & (c("years") > 0) & (c("multiple") > 1) & (dilution >= 0) & (dilution < 1)
    out = out.withColumn("ownership_exit", F.when(fits, c("multiple") * c("investment") / c("exit_value"))).withColumn("ownership_today", c("ownership_exit") / (1 - dilution))
    return out.withColumn("post_money", c("investment") / c("ownership_today")).withColumn("pre_money", c("post_money") - c("investment"))


def vc_required_exit(df: DataFrame) -> DataFrame:
    """Adds required_exit and implied_cagr for a pre_money; a condition, not a valuation."""
    c = F.col
    post = c("pre_money") + c("investment")
    own = c("investment") / post * (1 - F.coalesce(c("dilution"), F.lit(0.0)))
    fits = (c("pre_money") >= 0) & (c("investment") > 0) & (c("years") > 0) & (c("target_multiple") > 1) & (own > 0)
    out = df.withColumn("required_exit", F.when(fits, c("target_multiple") * c("investment") / own))
    return out.withColumn("implied_cagr", F.pow(c("required_exit") / post, 1 / c("years")) - 1).withColumn("is_valuation", F.lit(False))


def bands(results: DataFrame, shares: str = "shares") -> DataFrame:
    """Per-share low, mid, high with note and span; without a share count there is no band."""
    c = F.col
    note = F.when(~c("is_valuation"), "not a valuation").when(c(shares).isNull() | (c(shares) <= 0), "no share count").when(c("low").isNull() | c("mid").isNull() | c("high").isNull(), "no full range")
    out = results.withColumn("note", note)
    per = lambda e: F.when(c("note").isNull(), c(e) / c(shares))
    out = out.withColumns({"band_low": per("low"), "band_mid": per("mid"), "band_high": per("high")})
    return out.withColumn("span", F.when(c("band_mid") != 0, (c("band_high") - c("band_low")) / F.abs(c("band_mid"))))


def consensus(band_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where all bands overlap, NULL if they don't; and the spread of positive mids."""
    usable = band_rows.where(F.col("band_low").isNotNull())
    lo, hi = F.max("band_low"), F.min("band_high")
    positive = F.when(F.col("band_mid") > 0, F.col("band_mid"))
    spread = F.when(F.count(positive) >= 2, (F.max(positive) - F.min(positive)) / ((F.max(positive) + F.min(positive)) / 2))
    return usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(lo <= hi, lo).alias("consensus_low"), F.when(lo <= hi, hi).alias("consensus_high"), spread.alias("mid_spread"))


def terminal_growth_problems(growth: Column, gdp: Column, inflation: Column) -> Column:
    """array of findings on a perpetual growth rate."""
    found = [F.when(growth > gdp, F.lit("error: above long-term nominal growth")).when(growth > 0.9 * gdp, F.lit("warning: near long-term nominal growth")), F.when(growth < inflation, F.lit("warning: below inflation"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def effective_tax(tax: Column, pretax: Column) -> Column:
    """NULL unless pretax income is positive and the rate within (0, 0.6]."""
    rate = F.when(pretax > 0, tax / pretax)
    return F.when((rate > 0) & (rate <= 0.6), rate)


def implied_debt_cost(interest: Column, short_debt: Column, long_debt: Column) -> Column:
    """NULL outside (0, 0.5], not clipped."""
    rate = F.try_divide(interest, F.coalesce(short_debt, F.lit(0.0)) + F.coalesce(long_debt, F.lit(0.0)))
    return F.when((rate > 0) & (rate <= 0.5), rate)
