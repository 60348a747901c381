"""Comparable companies: derived lines, ticker lookup, a company's record, metric tables by market, the comparison itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts, peers
from .asof import asof_backward

#: Tags of the lines that multiples divide by, in the order in which they are tried.
LINE_TAGS = {
    "revenue": facts.REVENUE_TAGS,
    "operating_income": ["OperatingIncomeLoss"],
    "da": ["DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
}


def derived_lines(values: DataFrame, keys: list[str], tag: str = "tag", val: str = "val") -> DataFrame:
    """One row for each key: revenue (G18), ebit (G19), net_income and equity (G20) by their tags, ebitda = ebit + depreciation.

    A line without any of its tags is NULL. One shuffle for all lines.
    """
    wide = facts.pivot_concepts(values, keys, LINE_TAGS, tag, val)
    return wide.withColumnRenamed("operating_income", "ebit").withColumn("ebitda", F.col("ebit") + F.col("da"))


def with_filers(wanted: DataFrame, directory: DataFrame, ticker: str = "ticker", cik: str = "cik") -> DataFrame:
    """Adds cik by ticker, whatever its case; ``unmatched`` says where there is none (J6). Of several entries the least cik stands."""
    known = directory.where(F.col(ticker).isNotNull()).groupBy(F.upper(F.trim(F.col(ticker))).alias("_t")).agg(F.min(cik).alias(cik))
    found = wanted.withColumn("_t", F.upper(F.trim(F.col(ticker)))).join(known, "_t", "left").drop("_t")
    return found.withColumn("unmatched", F.col(cik).isNull())


def company_records(companies: DataFrame, values: DataFrame, prices: DataFrame, shares: DataFrame, as_of: str, key: str = "cik", lookback_days: int = 15) -> DataFrame:
    """One row for each company as one could know it at ``as_of`` (J9): period, lines, price, shares, multiples, gaps.

    ``companies``: key, net_debt; ``values``: key, tag, end, val, filed, seq; ``prices``: key, date, close; ``shares``: key, end, n.
    The period is the last first disclosed by then; the price the last within ``lookback_days``, the share count the last by then.
    What is missing is named and the company stays.
    """
    day = F.lit(as_of).cast("date")
    period = facts.latest_period(values, [key], day).withColumnRenamed("latest_end", "end")
    seen = facts.disclosed_by(values, [key, "tag"], day).join(period, [key, "end"])
    lines = derived_lines(seen, [key, "end"])
    asked = companies.withColumn("_day", day)
    priced = asof_backward(asked, prices.select(key, "date", "close"), [key], "_day", "date", ["close"], F.make_dt_interval(F.lit(lookback_days)))
    counted = shares.where(F.col("end") <= day).groupBy(key).agg(F.max_by("n", "end").alias("shares"))
    whole = priced.select(*companies.columns, F.col("close").alias("price")).join(counted, key, "left").join(lines, key, "left")
    return peers.multiples(whole, "price", "shares", "net_debt", MULTIPLES["us"])


#: Multiple → the line it divides by, for each market (U7, U8). Those of Hong Kong come as figures.
MULTIPLES: dict[str, dict[str, str]] = {
    "us": {"pe": "net_income", "pb": "equity", "price_to_revenue": "revenue", "ev_ebitda": "ebitda", "ev_ebit": "ebit", "ev_revenue": "revenue"},
    "cn": {"pe": "net_income_parent", "pb": "equity_parent", "price_to_revenue": "revenue"},
    "hk": {},
}


def _share(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _figure(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _growth(years: int = 3) -> Callable[[], Column]:
    positive = lambda: (F.col("revenue") > 0) & (F.col("revenue_before") > 0)
    return lambda: F.when(positive(), F.pow(F.col("revenue") / F.col("revenue_before"), F.lit(1.0 / years)) - 1)


def _growth_by_days() -> Column:
    """By the days between the ends of both periods, revenue_before_end and revenue_end, / 365.25."""
    span = F.datediff("revenue_end", "revenue_before_end") / F.lit(365.25)
    fits = (F.col("revenue") > 0) & (F.col("revenue_before") > 0) & (span > 0)
    return F.when(fits, F.pow(F.col("revenue") / F.col("revenue_before"), 1 / span) - 1)


#: Metric → its column over a company's row, for each market.
METRICS: dict[str, dict[str, Callable[[], Column]]] = {
    "us": {"revenue_cagr": _growth_by_days, "ebitda_margin": _share("ebitda", "revenue"), "revenue_scale": _figure("revenue")},
    "cn": {"revenue_cagr": _growth(), "op_margin": _share("operating_income", "revenue"), "revenue_scale": _figure("revenue")},
    "hk": {
        "op_margin": _share("operating_income", "revenue"), "net_margin": _figure("net_margin"), "gross_margin": _figure("gross_margin"), "revenue_yoy": _figure("revenue_yoy"),
        "revenue_scale": _figure("revenue"), "pe": _figure("pe"), "pb": _figure("pb"),
    },
}


def metric(market: str, name: str) -> Column:
    """The column of a metric or multiple; an unknown one raises and names those there are."""
    if name in METRICS.get(market, {}):
        return METRICS[market][name]()
    if name in MULTIPLES.get(market, {}):
        return F.col(name)
    raise ValueError(f"unknown metric {name!r} of {market!r}; one of {sorted({*METRICS.get(market, {}), *MULTIPLES.get(market, {})})}")


def compare(target: DataFrame, records: DataFrame, market: str, names: list[str], key: str = "cik") -> DataFrame:
    """metric, n, p25, median, p75, enough, target, share_at_or_below, reason: a target among its peers.

    Peers of another market or currency than the target's only count in ratios. ``target`` has one row; both have market and currency.
    """
    one = target.select(key, "market", "currency", *(metric(market, n).alias(n) for n in names))
    every = records.select(key, "market", "currency", *(metric(market, n).alias(n) for n in names))
    stack = lambda df, *more: df.select(key, "market", "currency", *more, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select(key, "market", "currency", *more, "m.*")
    asked = stack(one).select("metric", F.col("value").alias("target"), F.col("market").alias("_m"), F.col("currency").alias("_c"), F.col(key).alias("_k"))
    rows = stack(every).join(F.broadcast(asked), "metric")  # a row for each metric
    may = peers.comparison_scope(F.col("_m"), F.col("_c"), F.col("market"), F.col("currency"))
    ratio, scale = F.col("metric").rlike("margin|cagr|yoy"), F.col("metric").rlike("scale")
    allowed = F.when(ratio, may["ratios"]).when(scale, may["scale"]).otherwise(may["multiples"])
    usable = rows.where(allowed & (F.col(key) != F.col("_k")))
    found = peers.distribution(usable, ["metric"], "value")
    below = usable.where("value is not null").groupBy("metric").agg(F.avg((F.col("value") <= F.col("target")).cast("double")).alias("share_at_or_below"))
    out = asked.select("metric", "target").join(found, "metric", "left").join(below, "metric", "left")
    reason = F.when(F.col("n").isNull(), "no comparable peers").when(~F.col("enough"), "too few peers").when(F.col("target").isNull(), "target has no value")
    return out.select("metric", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "p25", "median", "p75", F.coalesce("enough", F.lit(False)).alias("enough"), "target", "share_at_or_below", reason.alias("reason"))
