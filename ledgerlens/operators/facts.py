"""Bitemporal fact series: period ends, filing dates, restatements and tag fallback.

A fact table has a key (filer), tag, unit, optional start, end, val, filed and a
sequence column ``seq`` for the order in which rows were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import duration_between

#: Revenue tags in the order in which they are tried.
REVENUE_TAGS = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet"]
#: Parts of net debt: concept, tags in order, sign.
NET_DEBT_PARTS = {
    "total_debt": ["LongTermDebt"],
    "current_debt": ["LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings"],
    "noncurrent_debt": ["LongTermDebtNoncurrent"],
    "finance_lease": ["FinanceLeaseLiability"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "short_investments": ["ShortTermInvestments", "MarketableSecuritiesCurrent"],
}


def series(facts: DataFrame, duration: str | int | None = "annual") -> DataFrame:
    """Facts with a value and an end whose span fits; ``instant`` wants no start."""
    kept = facts.where(F.col("val").isNotNull() & F.col("end").isNotNull())
    if duration is None:
        return kept
    if duration == "instant":
        return kept.where(F.col("start").isNull())
    return kept.where(duration_between(F.datediff("end", "start"), duration))


def latest_filed(facts: DataFrame, keys: list[str], end: str = "end", filed: str = "filed", seq: str = "seq") -> DataFrame:
    """One row for each key and period end: the last filed, the first read of equal ones.

    An aggregation with map-side combining, not a sort of each group.
    """
    rest = [c for c in facts.columns if c not in (*keys, end)]
    best = F.max_by(F.struct(*rest), F.struct(F.col(filed), -F.col(seq))).alias("_b")
    return facts.groupBy(*keys, end).agg(best).select(*keys, end, "_b.*").select(facts.columns)


def first_filed(facts: DataFrame, keys: list[str], end: str = "end", filed: str = "filed") -> DataFrame:
    """When each period was first disclosed."""
    return facts.groupBy(*keys, end).agg(F.min(filed).alias("first_filed"))


def disclosed_by(facts: DataFrame, keys: list[str], as_of: Column, end: str = "end", filed: str = "filed", seq: str = "seq", value_as_filed: bool = True) -> DataFrame:
    """The series as one could know it at ``as_of``.

    A period is visible if first filed by then. With ``value_as_filed`` so is each value, which
    keeps later restatements out; without, the value is the last filed whenever that was (Q16).
    """
    seen = facts.where(F.col(filed) <= as_of)
    if value_as_filed:
        return latest_filed(seen, keys, end, filed, seq)
    return latest_filed(facts, keys, end, filed, seq).join(seen.select(*keys, end).distinct(), [*keys, end], "left_semi")


def latest_period(facts: DataFrame, keys: list[str], as_of: Column, end: str = "end", filed: str = "filed") -> DataFrame:
    """The last period end first disclosed by ``as_of``, for each key."""
    return facts.where((F.col(filed) <= as_of) & (F.col(end) <= as_of)).groupBy(*keys).agg(F.max(end).alias("latest_end"))


def priority(tag: Column, tags: list[str]) -> Column:
    """Place of a tag in its fallback order; NULL if it isn't in it."""
    out = F.when(tag == tags[0], 0)
    for k, t in enumerate(tags[1:], 1):
        out = out.when(tag == t, k)
    return out


def first_tag(facts: DataFrame, keys: list[str], tags: list[str], tag: str = "tag", val: str = "val", tie: str | None = None) -> DataFrame:
    """keys, val, tag_used: the value of the first tag in the order that has one for that key."""
    p = priority(F.col(tag), tags)
    order = F.struct(p, F.col(tie)) if tie else p
    chosen = facts.where(p.isNotNull() & F.col(val).isNotNull())
    return chosen.groupBy(*keys).agg(F.min_by(F.struct(F.col(val).alias("val"), F.col(tag).alias("tag_used")), order).alias("_b")).select(*keys, "_b.*")


def nearest_instant(facts: DataFrame, keys: list[str], tags: list[str], as_of: Column, tag: str = "tag") -> DataFrame:
    """The last instant by ``as_of`` over several tags; earlier listed, then earlier filed wins on one date."""
    p = priority(F.col(tag), tags)
    chosen = facts.where(p.isNotNull() & F.col("val").isNotNull() & F.col("start").isNull() & (F.col("end") <= as_of))
    order = F.struct((-F.unix_date("end")).alias("e"), p.alias("p"), F.col("filed"), F.col("seq"))
    return chosen.groupBy(*keys).agg(F.min_by(F.struct("end", "val", F.col(tag).alias("tag_used")), order).alias("_b")).select(*keys, "_b.*")


def growth(values: DataFrame, keys: list[str], end: str = "end", val: str = "val", years: int = 3) -> DataFrame:
    """Annual growth from the row ``years`` before the last to the last, by days / 365.25.

    keys, first_end, last_end, years_span, cagr; NULL unless both ends are positive.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(end))
    placed = values.where(F.col(val).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r").isin(1, years + 1))
    ends = placed.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(end))).alias("last_end"), F.max(F.when(F.col("_r") == 1, F.col(val))).alias("_last"),
        F.max(F.when(F.col("_r") == years + 1, F.col(end))).alias("first_end"), F.max(F.when(F.col("_r") == years + 1, F.col(val))).alias("_first"),
    )
    span = F.datediff("last_end", "first_end") / F.lit(365.25)
    fits = (F.col("_first") > 0) & (F.col("_last") > 0) & (span > 0)
    return ends.where(F.col("first_end").isNotNull()).select(*keys, "first_end", "last_end", span.alias("years_span"), F.when(fits, F.pow(F.col("_last") / F.col("_first"), 1 / span) - 1).alias("cagr"))


def consecutive_growth(values: DataFrame, keys: list[str], year: str = "year", val: str = "val", years: int = 3) -> DataFrame:
    """Growth by whole years; only where every year between is there."""
    last = values.groupBy(*keys).agg(F.max(year).alias("_y"))
    span = values.join(last, keys).where(F.col(year) >= F.col("_y") - years)
    ends = span.groupBy(*keys).agg(F.countDistinct(year).alias("_n"), F.max_by(val, year).alias("_last"), F.min_by(val, year).alias("_first"))
    fits = (F.col("_n") == years + 1) & (F.col("_first") > 0) & (F.col("_last") > 0)
    gap = F.when(F.col("_n") != years + 1, "years not consecutive").when(~((F.col("_first") > 0) & (F.col("_last") > 0)), "not positive")
    return ends.select(*keys, F.when(fits, F.pow(F.col("_last") / F.col("_first"), F.lit(1.0 / years)) - 1).alias("cagr"), gap.alias("gap"))


def net_debt(parts: DataFrame) -> DataFrame:
    """Adds net_debt to rows with the NET_DEBT_PARTS columns.

    Total debt, or current and non-current debt, and finance leases, less cash and short
    investments. NULL without cash or without any debt item; never both the total and its parts.
    """
    c = {k: F.col(k) for k in NET_DEBT_PARTS}
    split = F.when(c["current_debt"].isNotNull() | c["noncurrent_debt"].isNotNull(), F.coalesce(c["current_debt"], F.lit(0.0)) + F.coalesce(c["noncurrent_debt"], F.lit(0.0)))
    debt = F.coalesce(c["total_debt"], split)
    any_debt = F.coalesce(debt, c["finance_lease"])
    total = F.coalesce(debt, F.lit(0.0)) + F.coalesce(c["finance_lease"], F.lit(0.0)) - c["cash"] - F.coalesce(c["short_investments"], F.lit(0.0))
    gap = F.when(c["cash"].isNull(), "no cash").when(any_debt.isNull(), "no debt item")
    return parts.withColumn("net_debt", F.when(gap.isNull(), total)).withColumn("gap", gap)


def pivot_concepts(facts: DataFrame, keys: list[str], concepts: dict[str, list[str]], tag: str = "tag", val: str = "val") -> DataFrame:
    """One row for each key with a column for each concept, by its tag order: one shuffle for all of them."""
    aggs = []
    for name, tags in concepts.items():
        p = priority(F.col(tag), tags)
        aggs.append(F.min_by(F.when(p.isNotNull(), F.col(val)), F.when(F.col(val).isNotNull(), p)).alias(name))
    return facts.groupBy(*keys).agg(*aggs)
