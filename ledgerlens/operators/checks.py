"""Accounting identities. A check has four outcomes: holds, fails, undecidable, not_applicable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close_to

#: Labels that sum other rows, and labels of the direct method.
TOTAL_MARKS = ["合计", "小计", "总计", "total", "subtotal", "net cash", "adjustments to reconcile", "调整项目"]
DIRECT_MARKS = ["销售商品、提供劳务收到的现金", "经营活动现金流入小计", "购买商品、接受劳务支付的现金", "收到的税费返还", "cash received from customers", "cash paid to suppliers"]


def _outcome(missing: Column, ok: Column) -> Column:
    return F.when(missing, "undecidable").when(ok, "holds").otherwise("fails")


def _check(name: str, lhs: Column, rhs: Column, missing: Column, ok: Column | None = None) -> Column:
    decided = close_to(lhs, rhs) if ok is None else ok
    return F.struct(
        F.lit(name).alias("check"), _outcome(missing, decided).alias("status"), F.when(~missing, lhs).alias("lhs"), F.when(~missing, rhs).alias("rhs"), F.when(~missing, lhs - rhs).alias("diff")
    )


def _any_null(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))


def balance(assets: str = "assets", liabilities: str = "liabilities", equity: str = "equity", minority: str = "minority_interest") -> Column:
    """Assets = liabilities + equity, tried again with the minority interest (V1)."""
    a, plain = F.col(assets), F.col(liabilities) + F.col(equity)
    with_minority = plain + F.coalesce(F.col(minority), F.lit(0.0))
    return _check("balance", a, F.when(close_to(a, plain), plain).otherwise(with_minority), _any_null(assets, liabilities, equity))


def cash_rollforward(begin: str = "cash_begin", end: str = "cash_end", cfo: str = "cfo", cfi: str = "cfi", cff: str = "cff", fx: str = "fx_effect") -> Column:
    """Closing cash = opening + three flows + currency effect (V2)."""
    rhs = F.col(begin) + F.col(cfo) + F.col(cfi) + F.col(cff) + F.coalesce(F.col(fx), F.lit(0.0))
    return _check("cash_rollforward", F.col(end), rhs, _any_null(begin, end, cfo, cfi, cff))


def net_assets(net: str = "net_assets", equity: str = "equity", assets: str = "assets") -> Column:
    """Net assets = equity where a balance sheet is presented so, that is without total assets (V3, V4)."""
    c = _check("net_assets", F.col(net), F.col(equity), _any_null(net, equity))
    return F.when(F.col(assets).isNotNull(), c.withField("status", F.lit("not_applicable"))).otherwise(c)


def all_checks(statements: DataFrame, checks: list[Column], key: str) -> DataFrame:
    """A row for each check of each statement set (V7)."""
    return statements.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def all_hold(checked: DataFrame, key: str) -> DataFrame:
    """Whether every applicable check holds, and there is one."""
    applicable = F.col("status") != "not_applicable"
    return checked.groupBy(key).agg((F.bool_and(F.when(applicable, F.col("status") == "holds").otherwise(True)) & (F.count_if(applicable) > 0)).alias("all_hold"))


def is_total_label(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in TOTAL_MARKS))


def indirect_method(rows: DataFrame, heads: DataFrame, key: str, label: str = "label", value: str = "value") -> DataFrame:
    """Net income + reconciling rows = operating cash flow, sums of rows left out.

    ``heads``: key, net_income, cfo. A statement by the direct method is not applicable.
    """
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    direct = reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in DIRECT_MARKS))
    counted = ~is_total_label(F.col(label)) & F.col(value).isNotNull()
    sums = rows.groupBy(key).agg(F.sum(F.when(counted, F.col(value))).alias("adjustments"), F.count_if(counted).alias("counted"), F.count_if(is_total_label(F.col(label))).alias("skipped"), F.bool_or(direct).alias("direct"))
    both = heads.join(sums, key, "left")
    rhs = F.col("net_income") + F.coalesce(F.col("adjustments"), F.lit(0.0))
    status = F.when(F.coalesce(F.col("direct"), F.lit(False)), "not_applicable").otherwise(_outcome(_any_null("net_income", "cfo"), close_to(F.col("cfo"), rhs)))
    return both.select(key, status.alias("status"), F.col("cfo").alias("lhs"), rhs.alias("rhs"), (F.col("cfo") - rhs).alias("diff"), F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def part_of_total(part: Column, total: Column, slack: float = 0.02) -> Column:
    """Whether a part is within its total (V10, V11); NULL if either is missing."""
    return F.abs(part) <= F.abs(total) * (1 + slack)


def within_scale(a: Column, b: Column, scale: Column, ratio: float = 0.005) -> Column:
    """Whether two figures agree within a share of a scale (V9)."""
    return F.abs(a - b) <= F.abs(scale) * ratio


def attribute_gap(rows: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """The first row, by statement and place, whose amount explains a gap within 2 % or 1.

    ``rows``: key, stmt_order, row_no, label, value; ``gaps``: key, gap.
    """
    near = F.abs(F.abs(F.col("value")) - F.abs(F.col("gap"))) <= F.greatest(F.abs("gap") * 0.02, F.lit(1.0))
    hit = gaps.join(rows, key).where(near)
    return gaps.join(hit.groupBy(key).agg(F.min_by("label", F.struct("stmt_order", "row_no")).alias("explained_by")), key, "left")


def operating_income_signs(rows: DataFrame, key: str) -> DataFrame:
    """Operating income again from revenue and cost rows; if most costs are negative they are added.

    ``rows``: key, role ('revenue' or 'cost'), value.
    """
    cost, revenue = F.col("role") == "cost", F.col("role") == "revenue"
    agg = rows.where(F.col("value").isNotNull()).groupBy(key).agg(F.sum(F.when(revenue, F.col("value"))).alias("revenue"), F.sum(F.when(cost, F.col("value"))).alias("costs"), F.count_if(cost & (F.col("value") < 0)).alias("neg"), F.count_if(cost).alias("n"))
    return agg.select(key, F.when(F.col("neg") * 2 > F.col("n"), F.col("revenue") + F.col("costs")).otherwise(F.col("revenue") - F.col("costs")).alias("operating_income"), (F.col("neg") * 2 > F.col("n")).alias("costs_negative"))
