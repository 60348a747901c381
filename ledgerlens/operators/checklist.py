"""Questions and references before an appraisal: the assumptions of a discounted flow, metric references, analysis and advice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import derived, valuation

#: Assumptions of a discounted flow: key, group, who provides it, what it is checked against, column that a history may fill it from.
ASSUMPTIONS = [
    ("revenue_growth", "revenue", "external", "past growth and that of peers", "revenue_growth"),
    ("terminal_growth", "revenue", "user", "long-term nominal growth and inflation", None),
    ("revenue_driver", "revenue", "user", "volumes and prices by product", None),
    ("ebitda_margin", "cost", "history", "past margins and those of peers", "ebitda_margin"),
    ("da_pct", "cost", "history", "past depreciation and the asset register", "da_share"),
    ("capex_pct", "investment", "history", "past spending and plans", "capex_share"),
    ("nwc_pct", "investment", "history", "past working capital", "nwc_share"),
    ("tax_rate", "tax", "history", "implied rate within its bounds", "tax_rate"),
    ("wacc", "rate", "external", "yields, betas and premiums at the date", None),
    ("exit_method", "terminal", "user", "whether growth or a multiple ends the plan", None),
    ("net_debt_scope", "bridge", "history", "leases, guarantees and restricted cash", "net_debt"),
    ("minority_interest", "bridge", "history", "the row of the balance sheet", "minority"),
    ("sbc", "adjustment", "user", "whether pay in shares is a cost", None),
    ("nonrecurring", "adjustment", "user", "gains and losses that do not return", None),
    ("midyear", "timing", "user", "when flows come in", None),
    ("fx", "timing", "user", "currency of flows and of the rate", None),
]
WALK_BACK_YEARS = 3


def checklist(history: DataFrame, key: str, comps_ready: Column | None = None) -> DataFrame:
    """key, seq, assumption, group, need, check, value, status for each company and assumption.

    status: from_history with a value, from_peers where external ones are ready, else ask. One row in, sixteen out.
    """
    ready = F.lit(False) if comps_ready is None else F.coalesce(comps_ready, F.lit(False))
    rows = []
    for k, (name, group, need, check, column) in enumerate(ASSUMPTIONS):
        value = F.col(column).cast("double") if column in history.columns else F.lit(None).cast("double")
        status = F.when(value.isNotNull(), "from_history").when(F.lit(need == "external") & ready, "from_peers").otherwise("ask")
        rows.append(F.struct(F.lit(k).alias("seq"), F.lit(name).alias("assumption"), F.lit(group).alias("group"), F.lit(need).alias("need"), F.lit(check).alias("check"), value.alias("value"), status.alias("status")))
    return history.select(key, F.explode(F.array(*rows)).alias("a")).select(key, "a.*")


def question_list(checked: DataFrame, key: str) -> DataFrame:
    """key, seq, question, reference, origin: what is still asked of each company, in order, with what is known beside it (H7).

    ``checked`` is a `checklist`. A value from the history is asked for confirmation, last; what peers give comes before what nobody does.
    """
    from pyspark.sql.window import Window

    origin = F.when(F.col("status") == "from_history", "confirm").when(F.col("status") == "from_peers", "peers").otherwise("open")
    rank = F.when(origin == "peers", 0).when(origin == "open", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank, "seq"))
    text = F.concat(F.col("assumption"), F.lit(": "), F.col("check"))
    return checked.select(key, place.alias("seq"), text.alias("question"), F.col("value").alias("reference"), origin.alias("origin"))


def metric_reference(statements: DataFrame, key: str) -> DataFrame:
    """key, metric, value, reason: what multiples may be put on (H11): revenue, EBIT, EBITDA, and owner's earnings with the owner's pay."""
    df = derived.ebitda(statements)
    pay = F.col("owner_pay") if "owner_pay" in df.columns else F.lit(None).cast("double")
    values = {"revenue": F.col("revenue"), "ebit": F.col("operating_income"), "ebitda": F.col("ebitda"), "sde": F.col("ebitda") + pay}
    rows = [F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"), F.when(v.isNull(), "missing row").when(v <= 0, "not positive").alias("reason")) for n, v in values.items()]
    return df.select(key, F.explode(F.array(*rows)).alias("m")).select(key, "m.*")


def analysis(statements: DataFrame, key: str) -> DataFrame:
    """key, factor, value, applicable: the return on equity and its factors, a row each."""
    d = valuation.dupont(statements)
    names = ["roe", "net_margin", "asset_turnover", "equity_multiplier", "roa"]
    rows = F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in names))
    return d.select(key, "applicable", F.explode(rows).alias("f")).select(key, "f.*", "applicable")


def advice_lines(advised: DataFrame, growth: str = "terminal_growth", gdp: float = 0.04, inflation: float = 0.02) -> DataFrame:
    """name, line: an assumption beside its peers in a sentence, with what is wrong with a perpetual growth rate.

    ``advised``: name, value, n, median, share_at_or_below.
    """
    v = F.col("value")
    wrong = F.when(F.col("name") == growth, F.array_join(valuation.terminal_growth_problems(v, F.lit(gdp), F.lit(inflation)), "; "))
    placed = F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, F.concat(F.lit("peers "), F.col("n").cast("string"), F.lit(", median "), F.format_number("median", 4), F.lit(", at or below "), F.format_number(100 * F.col("share_at_or_below"), 1), F.lit("%"))).otherwise("no peers")
    return advised.select("name", F.concat_ws(" | ", "name", F.format_number("value", 4), placed, F.nullif(wrong, F.lit(""))).alias("line"))


def listed_multiples(records: DataFrame, quotes: DataFrame, year: int, key: str = "code") -> DataFrame:
    """key, fiscal_year, pe, pb, price_to_revenue, gap: statements of the year or of up to three before, times the quote's shares and price.

    ``records``: key, fiscal_year, net_income_parent, equity_parent, revenue; ``quotes``: key, price, shares. The last year with any of
    the three figures counts; a company without one, or without a quote, stays and says so.
    """
    from .comps import MULTIPLES
    from .peers import multiples

    usable = records.where(F.col("fiscal_year").between(year - WALK_BACK_YEARS, year) & F.coalesce("net_income_parent", "equity_parent", "revenue").isNotNull())
    last = usable.groupBy(key).agg(F.max_by(F.struct("fiscal_year", "net_income_parent", "equity_parent", "revenue"), "fiscal_year").alias("_r")).select(key, "_r.*")
    every = records.select(key).unionByName(quotes.select(key)).distinct()
    whole = every.join(last, key, "left").join(quotes, key, "left").withColumn("_none", F.lit(0.0))
    got = multiples(whole, "price", "shares", "_none", MULTIPLES["cn"])
    gap = F.when(F.col("fiscal_year").isNull(), F.lit(f"no statement of {year - WALK_BACK_YEARS} to {year}")).otherwise(F.get("gaps", F.lit(0)))
    return got.select(key, "fiscal_year", "pe", "pb", "price_to_revenue", gap.alias("gap"))


def football_html(band_rows: DataFrame, width: int = 600) -> DataFrame:
    """entity, html: the bands of an entity as bars on one scale (B8); methods without a band say why. Names are escaped."""
    scale = band_rows.groupBy("entity").agg(F.min("band_low").alias("_lo"), F.max("band_high").alias("_hi"))
    def safe(text: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    escaped = safe(F.col("method"))
    px = lambda x: F.round((x - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * width).cast("int").cast("string")
    bar = F.concat(F.lit('<tr><td>'), escaped, F.lit('</td><td><div style="margin-left:'), px(F.col("band_low")), F.lit('px;width:'), px(F.col("band_high") - F.col("band_low") + F.col("_lo")), F.lit('px">'), F.format_number("band_mid", 2), F.lit("</div></td></tr>"))
    none = F.concat(F.lit("<tr><td>"), escaped, F.lit("</td><td>"), safe(F.coalesce("note", F.lit("no band"))), F.lit("</td></tr>"))
    rows = band_rows.join(scale, "entity").select("entity", F.struct("method", F.coalesce(bar, none).alias("row")).alias("r"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "")
    return rows.groupBy("entity").agg(F.concat(F.lit("<table>"), lines, F.lit("</table>")).alias("html"))
