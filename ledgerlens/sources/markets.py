"""Records of mainland and Hong Kong listed companies and price rows, from landing-zone JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import filer_key

#: Concept, table and candidate columns in order, as the public report interface names them.
CN_CONCEPTS = [
    ("revenue", "income", ["TOTAL_OPERATE_INCOME", "OPERATE_INCOME"]),
    ("net_income_parent", "income", ["PARENT_NETPROFIT"]),
    ("operating_income", "income", ["OPERATE_PROFIT"]),
    ("equity_parent", "balance", ["TOTAL_PARENT_EQUITY"]),
    ("equity", "balance", ["TOTAL_EQUITY"]),
]
#: Report templates of industries in the order in which they are tried.
CN_TEMPLATES = [("general", "GINCOME", "GBALANCE"), ("bank", "BINCOME", "BBALANCE"), ("insurer", "IINCOME", "IBALANCE"), ("broker", "SINCOME", "SBALANCE")]
#: Hong Kong figures and their columns; the last five aren't percentages of one.
HK_FIELDS = {
    "revenue": "OPERATE_INCOME", "operating_income": "OPERATE_PROFIT", "net_income": "HOLDER_PROFIT", "total_assets": "TOTAL_ASSETS", "equity_parent": "TOTAL_PARENT_EQUITY", "net_margin": "NET_PROFIT_RATIO",
    "gross_margin": "GROSS_PROFIT_RATIO", "revenue_yoy": "OPERATE_INCOME_YOY", "eps_ttm": "EPS_TTM", "bps": "BPS", "pe": "PE_TTM", "pb": "PB_TTM",
}
PERCENT_FIELDS = ["net_margin", "gross_margin", "revenue_yoy"]


def number(raw: Column) -> Column:
    """A JSON value as double; texts that aren't numbers and truth values are NULL (M4)."""
    s = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    return F.when(~F.lower(s).isin("true", "false", ""), s.try_cast("double"))


def pick(row: Column, candidates: list[str]) -> Column:
    """struct<field, value, note> of the first candidate that a map has a value for; one that isn't a number stops the search."""
    field = F.lit(None).cast("string")
    for c in reversed(candidates):
        field = F.when(F.try_element_at(row, F.lit(c)).isNotNull(), c).otherwise(field)
    raw = F.try_element_at(row, field)
    value = number(raw)
    return F.struct(field.alias("field"), value.alias("value"), F.when(field.isNull(), "no such field").when(value.isNull(), F.concat(F.lit("not a number: "), raw)).alias("note"))


def detect_template(rows: DataFrame, key: str = "secucode") -> DataFrame:
    """key, template: the first whose balance sheet has rows (A24). ``rows``: key, suffix."""
    order, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (n, _, balance) in enumerate(CN_TEMPLATES):
        order, name = F.when(F.col("suffix") == balance, k).otherwise(order), F.when(F.col("suffix") == balance, n).otherwise(name)
    return rows.where(order.isNotNull()).groupBy(key).agg(F.min_by(name, order).alias("template"))


def cn_records(income: DataFrame, balance: DataFrame, key: str = "secucode") -> DataFrame:
    """One record for each company and period: values by concept, gaps and notes.

    ``income`` and ``balance``: key, report_date, row (map of strings). Paired by period, a period that one table lacks stays
    and says so; there is no falling back to another period.
    """
    i = income.select(key, "report_date", F.col("row").alias("income"))
    b = balance.select(key, "report_date", F.col("row").alias("balance"))
    both = i.join(b, [key, "report_date"], "full")
    picked = [F.struct(F.lit(c).alias("concept"), F.lit(t).alias("table"), F.col(t).isNull().alias("absent"), pick(F.col(t), names).alias("p")) for c, t, names in CN_CONCEPTS]
    rows = both.withColumn("_p", F.array(*picked))
    entries = F.transform("_p", lambda x: F.struct(x["concept"], F.struct(x["p"]["value"].alias("value"), x["p"]["field"].alias("field"), x["table"].alias("table"))))
    reason = lambda x: F.when(x["absent"], F.concat(x["table"], F.lit(" not disclosed for the period"))).otherwise(x["p"]["note"])
    gaps = F.transform(F.filter("_p", lambda x: x["p"]["value"].isNull()), lambda x: F.concat(x["concept"], F.lit(": "), reason(x)))
    return rows.select(key, "report_date", F.map_from_entries(entries).alias("values"), gaps.alias("gaps"))


def hk_rows(raw: DataFrame, row: str = "row") -> DataFrame:
    """code, period, fields (map of figures) from raw rows with code, report_date and a map of strings."""
    m = F.create_map(*(x for name, column in HK_FIELDS.items() for x in (F.lit(name), number(F.try_element_at(F.col(row), F.lit(column))))))
    return raw.select("code", F.col("report_date").alias("period"), F.map_filter(m, lambda k, v: v.isNotNull()).alias("fields"))


def history(rows: DataFrame, n: int = 4, code: str = "code", period: str = "period") -> DataFrame:
    """The last ``n`` periods of each company (A25); with n = 1 the latest."""
    w = Window.partitionBy(code).orderBy(F.desc(period))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def visible(rows: DataFrame, as_of: Column, period: str = "period") -> DataFrame:
    """Rows whose period ended by a date (Q3): visible by period, not by filing."""
    return rows.where(F.col(period) <= as_of)


def bars_from_objects(rows: DataFrame, value: str = "value") -> DataFrame:
    """code, row: bars given as objects, in the common row form."""
    o = F.from_json(F.col(value), "struct<day:string, open:string, close:string, high:string, low:string, volume:string>")
    return rows.select("code", F.concat_ws(",", o["day"], o["open"], o["close"], o["high"], o["low"], F.coalesce(o["volume"], F.lit("0"))).alias("row")).where(o["day"].isNotNull() & o["close"].isNotNull())


def bars_from_lists(rows: DataFrame, value: str = "value") -> DataFrame:
    """code, row: bars given as lists of six or more, in the common row form."""
    a = F.from_json(F.col(value), "array<string>")
    return rows.select("code", a.alias("_a")).where(F.size("_a") >= 6).select("code", F.array_join(F.slice("_a", 1, 6), ",").alias("row"))


def frames(raw: DataFrame, value: str = "value") -> DataFrame:
    """One tag and period over all filers: tag, cik, end, val, accn."""
    d = F.from_json(F.col(value), "struct<tag:string, data:array<struct<cik:long, end:string, val:double, accn:string>>>")
    rows = raw.select(d["tag"].alias("tag"), F.explode(d["data"]).alias("r"))
    return rows.select("tag", filer_key(F.col("r.cik")).alias("cik"), F.try_to_date("r.end", "yyyy-MM-dd").alias("end"), "r.val", "r.accn")


def fresh(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Landing files younger than so many hours."""
    return files.where(F.col("modified") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
