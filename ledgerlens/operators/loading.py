"""Statements from sheets, pages and files: grids to labelled rows, rows to fields, fields to one row for each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lenient_number, row_number_like
from ..functions.text import free_name, normal_form, simplified, word_hits
from . import layout, statements
from .derived import pivot_fields

#: Lines that a statement has and a discussion of it doesn't.
DETAIL_LINES = {
    "balance": [
        "货币资金", "应收账款", "存货", "固定资产", "应付账款", "短期借款", "预付款项", "其他应收款", "应付职工薪酬", "应交税费",
        "cash and cash equivalents", "cash and bank balances", "trade receivables", "inventories", "property, plant and equipment",
        "loans and advances", "insurance contract liabilities", "insurance contract assets", "financial investments",
    ],
    "income": [
        "营业成本", "税金及附加", "销售费用", "管理费用", "研发费用", "财务费用", "资产减值损失", "信用减值损失", "其他收益",
        "cost of sales", "gross profit", "operating expenses", "insurance revenue", "insurance service expenses", "administrative expenses", "finance costs", "interest income",
    ],
    "cash_flow": [
        "销售商品、提供劳务收到的现金", "收到的税费返还", "购买商品、接受劳务支付的现金", "支付给职工以及为职工支付的现金", "支付的各项税费",
        "收回投资收到的现金", "取得投资收益收到的现金", "购建固定资产", "取得借款收到的现金", "偿还债务支付的现金",
        "分配股利、利润或偿付利息支付的现金", "收到的其他与经营活动有关的现金",
        "cash generated from operations", "cash received from customers", "payments to suppliers", "payments to employees", "income tax paid",
        "interest received", "dividends received", "purchases of investments", "proceeds from disposal of investments",
    ],
}
LINE_POINTS, MIN_ROWS = 25, 2


@dataclass(frozen=True)
class Against:
    """What speaks against a page: a pattern in its first ``head`` characters (0: anywhere), unless it also has ``unless``, and what it costs."""

    pattern: str
    cost: int
    head: int = 0
    unless: str = ""


#: A parent company's statement; a segment report; a table of changes in the management's discussion.
AGAINST = [
    Against(r"母公司\s*(资产负债表|利润表|现金流量表|损益表)", 60, unless="合并"),
    Against(r"分部报告|分部間|分部利润|分部分析|分部資料|segment information|segment results", 80, head=200),
    Against(r"情况说明|变动原因|变动比例|变动情况|主要原因|management discussion and analysis|change \(%\)", 100, head=300),
]


def plausible_label(text: Column) -> Column:
    """Whether a cell can be a row's label: no digits or Latin letters, no colon at its end."""
    return F.coalesce((F.trim(text) != "") & ~text.rlike("[0-9A-Za-z]") & ~F.trim(text).rlike("[:：]$"), F.lit(False))


def dense_with_numbers(cells: DataFrame, page: list[str], text: str = "text", share: float = 0.5) -> DataFrame:
    """page, share, dense: whether numbers are half of a page's filled cells or more."""
    filled = cells.where(F.trim(F.col(text)) != "").groupBy(*page).agg(F.avg(lenient_number(F.col(text)).isNotNull().cast("double")).alias("share"))
    return filled.withColumn("dense", F.col("share") >= share)


def column_kinds(cells: DataFrame, sheet: list[str], column: str = "c", value: str = "value") -> DataFrame:
    """sheet, column, numeric, note (G32): half numbers or more; a column of line numbers has seven in ten small integers and three cells."""
    v = F.col(value)
    filled = cells.where(F.trim(v) != "").groupBy(*sheet, column).agg(F.count(F.lit(1)).alias("n"), F.avg(lenient_number(v).isNotNull().cast("double")).alias("_num"), F.avg(row_number_like(v).cast("double")).alias("_small"))
    return filled.select(*sheet, column, (F.col("_num") >= 0.5).alias("numeric"), ((F.col("_small") >= 0.7) & (F.col("n") >= 3)).alias("note"))


def lower_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the lower of the two middle values where their number is even."""
    return values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("median"))


def image_resolution(images: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """page, dpi: the lower median resolution of the images that cover half of their page or more.

    ``images``: page keys, width_px, width_pt, height_pt, page_width_pt, page_height_pt. Pages without such an image are left out.
    """
    cover = F.col("width_pt") * F.col("height_pt") / (F.col("page_width_pt") * F.col("page_height_pt"))
    wide = images.where((F.col("width_pt") > 0) & (cover >= least)).withColumn("_dpi", F.round(F.col("width_px") * 72 / F.col("width_pt")).cast("int"))
    return lower_median(wide, page, "_dpi").select(*page, F.col("median").cast("int").alias("dpi"))


def page_evidence(pages: DataFrame, text: str = "text", rows: str = "rows") -> DataFrame:
    """balance, income and cash_flow scores of each page, with what speaks for and against it.

    Texts are simplified first. A kind that two groups of markers or more speak for gets LINE_POINTS for each of its detail lines and loses what AGAINST says; few
    detail lines cost nothing, and a score may fall below 0. A page with fewer than MIN_ROWS table rows, or none known, has 0.
    """
    simple, low, cost = (free_name(pages, c) for c in ("_text", "_low", "_cost"))
    t = F.col(simple)
    scored = statements.statement_scores(pages.withColumn(simple, simplified(F.coalesce(F.col(text), F.lit("")))), simple)

    def price(a: Against) -> Column:
        head = F.substring(t, 1, a.head) if a.head else t
        hit = head.rlike(f"(?i){a.pattern}")
        return F.when(hit & ~F.contains(t, F.lit(a.unless)) if a.unless else hit, a.cost).otherwise(0)

    scored = scored.withColumns({low: F.lower(t), cost: sum(map(price, AGAINST), F.lit(0))})
    for kind, lines in DETAIL_LINES.items():
        hits = F.get(word_hits(F.col(low), [lines]), F.lit(0))
        counts = (F.col(kind) > 0) & (F.coalesce(F.col(rows), F.lit(0)) >= MIN_ROWS)
        scored = scored.withColumn(kind, F.when(counts, F.col(kind) + LINE_POINTS * hits - F.col(cost)).otherwise(0))
    return scored.drop(simple, low, cost)


def evidence_text(pages: DataFrame, picked: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """doc, evidence: the text of the pages picked for statements, in order, from which standard and scope are read."""
    kept = pages.join(picked.select(doc, page).distinct(), [doc, page], "left_semi")
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: F.coalesce(x["t"], F.lit(""))), "\n").alias("evidence"))


def statement_rows(cells: DataFrame, sheet: list[str], stmt: Column | None = None) -> DataFrame:
    """sheet, r, label, field, via, value, prior[, stmt, owned]: a grid's rows with numbers read and labels mapped.

    ``cells``: sheet keys, r, c, value. Labels are compared in their normal, simplified form.
    """
    rows = layout.grid_rows(cells, sheet)
    read = rows.select(*sheet, "r", "label", lenient_number(F.col("current")).alias("value"), lenient_number(F.col("prior")).alias("prior"))
    mapped = statements.identify(read.withColumn("_l", simplified(normal_form(F.col("label")))), "_l").drop("_l")
    return mapped if stmt is None else statements.owned_rows(mapped.withColumn("stmt", stmt))


def mappable_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mappable: rows whose label has a field, by which one way of reading a file is preferred to another."""
    return rows.groupBy(*keys).agg(F.count_if(F.col("field").isNotNull()).alias("mappable"))


def best_reading(readings: DataFrame, doc: str, way: str, order: list[str]) -> DataFrame:
    """Of several ways to read a document the rows of the one with most mappable rows, earlier in ``order`` on a tie."""
    n = mappable_rows(readings, [doc, way])
    place = F.array_position(F.array(*map(F.lit, order)), F.col(way))
    best = n.groupBy(doc).agg(F.max_by(way, F.struct("mappable", -place)).alias(way))
    return readings.join(best, [doc, way], "left_semi")


def document_fields(rows: DataFrame, doc: str, fields: list[str], order: str = "r") -> DataFrame:
    """One row for each document with the first value of each field, of owned rows where that is known."""
    own = rows.where(F.col("owned")) if "owned" in rows.columns else rows
    return pivot_fields(own, doc, fields, seq=order)


def row_in(rows: DataFrame, doc: str, stmt: str, patterns: list[str], order: str = "r") -> DataFrame:
    """doc, label, value: the first row of one statement whose label has one of the words."""
    hit = F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("label"), p))
    return rows.where((F.col("stmt") == stmt) & hit & F.col("value").isNotNull()).groupBy(doc).agg(F.min_by(F.struct("label", "value"), order).alias("_b")).select(doc, "_b.*")


def markdown(cells: DataFrame, table: list[str], r: str = "r", c: str = "c", value: str = "value") -> DataFrame:
    """table, markdown: a grid as a table in markdown, its first row as header; bars in cells are escaped."""
    cell = F.replace(F.regexp_replace(F.coalesce(F.col(value), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    lines = cells.groupBy(*table, r).agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("c"), cell.alias("v")))).alias("_c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("_c", lambda x: x["v"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("_c")))
    rows = lines.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct(F.col(r).alias("r"), line.alias("line"), rule.alias("rule")))).alias("_r"))
    body = F.transform("_r", lambda x, i: F.when(i == 0, F.concat(x["line"], F.lit("\n"), x["rule"])).otherwise(x["line"]))
    return rows.select(*table, F.array_join(body, "\n").alias("markdown"))


def net_debt_derivable(df: DataFrame) -> DataFrame:
    """Adds derivable and net_debt_reason: whether statements give net debt, and why not."""
    none = F.coalesce(*(F.col(c) for c in ("cash", "short_term_debt", "long_term_debt", "total_liabilities") if c in df.columns)).isNull()
    reason = F.when(none, "no balance sheet").when(F.col("net_debt").isNull(), "no debt or no cash row")
    return df.withColumn("derivable", reason.isNull()).withColumn("net_debt_reason", reason)
