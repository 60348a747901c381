"""Statement rows from word boxes by geometry: lines, columns, two sides, labels, notes and values.

Words have page keys, x0 (0 to 1 across the page), top, bottom, seq and text. Every step groups by page or by a block of one, which are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import amount, looks_like_amount, repair_amount, row_number_like
from . import layout

#: Label columns this near are one group; groups this far apart are two sides.
MERGE_GAP, SIDE_GAP = 0.15, 0.22
#: Words of the two sides of a balance sheet, and how many each side must have.
LEFT_WORDS = ["资产", "货币资金", "应收账款", "应收票据", "存货", "预付款项", "其他应收款", "流动资产"]
RIGHT_WORDS = ["负债", "应付账款", "应付票据", "预收款项", "合同负债", "所有者权益", "股东权益", "应付职工薪酬", "应交税费"]
SIDE_WORDS = 2


def value_like(text: Column) -> Column:
    """Whether a cell stands where values stand, even if it can't be read for sure: an amount, a dash, a line number, or nearly an amount."""
    status = amount(text)["status"]
    return status.isin("ok", "dash", "repaired") | row_number_like(text) | ((status == "suspect") & looks_like_amount(text))


def cells(words: DataFrame, page: list[str]) -> DataFrame:
    """page, line, x, text, seq, anchors, col: words of each line with their column, the nearest anchor; blank words go.

    Anchors are found once for the page; ``columns`` finds them again for a part of it.
    """
    placed = layout.lines(words.where(F.trim("text") != ""), page).select(*page, "line", F.col("x0").alias("x"), F.trim("text").alias("text"), "seq")
    return columns(placed, page)


def columns(placed: DataFrame, block: list[str]) -> DataFrame:
    """Adds anchors and col to words of a block; columns of these names are replaced."""
    placed = placed.drop("anchors", "col")
    anchors = placed.groupBy(*block).agg(layout.column_anchors(F.collect_set("x")).alias("anchors"))
    near = F.transform("anchors", lambda a: F.abs(a - F.col("x")))
    return placed.join(anchors, block).withColumn("col", (F.array_position(near, F.array_min(near)) - 1).cast("int"))


def side_cuts(celled: DataFrame, page: list[str]) -> DataFrame:
    """page, cut: where a page of two tables side by side parts; a row only for pages that do.

    A label column has three cells or more, half of them no values. Label columns nearer than MERGE_GAP are one group; the second group must
    begin SIDE_GAP or more right of the first one's end. Each side must have SIDE_WORDS words of its own, and the right one cells on a quarter of the lines and
    three at least; else it's one table whose totals are set further right.
    """
    of_column = celled.groupBy(*page, "col").agg(F.count(F.lit(1)).alias("n"), F.avg((~value_like(F.col("text"))).cast("double")).alias("share"), F.first(F.get("anchors", F.col("col"))).alias("anchor"))
    w = Window.partitionBy(*page).orderBy("col")
    labels = of_column.where("n >= 3 and share >= 0.5").withColumn("gap", F.col("anchor") - F.lag("anchor").over(w))
    labels = labels.withColumn("grp", F.sum(F.coalesce((F.col("gap") > MERGE_GAP).cast("int"), F.lit(0))).over(w))
    ends = labels.groupBy(*page).agg(F.max(F.when(F.col("grp") == 0, F.col("anchor"))).alias("left"), F.min(F.when(F.col("grp") == 1, F.col("anchor"))).alias("right"))
    cuts = ends.where(F.col("right") - F.col("left") >= SIDE_GAP).select(*page, (F.col("right") - layout.COLUMN_GAP).alias("cut"))

    sided = celled.join(cuts, page)
    right = F.col("x") >= F.col("cut")
    has = lambda w, side: F.bool_or(side & F.contains("text", F.lit(w))).cast("int")
    judged = sided.groupBy(*page, "cut").agg(
        sum((has(x, ~right) for x in LEFT_WORDS), F.lit(0)).alias("l"), sum((has(x, right) for x in RIGHT_WORDS), F.lit(0)).alias("r"),
        F.count_distinct("line").alias("lines"), F.count_distinct(F.when(right, F.col("line"))).alias("right_lines"), F.max(F.size("anchors")).alias("columns"),
    )
    fits = (F.col("l") >= SIDE_WORDS) & (F.col("r") >= SIDE_WORDS) & (F.col("columns") >= 3) & (F.col("right_lines") >= F.greatest(F.lit(3), F.floor(F.col("lines") / 4)))
    return judged.where(fits).select(*page, "cut")


def table_rows(words: DataFrame, page: list[str]) -> DataFrame:
    """page, side, line, label, note, current, prior: the rows of each page, two-sided pages side after side.

    In each block, the columns that hold values in half of their cells or more begin right of the labels; one of them with line numbers is the note. The last two values of
    a line count, the current one first. Amounts that are certainly misread are mended, doubtful ones get a mark in front. A line without label
    has a NULL label, one without values none; a block without a value column gives no rows.
    """
    celled = cells(words, page)
    cuts = side_cuts(celled, page)
    sided = celled.join(cuts, page, "left").withColumn("side", F.coalesce((F.col("x") >= F.col("cut")).cast("int"), F.lit(0))).drop("cut")
    block = [*page, "side"]
    celled = columns(sided, block)
    of_column = celled.groupBy(*block, "col").agg(F.count(F.lit(1)).alias("n"), F.avg(value_like(F.col("text")).cast("double")).alias("numeric"), F.avg(row_number_like(F.col("text")).cast("double")).alias("small"))
    numeric = of_column.where("numeric >= 0.5").groupBy(*block).agg(F.min("col").alias("first"), F.min(F.when((F.col("n") >= 3) & (F.col("small") >= 0.7), F.col("col"))).alias("note_col"), F.collect_set("col").alias("numeric"))
    told = celled.join(numeric, block)

    t, status = F.col("text"), amount(F.col("text"))["status"]
    shown = F.when((status == "suspect") & looks_like_amount(t), F.concat(F.lit("？"), t)).when(status == "repaired", F.coalesce(repair_amount(t), t)).otherwise(t)
    is_note = F.coalesce(F.col("col") == F.col("note_col"), F.lit(False))
    is_value = F.array_contains("numeric", F.col("col")) & ~is_note & ~(F.col("note_col").isNull() & row_number_like(t))
    place = [F.col("col").alias("col"), F.col("x").alias("x"), F.col("seq").alias("seq")]
    held = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(*place, v.alias("v"))))), lambda s: s["v"])
    rows = told.groupBy(*block, "line").agg(held(F.col("col") < F.col("first"), t).alias("label"), held(is_note, t).alias("note"), held(is_value, shown).alias("values"))
    last = lambda k: F.coalesce(F.get("values", F.size("values") - k), F.lit(""))
    label = F.nullif(F.trim(F.array_join("label", "  ")), F.lit(""))
    return rows.where(label.isNotNull() | (F.size("values") > 0)).select(*block, "line", label.alias("label"), F.array_join("note", "  ").alias("note"), last(2).alias("current"), last(1).alias("prior"))


def read_statements(words: DataFrame, doc: str, page: str, rules: DataFrame) -> DataFrame:
    """doc, way, page, r, label, field, via, value, prior: a document's rows, read in the way that maps most of them.

    Ways: ``boxes`` by geometry, ``flow`` from the lines' text. On a tie boxes are kept. A row's place ``r`` is unique in its document and way.
    """
    from ..functions.numbers import lenient_number
    from . import labels, loading, notes

    order = Window.partitionBy(doc).orderBy(page, "side", "line")
    boxed = table_rows(words, [doc, page]).select(doc, page, "label", "current", "prior", F.lit("boxes").alias("way"), F.row_number().over(order).alias("r"))
    text = layout.line_texts(words, [doc, page]).groupBy(doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("t"))
    flow = text.select(doc, page, F.posexplode_outer(notes.text_flow(F.col("t"), notes.account_names())).alias("at", "x")).where("at is not null").select(doc, page, "x.label", "x.current", "x.prior", F.lit("flow").alias("way"), (F.col(page) * 100_000 + F.col("at")).cast("int").alias("r"))
    mapped = labels.identify(boxed.unionByName(flow), rules)
    best = loading.best_reading(mapped, doc, "way", ["boxes", "flow"])
    return best.select(doc, "way", page, "r", "label", "field", "via", lenient_number(F.col("current")).alias("value"), lenient_number(F.col("prior")).alias("prior"))
