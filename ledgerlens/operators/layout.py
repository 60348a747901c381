"""Page geometry: words to lines, cells to columns, labels to amounts, grids to roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import period_key
from ..functions.numbers import amount, looks_like_amount

LINE_GAP, COLUMN_GAP, PITCH_SHARE = 3.0, 0.02, 0.55


def lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Adds center and line: a new line where the center lies more than LINE_GAP below the word before."""
    w = Window.partitionBy(*page).orderBy("center", "x0", "seq")
    out = words.withColumn("center", (F.col("top") + F.col("bottom")) / 2)
    return out.withColumn("_b", F.coalesce((F.col("center") - F.lag("center").over(w) > LINE_GAP).cast("int"), F.lit(0))).withColumn("line", F.sum("_b").over(w).cast("int")).drop("_b")


def line_texts(words: DataFrame, page: list[str]) -> DataFrame:
    """page, line, text, y: each line's words from left to right."""
    got = lines(words, page).groupBy(*page, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))).alias("_w"), F.avg("center").alias("y"))
    return got.select(*page, "line", F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("text"), "y")


def column_anchors(xs: Column, gap: float = COLUMN_GAP) -> Column:
    """Left edges of columns: a new one where x lies more than ``gap`` right of the last anchor, not of the last x."""
    return F.aggregate(F.array_sort(F.array_distinct(xs)), F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x - F.element_at(a, -1) > gap, F.concat(a, F.array(x))).otherwise(a))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def pitch(lines_: DataFrame, page: list[str]) -> DataFrame:
    """Median distance of neighbouring lines, distances up to 0.5 left out."""
    w = Window.partitionBy(*page).orderBy("y")
    d = lines_.withColumn("_d", F.col("y") - F.lag("y").over(w)).where("_d > 0.5")
    return d.groupBy(*page).agg(upper_median(F.collect_list("_d")).alias("pitch"))


def pair_labels(rows: DataFrame, page: list[str]) -> DataFrame:
    """Labels and amounts of split rows: each label takes the nearest unused amount row within 0.55 of the pitch, in order.

    ``rows``: page keys, y, label (NULL for an amount row), amount. One page is one group, small by nature; greedy
    one-to-one pairing is sequential, so it runs in Python.
    """
    schema = ", ".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in page) + ", label string, amount string"

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        ys = sorted(group["y"])
        gaps = sorted(b - a for a, b in zip(ys, ys[1:], strict=False) if b - a > 0.5)
        reach = PITCH_SHARE * (gaps[len(gaps) // 2] if gaps else 1.0)
        free = [(r.y, r.amount) for r in group.itertuples() if r.label is None]
        out = []
        for r in group[group["label"].notna()].sort_values("y").itertuples():
            near = min(free, key=lambda f: abs(f[0] - r.y), default=None)
            if near is not None and abs(near[0] - r.y) <= reach:
                free.remove(near)
                out.append((r.label, near[1]))
            else:
                out.append((r.label, None))
        return pd.DataFrame([[*(group[k].iloc[0] for k in page), *o] for o in out], columns=[*page, "label", "amount"])

    return rows.groupBy(*page).applyInPandas(pair, schema)


def carry_labels(rows: DataFrame, page: list[str], order: str, label: str = "label") -> DataFrame:
    """A row without label takes the last one before it."""
    w = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(label, F.last(F.col(label), ignorenulls=True).over(w))


def label_columns(cells: DataFrame, sheet: list[str], threshold: float = 0.25) -> DataFrame:
    """Columns of a grid a quarter or more of whose cells are labels."""
    v = F.trim(F.col("value"))
    is_label = (F.length(v) >= 2) & ~looks_like_amount(v) & period_key(v).isNull()
    return cells.where(F.col("value").isNotNull()).groupBy(*sheet, "c").agg(F.avg(is_label.cast("double")).alias("label_share")).where(F.col("label_share") >= threshold)


#: Header words of the current and the prior period.
CURRENT_WORDS, PRIOR_WORDS = "期末|本期|本年|current|ending", "期初|上期|上年|年初|prior|beginning"


def column_roles(header: DataFrame, sheet: list[str]) -> DataFrame:
    """sheet, current, prior: the columns of the two latest periods, else those of the role words, first match each."""
    h = header.withColumn("_p", period_key(F.col("value")))
    ranked = h.withColumn("_r", F.when(F.col("_p").isNotNull(), F.dense_rank().over(Window.partitionBy(*sheet).orderBy(F.col("_p").desc_nulls_last()))))
    periods = F.countDistinct("_p") >= 2
    first = lambda cond: F.min(F.when(cond, F.col("c")))
    v = F.lower(F.col("value"))
    return ranked.groupBy(*sheet).agg(
        F.when(periods, first(F.col("_r") == 1)).otherwise(first(v.rlike(CURRENT_WORDS))).alias("current"),
        F.when(periods, first(F.col("_r") == 2)).otherwise(first(v.rlike(PRIOR_WORDS))).alias("prior"),
    )


def amount_statistics(cells: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Cells by status: ok, dash, empty, repaired, suspect."""
    return cells.select(*keys, amount(F.col(text))["status"].alias("status")).groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


SIDE_GAP = 0.22


def side_cut(cells: DataFrame, page: list[str]) -> DataFrame:
    """page, cut: where a page of two tables side by side parts; NULL if it is one table.

    The widest gap between column anchors, if it is SIDE_GAP or more, there are three columns or more, and text cells begin on both sides.
    """
    anchors = cells.groupBy(*page).agg(column_anchors(F.collect_list("x")).alias("_a"), F.collect_list(F.struct("x", "text")).alias("_c"))
    gaps = F.transform(F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0))), lambda x, i: F.struct((x - F.get("_a", i)).alias("gap"), x.alias("at")))
    widest = F.array_max(gaps)
    labels = lambda right: F.size(F.filter("_c", lambda c: ((c["x"] >= F.col("_w.at")) == F.lit(right)) & (F.length(c["text"]) >= 2) & ~looks_like_amount(c["text"])))
    out = anchors.withColumn("_w", widest)
    fits = (F.size("_a") >= 3) & (F.col("_w.gap") >= SIDE_GAP) & (labels(True) >= 2) & (labels(False) >= 2)
    return out.select(*page, F.when(fits, F.col("_w.at")).alias("cut"))


def split_sides(cells: DataFrame, cuts: DataFrame, page: list[str]) -> DataFrame:
    """Cells with side 0 or 1."""
    return cells.join(cuts, page, "left").withColumn("side", F.coalesce((F.col("x") >= F.col("cut")).cast("int"), F.lit(0))).drop("cut")


def pick_pages(scores: DataFrame, doc: str, page: str, kinds: list[str]) -> DataFrame:
    """doc, kind, page: for each statement the pages around its best one on which no other scores higher."""
    from .asof import expand_from_anchor

    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("mine"), F.greatest(*(F.col(o) for o in kinds if o != k), F.lit(0)).alias("other")) for k in kinds)))
    long = scores.select(doc, page, rows.alias("s")).select(doc, page, "s.*")
    top = long.groupBy(doc, "kind").agg(F.max("mine").alias("_top")).where("_top > 0").drop("_top")
    return expand_from_anchor(long.join(top, [doc, "kind"]), [doc, "kind"], page, "mine", (F.col("mine") > 0) & (F.col("mine") >= F.col("other"))).select(doc, "kind", page)


#: Headers of note columns and of value columns.
NOTE_HEADERS = "^(行次|附注|行号|序号|项目编号|no|note)$"
VALUE_HEADERS = f"({CURRENT_WORDS}|{PRIOR_WORDS}|金额)"


def header_rows(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """sheet, header: the first row with a note and a value header, else the first with most periods, two at least."""
    v = F.lower(F.regexp_replace("value", r"\s", ""))
    rows = cells.groupBy(*sheet, "r").agg(F.bool_or(v.rlike(NOTE_HEADERS)).alias("note"), F.bool_or(v.rlike(VALUE_HEADERS)).alias("val"), F.count_if(period_key(F.col("value")).isNotNull()).alias("periods"))
    named = F.min(F.when(F.col("note") & F.col("val"), F.col("r")))
    dated = F.max(F.when(F.col("periods") >= 2, F.struct("periods", (-F.col("r")).alias("r"))))
    return rows.groupBy(*sheet).agg(F.coalesce(named, -dated["r"]).alias("header"))


def grid_rows(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """sheet, r, label, current, prior: a grid below its header in the roles of its columns (W21, W28); rows without a label are left out."""
    headed = cells.join(header_rows(cells, sheet).where("header is not null"), sheet)
    roles = column_roles(headed.where(F.col("r") == F.col("header")), sheet)
    body = headed.where(F.col("r") > F.col("header")).join(roles, sheet)
    at = lambda c: F.max(F.when(c, F.col("value")))
    out = body.groupBy(*sheet, "r").agg(at(F.col("c") == 0).alias("label"), at(F.col("c") == F.col("current")).alias("current_value"), at(F.col("c") == F.col("prior")).alias("prior_value"))
    return out.where("label is not null").select(*sheet, "r", "label", F.col("current_value").alias("current"), F.col("prior_value").alias("prior"))


def titled_range(pages: DataFrame, doc: str, titles: dict[str, list[str]], text: str = "text", rows: str = "numeric_rows") -> DataFrame:
    """doc, kind, first, last: from the titled page with most numeric rows to the page before another statement's title."""
    t = F.coalesce(F.col(text), F.lit(""))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    found = None
    for kind, words in titles.items():
        others = [w for k, ws in titles.items() if k != kind for w in ws]
        marked = pages.select(doc, "page", hit(words).alias("own"), (hit(others) & ~hit(words)).alias("next"), F.col(rows).alias("n"))
        start = marked.where("own").groupBy(doc).agg((-F.max(F.struct("n", (-F.col("page")).alias("p")))["p"]).alias("first"))
        after = marked.join(start, doc).where(F.col("page") >= F.col("first"))
        stop = F.min(F.when(F.col("next") & (F.col("page") > F.col("first")), F.col("page")))
        one = after.groupBy(doc, "first").agg((F.coalesce(stop - 1, F.max("page"))).alias("last")).select(doc, F.lit(kind).alias("kind"), "first", "last")
        found = one if found is None else found.unionByName(one)
    return found
