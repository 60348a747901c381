"""Figures in running text: amounts after labels, share structure, reconciliation notes, text-flow tables.

All are column expressions over a page's text; many labels are looked for in Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_name, once
from .statements import ACCOUNTS

#: Dashes that stand for minus, and marks of the reconciliation and profile pages.
DASHES = "一－–—‐−"
RECON_MARKS = ["将净利润调节为经营活动现金流量", "将净利润调节为经营活动产生的现金流量", "现金流量表补充资料", "Adjustments for:"]
PROFILE_MARKS = ["发行概况", "本次发行概况", "发行股票类型", "每股发行价格", "发行股数"]
#: Depreciation lines, other reconciling lines, and the ends of the reconciliation.
DA_LINES = ["固定资产折旧", "投资性房地产折旧", "使用权资产折旧", "使用权资产摊销", "无形资产摊销", "长期待摊费用摊销"]
OTHER_LINES = ["资产减值准备", "信用减值损失", "处置固定资产", "固定资产报废损失", "公允价值变动损失", "财务费用", "投资损失", "递延所得税资产减少", "存货的减少", "经营性应收项目的减少", "经营性应付项目的增加"]
RECON_START, RECON_TARGET = ["净利润"], ["经营活动产生的现金流量净额"]


#: What stands before a figure, with a sign at its end; the figure.
_BEFORE, _FIGURE = "^[^0-9]*+", r"^[0-9][0-9,]*+(?:\.[0-9]++)?"


def _figure(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def amount_after(text: Column, label: Column, reach: int = 48) -> Column:
    """struct<amount, place>: the first figure within ``reach`` characters after the first place of a label.

    A bracket or dash right before it negates. NULL without the label or a figure.
    """
    def hit(found: Column) -> Column:
        after = found + F.length(label)
        tail = F.substring(text, after, F.lit(reach))
        before = once(tail, lambda t: F.struct(t.alias("tail"), F.regexp_extract(t, _BEFORE, 0).alias("before")))

        def read(b: Column) -> Column:
            n, negative = F.length(b["before"]), F.right(b["before"], F.lit(1)).isin("(", "-", *DASHES)
            digits = F.regexp_extract(F.substring(b["tail"], n + 1, F.lit(reach)), _FIGURE, 0)
            signed = lambda d: F.struct((_figure(d["digits"]) * F.when(d["negative"], -1.0).otherwise(1.0)).alias("amount"), (after + n - F.when(d["negative"], 1).otherwise(0) - 1).alias("place"))
            return once(F.struct(digits.alias("digits"), negative.alias("negative")), lambda d: F.when(d["digits"] != "", signed(d)))

        return once(before, read)

    return once(F.position(label, text), lambda found: F.when(found > 0, hit(found)))


def amounts_after(text: Column, labels: list[str], reach: int = 48) -> Column:
    """array<struct<label, amount, place>> of the labels found, in order; a figure that two labels reach belongs to the first.

    Many labels are looked for in one go over the text in Python, as ``amount_after`` does for one.
    """
    figure, signs = re.compile(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), tuple(f"(-{DASHES}")

    @F.arrow_udf("array<struct<label:string,amount:double,place:int>>")
    def found(texts: pa.Array) -> pa.Array:
        offsets, names, amounts, places = [0], [], [], []
        for raw in texts.cast(pa.binary()).to_pylist():
            t, taken = (raw or b"").decode("utf-8", "replace"), set()
            for label in labels:
                at = t.find(label)
                after = at + len(label)
                hit = figure.search(t, after, after + reach) if at >= 0 else None
                if hit:
                    start = hit.start()
                    negative = start > after and t[start - 1] in signs
                    if start - negative not in taken:
                        taken.add(start - negative)
                        names.append(label)
                        amounts.append(float(hit[1].replace(",", "")) * (-1.0 if negative else 1.0))
                        places.append(start - negative + 1)
            offsets.append(len(names))
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(amounts, pa.float64()), pa.array(places, pa.int32())], ["label", "amount", "place"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return found(text)


def reconciling_lines(text: Column) -> Column:
    """amounts_after of all lines of a reconciliation, for ``depreciation`` and ``reconcile`` of one text."""
    return amounts_after(text, [*DA_LINES, *OTHER_LINES])


def depreciation(text: Column, lines: Column | None = None) -> Column:
    """map<label, amount>: the depreciation lines of a reconciliation; zeros left out.

    ``lines``: the text's reconciling lines where they are there already; depreciation comes first in them, so other lines take no figure from it.
    """
    found = amounts_after(text, DA_LINES) if lines is None else F.filter(lines, lambda x: x["label"].isin(*DA_LINES))
    return F.map_from_entries(F.transform(F.filter(found, lambda x: x["amount"] != 0), lambda x: F.struct(x["label"], x["amount"])))


def reconcile(text: Column, lines: Column | None = None) -> Column:
    """struct<net_income, cfo, items, diff, ok> of the reconciliation in a text, NULL without both ends; ok within 0.05 % of cash flow or 1 (V8)."""
    net, cfo = (F.coalesce(*(amount_after(text, F.lit(x))["amount"] for x in labels)) for labels in (RECON_START, RECON_TARGET))
    lines = reconciling_lines(text) if lines is None else lines
    known = once(lines, lambda x: F.struct(net.alias("net"), cfo.alias("cfo"), F.size(x).alias("items"), F.aggregate(x, F.lit(0.0), lambda a, y: a + y["amount"]).alias("sum")))

    def held(r: Column) -> Column:
        diff = r["net"] + r["sum"] - r["cfo"]
        ok = F.abs(diff) <= F.greatest(F.lit(1.0), F.abs(r["cfo"]) * 0.0005)
        return F.when(r["net"].isNotNull() & r["cfo"].isNotNull(), F.struct(r["net"].alias("net_income"), r["cfo"].alias("cfo"), r["items"].alias("items"), diff.alias("diff"), ok.alias("ok")))

    return once(known, held)


_SHARES = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(万)?\s*股"


def shares_near(text: Column, label: str, window: int = 70) -> Column:
    """A share count around a label (F22): mentions that go on as a description are passed over, "not exceeding" goes first."""
    def windows(rest: Column) -> Column:
        # where each mention starts: all before it, with the mentions between
        mentions = F.transform(F.slice(rest, 2, F.size(rest) - 1), lambda r, k: F.struct(r.alias("r"), F.length(F.array_join(F.slice(rest, F.lit(1), k + 1), label)).alias("at")))
        plain = F.filter(mentions, lambda m: ~m["r"].rlike("^(的|所占|比例)"))
        return F.transform(plain, lambda m: F.substring(text, F.greatest(m["at"] - window, F.lit(0)) + 1, F.least(m["at"], F.lit(window)) + window))

    def count(x: Column) -> Column:
        chosen = F.coalesce(*(F.nullif(F.regexp_extract(x, p, 0), F.lit("")) for p in (rf"不超过(?s:.{{0,9}}?){_SHARES}", _SHARES)))
        return once(chosen, lambda c: _figure(F.regexp_extract(c, _SHARES, 1)) * F.when(F.regexp_extract(c, _SHARES, 2) == "", 1.0).otherwise(10_000.0))

    counts = once(F.split(text, re.escape(label), -1), lambda rest: F.transform(windows(rest), count))
    return F.when(F.contains(text, F.lit(label)), F.get(F.filter(counts, lambda v: v.isNotNull()), F.lit(0)))


def share_structure(text: Column) -> Column:
    """struct<issued, after, before, par, price, inferred> of a profile page (F23). A blank price stays NULL."""

    def read(flat: Column) -> Column:
        priced = lambda label, reach: F.regexp_extract(flat, rf"{label}((?s:.{{0,{reach - len(label)}}}))", 1)
        price = lambda label, reach: F.regexp_extract(priced(label, reach), r"([0-9]+(?:\.[0-9]+)?)\s*元", 1).try_cast("double")
        issued = F.coalesce(*(shares_near(flat, k) for k in ("本次拟公开发行股份数量", "发行股数", "本次发行股数")))
        return F.struct(issued.alias("issued"), shares_near(flat, "发行后总股本").alias("after"), shares_near(flat, "发行前总股本").alias("before"), price("每股面值", 60).alias("par"), price("每股发行价格", 40).alias("price"))

    def whole(r: Column) -> Column:
        issued, after, before = r["issued"], r["after"], r["before"]
        inferred = F.when(issued.isNull(), F.lit(None).cast("string")).when(before.isNull() & (after != 0), "before").when(after.isNull() & (before != 0), "after")
        return F.struct(
            issued.alias("issued"), F.coalesce(after, before + issued).alias("after"), F.coalesce(before, after - issued).alias("before"),
            r["par"].alias("par"), r["price"].alias("price"), inferred.alias("inferred"),
        )

    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return once(once(flat, read), whole)


#: A page read as running text is a row of runs of label characters, amounts, and anything else. A dash or bracket
#: belongs to a label only where no amount can begin with it.
_RUN = r"(?:[一-鿿（）)、·：:“”‘’／/《》〈〉]|\((?!-?[0-9])|[\-—](?=[一-鿿]))+"
_AMOUNT = r"\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?|[—–-]"
_TOKENS = rf"({_RUN}|{_AMOUNT}|[^\s　])"
#: Amounts that a row has at most, periods that count, and the largest line number.
MOST_AMOUNTS, MOST_PERIODS, MOST_LINES = 6, 4, 400
FLOW_ROWS = 8


def account_names() -> list[str]:
    """The Chinese names of two characters or more that ACCOUNTS has."""
    return sorted({n for a in ACCOUNTS for n in a.names if re.match("[一-鿿]{2}", n)})


def known_names(run: Column, names: list[str]) -> Column:
    """The known names in a run of characters, last first; of names that end alike the longest.

    Read backwards, these are the matches, one after the other, of all reversed names as alternatives, the long ones first.
    """
    backwards = "|".join(re.escape(n[::-1]) for n in sorted(names, key=lambda n: (-len(n), n)))
    return F.transform(F.regexp_extract_all(F.reverse(run), F.lit(f"({backwards})"), F.lit(1)), lambda x: F.reverse(x))


def flow_pieces(text: Column, names: list[str]) -> Column:
    """array<struct<labels, values>>: each run with known names that amounts follow, and these amounts."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKENS), F.lit(1))

    def pieces(t: Column) -> Column:
        def after(k: Column) -> Column:
            following = F.slice(t, k + 2, MOST_AMOUNTS)
            other = F.array_position(F.transform(following, lambda x: x.rlike(f"^(?:{_AMOUNT})$")), False)
            return F.when(other > 0, F.slice(following, F.lit(1), other.cast("int") - 1)).otherwise(following)

        runs = F.transform(t, lambda x, k: F.when(x.rlike("[一-鿿]"), F.struct(known_names(x, names).alias("labels"), after(k).alias("values"))))
        return F.filter(runs, lambda p: (F.size(p["labels"]) > 0) & (F.size(p["values"]) > 0))

    return F.transform(F.array(tokens), pieces)[0]


def flow_rows(pieces: Column) -> Column:
    """array<struct<label, note, current, prior>>: the rows that ``flow_pieces`` give.

    The last name before the amounts has them; names before it have none. Of three amounts or more a first one that can be a line number
    is the note. Periods go from new to old, so the first two count.
    """
    cell = lambda values, k: F.coalesce(F.get(values, F.lit(k)), F.lit(""))

    def rows(p: Column) -> Column:
        v = p["values"]
        numbered = (F.size(v) >= 3) & v[0].rlike("^[0-9]{1,3}$") & (v[0].try_cast("int") <= MOST_LINES)
        rest = lambda n: F.when(n, F.slice(v, 2, MOST_AMOUNTS)).otherwise(F.slice(v, 1, MOST_PERIODS))
        first = once(numbered, lambda n: once(rest(n), lambda r: F.struct(F.when(n, v[0]).otherwise("").alias("note"), cell(r, 0).alias("current"), cell(r, 1).alias("prior"))))
        shown = lambda f: F.transform(p["labels"], lambda name, k: F.struct(name.alias("label"), *(F.when(k == 0, f[c]).otherwise("").alias(c) for c in ("note", "current", "prior"))))
        return once(first, shown)

    return F.flatten(F.transform(pieces, rows))


def text_flow(text: Column, names: list[str]) -> Column:
    """array<struct<label, note, current, prior>>: the rows of a table that was read as running text."""
    return flow_rows(flow_pieces(text, names))


def is_text_flow(text: Column, names: list[str]) -> Column:
    """Whether FLOW_ROWS pieces or more have a known name."""
    return F.size(flow_pieces(text, names)) >= FLOW_ROWS


def text_flow_rows(pages: DataFrame, text: str, names: list[str]) -> DataFrame:
    """The pages' other columns, row_no, label, note, current, prior and flows: the rows of each page, and whether it is such a table.

    Each page is read once; an inner explode would have its array worked out again to filter by.
    """
    pieces, rest = free_name(pages, "_pieces"), [c for c in pages.columns if c != text]
    read = pages.withColumn(pieces, flow_pieces(F.col(text), names))
    rows = read.select(*rest, (F.size(pieces) >= FLOW_ROWS).alias("flows"), F.posexplode_outer(flow_rows(F.col(pieces))).alias("row_no", "_x"))
    return rows.where(F.col("row_no").isNotNull()).select(*rest, "row_no", "_x.*", "flows")


def reconciliation_pages(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Pages of the reconciliation and up to two after each that go on with it."""
    t = F.coalesce(F.col(text), F.lit(""))
    mark = F.lit(False)
    for m in RECON_MARKS:
        mark = mark | F.contains(t, F.lit(m))
    flagged = pages.withColumn("_m", mark).withColumn("_go", mark | t.rlike("补充资料|净利润|调节"))
    starts = flagged.where("_m").select(doc, F.explode(F.array(F.struct(F.col(page).alias("p"), F.lit(0).alias("k")), F.struct((F.col(page) + 1).alias("p"), F.lit(1).alias("k")), F.struct((F.col(page) + 2).alias("p"), F.lit(2).alias("k")))).alias("s")).select(doc, F.col("s.p").alias(page), F.col("s.k").alias("_k"))
    reach = flagged.join(starts, [doc, page])
    previous = flagged.select(doc, (F.col(page) + 1).alias(page), F.col("_go").alias("_before"))
    joined = reach.join(previous, [doc, page], "left")
    keep = (F.col("_k") == 0) | (F.col("_go") & ((F.col("_k") == 1) | F.coalesce("_before", F.lit(False))))
    return joined.where(keep).select(pages.columns).distinct()


def profile_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with two marks of the issue profile or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    return pages.where(sum((F.contains(t, F.lit(m)).cast("int") for m in PROFILE_MARKS), F.lit(0)) >= 2)


def statement_ranges(contents: DataFrame, doc: str, kind: str = "kind", page: str = "page") -> DataFrame:
    """doc, kind, first, last: from an entry of the table of contents to the page before the next."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(doc).orderBy(page)
    return contents.select(doc, kind, F.col(page).alias("first"), (F.lead(page).over(w) - 1).alias("last"))


#: How company names end, the full forms first.
COMPANY_ENDS = (("股份有限公司", "集团有限公司", "有限公司"), ("公司", "集团"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[\s\x{3000}]+|[\s\x{3000}]+$", ""))


def company_line(text: Column) -> Column:
    """The line of a cover that names the company: a full legal form at once, else the first shorter one."""
    names = F.transform(_lines(text), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^(.{4,}(?:公司|集团))(?:2|２０)", 1), F.lit("")), x))
    fit = F.filter(names, lambda x: F.length(x).between(4, 40))
    ending = lambda ends: F.get(F.filter(fit, lambda x: x.rlike(f"(?:{'|'.join(ends)})$")), F.lit(0))
    return F.coalesce(*map(ending, COMPANY_ENDS))


def cover_code(text: Column) -> Column:
    """The security code that a cover states."""
    return F.nullif(F.regexp_extract(text, r"(?i)(?:代码|代碼|code)\s*[:：]?\s*([0-9]{4,6})", 1), F.lit(""))


def cover_facts(pages: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """doc, company, code from the first two pages."""
    held = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    covers = pages.where(F.col(page) <= 2).groupBy(doc).agg(F.array_join(F.transform(held, lambda x: F.coalesce(x["t"], F.lit(""))), "\n").alias("_t"))
    return covers.select(doc, company_line(F.col("_t")).alias("company"), cover_code(F.col("_t")).alias("code"))
