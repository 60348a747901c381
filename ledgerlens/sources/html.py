"""HTML tables as cells: a Python UDTF around the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "head"}


class _Tables(HTMLParser):
    """Cells of all tables, with spans laid out on a grid (Q7)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, str, str | None]] = []
        self.stack: list[dict] = []
        self.tables, self.hidden = 0, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "table":
            self.tables += 1
            self.stack.append({"no": self.tables, "row": 0, "col": 0, "held": {}, "cell": None})
        elif self.stack and tag == "tr":
            t = self.stack[-1]
            t["row"], t["col"] = t["row"] + 1, 0
        elif self.stack and tag in ("td", "th"):
            self._close()
            t = self.stack[-1]
            while (t["row"], t["col"]) in t["held"]:
                t["col"] += 1
            span = lambda k: int(a.get(k) or 1) if re.fullmatch("[0-9]{1,3}", a.get(k) or "1") else 1
            t["cell"] = {"row": t["row"], "col": t["col"], "text": [], "tag": None}
            for r in range(max(span("rowspan"), 1)):
                for c in range(max(span("colspan"), 1)):
                    t["held"][(t["row"] + r, t["col"] + c)] = True
            t["col"] += max(span("colspan"), 1)
        if self.stack and self.stack[-1]["cell"] is not None:
            name = a.get("name") if tag.startswith("ix:") else re.search(r"defref_([\w\-]+)", " ".join(v or "" for v in a.values()))
            if name and self.stack[-1]["cell"]["tag"] is None:
                self.stack[-1]["cell"]["tag"] = name if isinstance(name, str) else name.group(1)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.stack:
            self._close()
            self.stack.pop()

    def handle_data(self, data):
        if not self.hidden and self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"]["text"].append(data)

    def _close(self):
        if self.stack and (cell := self.stack[-1]["cell"]) is not None:
            text = re.sub(r"\s+", " ", "".join(cell["text"])).strip()
            self.cells.append((self.stack[-1]["no"], cell["row"], cell["col"], text, cell["tag"]))
            self.stack[-1]["cell"] = None


def table_cells(html: str | None) -> list[tuple[int, int, int, str, str | None]]:
    """(table, row, column, text, XBRL tag) of each cell of each table."""
    parser = _Tables()
    body = re.search(r"(?is)<text>(.*?)</text>", html or "")
    parser.feed(body.group(1) if body else html or "")
    parser.close()
    return parser.cells


def stitched(cells: Column) -> Column:
    """Numbers that markup cut apart become one cell: "$" and "1", or "(3,552" and ")" (F16).

    Signs in front go with the next cell that has text, closing brackets with the last one before; what
    they leave is blank, so every cell keeps its column. Cells hold no unit separators.
    """
    row = F.array_join(F.transform(cells, lambda c: F.translate(F.coalesce(c, F.lit("")), "\x1f", " ")), "\x1f")
    for _ in range(3):  # "HK$", "(" and the number
        row = F.regexp_replace(row, r"(^|\x1f)((?:HK|US)?[$¥€£(（]+)(\x1f+)([^\x1f]+)", "$1$2$4$3")
    for _ in range(2):
        row = F.regexp_replace(row, r"([^\x1f])(\x1f+)([)）]+)(?=\x1f|$)", "$1$3$2")
    return F.when(F.size(cells) > 0, F.split(row, "\x1f", -1)).otherwise(cells)


def extract_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table_no, row_no, col_no, text, tag of each table cell."""

    @F.udtf(returnType="table_no int, row_no int, col_no int, text string, tag string")
    class Cells:
        def eval(self, page: str):
            yield from table_cells(page)

    spark = pages.sparkSession
    spark.udtf.register("ledgerlens_table_cells", Cells)
    pages.createOrReplaceTempView("_ledgerlens_pages")
    return spark.sql(f"SELECT p.`{key}`, c.* FROM _ledgerlens_pages p, LATERAL ledgerlens_table_cells(p.`{html}`) c")


def statement_rows(cells: DataFrame, key: str) -> DataFrame:
    """key, table_no, row_no, label, tag, cells: the first cell labels a row, split numbers are stitched."""
    got = cells.groupBy(key, "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text", "tag"))).alias("_c"))
    texts = F.transform("_c", lambda x: x["text"])
    tag = F.get(F.filter(F.transform("_c", lambda x: x["tag"]), lambda x: x.isNotNull()), F.lit(0))
    return got.select(key, "table_no", "row_no", F.get(texts, F.lit(0)).alias("label"), tag.alias("tag"), stitched(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).alias("cells"))
