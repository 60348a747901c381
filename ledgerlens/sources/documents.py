"""Workbooks and PDF pages through optional libraries; without one, a row that says so."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workbook_cells(name: str, content: bytes) -> Iterator[tuple[str | None, int | None, int | None, str | None, str | None]]:
    """(sheet, row, column, value, gap) of each filled cell; one row with a gap where the file can't be read."""
    try:
        if name.lower().endswith(".xls"):
            import xlrd

            for sheet in xlrd.open_workbook(file_contents=content).sheets():
                for r in range(sheet.nrows):
                    for c in range(sheet.ncols):
                        if sheet.cell_value(r, c) not in ("", None):
                            yield sheet.name, r, c, _text(sheet.cell_value(r, c)), None
        else:
            from openpyxl import load_workbook

            book = load_workbook(io.BytesIO(content), data_only=True, read_only=True)
            for sheet in book.worksheets:
                for r, row in enumerate(sheet.iter_rows(values_only=True)):
                    for c, v in enumerate(row):
                        if v is not None:
                            yield sheet.title, r, c, _text(v), None
    except ImportError as e:
        yield None, None, None, None, f"library missing: {e.name}"
    except Exception as e:  # a broken file is a gap of that file, not of the job
        yield None, None, None, None, f"unreadable: {type(e).__name__}"


def _text(v: object) -> str:
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v).strip()


def pdf_pages(content: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(page, text, gap) of each page."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for n, page in enumerate(pdf.pages, 1):
                yield n, page.extract_text() or "", None
    except ImportError as e:
        yield None, None, f"library missing: {e.name}"
    except Exception as e:  # as above
        yield None, None, f"unreadable: {type(e).__name__}"


def read_workbooks(files: DataFrame) -> DataFrame:
    """path, sheet, r, c, value, gap of files with path and content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f.path, *cell) for f in b.itertuples() for cell in workbook_cells(f.path, bytes(f.content))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "r", "c", "value", "gap"]).astype({"r": "Int32", "c": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, r int, c int, value string, gap string")


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """path, page, text, gap of files with path and content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f.path, *p) for f in b.itertuples() for p in pdf_pages(bytes(f.content))]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "gap"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, page int, text string, gap string")


def fill_blank_pages(pages: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """Blank pages with the text that OCR has for them, and from_ocr."""
    o = ocr.select(*keys, F.col("text").alias("_ocr"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return pages.join(o, keys, "left").withColumn("from_ocr", blank & F.col("_ocr").isNotNull()).withColumn("text", F.when(blank, F.coalesce("_ocr", "text")).otherwise(F.col("text"))).drop("_ocr")


def scan_advisory(pages: DataFrame, doc: str) -> DataFrame:
    """doc, scanned: whether all pages came by OCR, which wants a check by hand (P20)."""
    return pages.groupBy(doc).agg(F.bool_and("from_ocr").alias("scanned"))


#: Words that name each statement on a sheet.
SHEET_MARKS = {
    "balance": ["资产总计", "负债合计", "流动资产合计", "资产负债表", "所有者权益合计", "total assets", "total liabilities"],
    "income": ["营业收入", "营业成本", "利润总额", "净利润", "利润表", "net income", "total revenue"],
    "cash_flow": ["现金流量净额", "现金流入小计", "现金流出小计", "现金流量表", "operating activities", "investing activities"],
}


def classify_sheets(cells: DataFrame) -> DataFrame:
    """path, sheet, stmt, hits: the statement that a sheet is, by two marks or more."""
    text = cells.where("value is not null").groupBy("path", "sheet").agg(F.lower(F.array_join(F.collect_list("value"), " ")).alias("t"))
    scores = [F.struct(sum((F.contains(F.col("t"), F.lit(m)).cast("int") for m in marks), F.lit(0)).alias("hits"), F.lit(kind).alias("stmt")) for kind, marks in SHEET_MARKS.items()]
    return text.select("path", "sheet", F.greatest(*scores).alias("b")).select("path", "sheet", "b.stmt", "b.hits").where("hits >= 2")


def sheet_scores(cells: DataFrame, mapped: DataFrame) -> DataFrame:
    """path, sheet, score: mapped cells, more for consolidated names and periods, less for monthly ones."""
    from ..functions.identifiers import period_key

    periods = cells.where("r < 8").groupBy("path", "sheet", "r").agg(F.count_if(period_key(F.col("value")).isNotNull()).alias("p")).groupBy("path", "sheet").agg(F.max("p").alias("p"))
    n = mapped.groupBy("path", "sheet").agg(F.count_if(F.col("field").isNotNull()).alias("m"))
    low = F.lower("sheet")
    bonus = F.when(low.rlike("summary|consolidated|annual|total|company|combined|overall|group|合并"), 500).otherwise(0) - F.when(low.rlike("month|weekly|daily|detail"), 300).otherwise(0)
    return n.join(periods, ["path", "sheet"], "left").select("path", "sheet", (F.col("m") + bonus + 200 * F.least(F.coalesce("p", F.lit(0)), F.lit(3))).alias("score"))
