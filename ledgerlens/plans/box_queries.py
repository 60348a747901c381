"""Statement pages as word boxes: one page for each supplier, laid out by key in one of several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes
from .table_queries import query, read

#: Lines of a page: left label, its values, right label, its values; what stands for a label is said by the kind of page.
_LEFT = ["流动资产：", "货币资金", "应收账款", "应收票据", "存货", "预付款项", "固定资产", "资产总计"]
_RIGHT = ["流动负债：", "应付账款", "应付票据", "预收款项", "短期借款", "应交税费", "股东权益", "负债和权益总计"]
_INCOME = ["营业收入", "营业成本", "销售费用", "管理费用", "财务费用", "营业利润", "所得税", "净利润"]


def _page(kind: int, sql: bool) -> list[tuple[str, str, int, str]]:
    """(x, y, seq, text) of each word as expressions over s_suppkey: kind 0 two-sided, 1 one table with notes and totals set right, 2 two-sided by place but not by words."""
    thousand = lambda n: f"concat(CAST(s_suppkey % 90 + {n} AS {'VARCHAR' if sql else 'STRING'}), ',', CAST(100 + s_suppkey * {n} % 900 AS {'VARCHAR' if sql else 'STRING'}), '.50')"
    quote = lambda s: f"'{s}'"
    words: list[tuple[str, str, str]] = []
    for k in range(8):
        y = f"{100 + 20 * k} + s_suppkey % 3"
        shift = f"0.0{k % 2}" if kind != 1 else f"{0.11 if k == 7 else 0.0}"
        left, right = (_LEFT if kind < 2 else _INCOME)[k], (_RIGHT if kind == 0 else _INCOME[::-1])[k]
        words.append((f"0.08 + {shift}", y, quote(left)))
        if kind == 1:
            words.append(("0.45", y, quote(str(k + 1))))
            words += [("0.6 + 0.001 * (s_suppkey % 9)", y, thousand(k + 1)), ("0.8", y, quote("—") if k == 3 else thousand(k + 20))]
        else:
            words += [("0.26", y, thousand(k + 1)), ("0.36", f"{y} + 1", "'1.234.567'" if k == 5 else thousand(k + 30))][0 if k else 2 :]
            words += [(f"0.52 + {shift}", y, quote(right)), ("0.72", f"{y} - 1", "'12.34.5'" if k == 4 else thousand(k + 50)), ("0.84", y, quote("-") if k == 2 else thousand(k + 70))][: 3 if k else 1]
    return [(x, y, seq, t) for seq, (x, y, t) in enumerate(words)]


def _words_sql() -> str:
    one = [f"SELECT s_suppkey, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {seq} AS seq, {t} AS t FROM supplier WHERE s_suppkey % 3 = {kind}" for kind in range(3) for x, y, seq, t in _page(kind, True)]
    return " UNION ALL ".join(one)


_VALUE = r"regexp_full_match(t, '-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,4})?|[-—]|[0-9][0-9,.]*')"
_ANCHORS = "list_reduce(list_concat([[min(x)]], list_transform(list_sort(list_distinct(list(x))), lambda v: [v])), lambda a, v: CASE WHEN v[1] - a[len(a)] > 0.02 THEN list_concat(a, v) ELSE a END)"
_NEAREST = "list_position(list_transform(a, lambda v: abs(v - x)), list_min(list_transform(a, lambda v: abs(v - x)))) - 1"


def _any(words: list[str], side: str) -> str:
    return " + ".join(f"CAST(bool_or({side} AND contains(t, '{w}')) AS INT)" for w in words)


@query(
    rf"""WITH w AS ({_words_sql()}), b AS (SELECT *, CAST(coalesce(y - lag(y) OVER o > 3, false) AS INT) AS new FROM w WINDOW o AS (PARTITION BY s_suppkey ORDER BY y, x, seq)),
l AS (SELECT s_suppkey, x, seq, t, sum(new) OVER (PARTITION BY s_suppkey ORDER BY y, x, seq) AS line, {_VALUE} AS v, regexp_full_match(t, '[0-9]{{1,3}}') AND try_cast(t AS INT) <= 400 AS small FROM b),
pa AS (SELECT s_suppkey, {_ANCHORS} AS a FROM l GROUP BY s_suppkey), pc AS (SELECT l.*, a, {_NEAREST} AS col FROM l JOIN pa USING (s_suppkey)),
lc AS (SELECT s_suppkey, col, min(a[col + 1]) AS anchor FROM pc GROUP BY s_suppkey, col HAVING count(*) >= 3 AND avg(CAST(NOT v AS INT)) >= 0.5),
lg AS (SELECT *, sum(far) OVER (PARTITION BY s_suppkey ORDER BY col) AS g FROM (SELECT *, CAST(coalesce(anchor - lag(anchor) OVER (PARTITION BY s_suppkey ORDER BY col) > 0.15, false) AS INT) AS far FROM lc)),
e AS (SELECT s_suppkey, max(anchor) FILTER (g = 0) AS l, min(anchor) FILTER (g = 1) AS r FROM lg GROUP BY s_suppkey), c AS (SELECT s_suppkey, r - 0.02 AS cut FROM e WHERE r - l >= 0.22),
j AS (SELECT s_suppkey, cut FROM pc JOIN c USING (s_suppkey) GROUP BY s_suppkey, cut HAVING {_any(boxes.LEFT_WORDS, "x < cut")} >= 2 AND {_any(boxes.RIGHT_WORDS, "x >= cut")} >= 2 AND max(len(a)) >= 3 AND count(DISTINCT line) FILTER (x >= cut) >= greatest(3, count(DISTINCT line) // 4)),
s AS (SELECT l.*, CAST(coalesce(x >= cut, false) AS INT) AS side FROM l LEFT JOIN j USING (s_suppkey)), sa AS (SELECT s_suppkey, side, {_ANCHORS} AS a FROM s GROUP BY s_suppkey, side), sc AS (SELECT s.*, {_NEAREST} AS col FROM s JOIN sa USING (s_suppkey, side)),
n AS (SELECT s_suppkey, side, col, count(*) AS n, avg(CAST(small AS INT)) AS small FROM sc GROUP BY s_suppkey, side, col HAVING avg(CAST(v AS INT)) >= 0.5),
f AS (SELECT s_suppkey, side, min(col) AS first, min(col) FILTER (n >= 3 AND small >= 0.7) AS note_col, list(col) AS cols FROM n GROUP BY s_suppkey, side),
r AS (SELECT s_suppkey, side, line, string_agg(t, '  ' ORDER BY col, x, seq) FILTER (col < first) AS label, string_agg(t, '  ' ORDER BY col, x, seq) FILTER (col = note_col) AS note,
list(CASE WHEN t = '12.34.5' THEN '？' || t WHEN t = '1.234.567' THEN '1234567' ELSE t END ORDER BY col, x, seq) FILTER (list_contains(cols, col) AND col IS DISTINCT FROM note_col AND NOT (note_col IS NULL AND small)) AS vs FROM sc JOIN f USING (s_suppkey, side) GROUP BY s_suppkey, side, line)
SELECT s_suppkey, CAST(side AS INTEGER) AS side, CAST(line AS INTEGER) AS line, label, coalesce(note, '') AS note, coalesce(vs[len(vs) - 1], '') AS "current", coalesce(vs[len(vs)], '') AS prior FROM r WHERE label IS NOT NULL OR len(vs) > 0"""
)
def box_rows(spark, sf_dir):
    """Statement rows from word boxes (A16, W13, W14, W23-W25, W28, W29): pages of two sides, of one with notes, and of two by place alone."""
    supplier = read(spark, sf_dir, "supplier")
    word = lambda x, y, seq, t: F.struct(F.expr(f"CAST({x} AS DOUBLE)").alias("x0"), F.expr(f"CAST({y} - 4 AS DOUBLE)").alias("top"), F.expr(f"CAST({y} + 4 AS DOUBLE)").alias("bottom"), F.lit(seq).alias("seq"), F.expr(t).alias("text"))
    pages = [F.array(*(word(*w) for w in _page(kind, False))) for kind in range(3)]
    kind = F.col("s_suppkey") % 3
    words = supplier.select("s_suppkey", F.explode(F.when(kind == 0, pages[0]).when(kind == 1, pages[1]).otherwise(pages[2])).alias("w")).select("s_suppkey", "w.*")
    return boxes.table_rows(words, ["s_suppkey"])
