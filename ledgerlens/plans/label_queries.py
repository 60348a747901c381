"""Labels and pages of statements: texts put together from words by key, which the SQL reads with its own patterns and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SIMPLIFIED, TRADITIONAL
from ..operators import labels, loading, notes, statements
from .table_queries import query, read


def _list(words, sql: bool) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"[{quoted}]" if sql else f"array({quoted})"


def _pick(words: list[str], by: str, sql: bool) -> str:
    """The word whose turn it is; the same text for both engines but for the list."""
    at = f"CAST(({by}) % {len(words)} AS INT) + 1"
    return f"{_list(words, sql)}[{at}]" if sql else f"element_at({_list(words, sql)}, {at})"


#: What labels are put together from: lead-ins, names in two scripts and languages, tails.
_LEADS = ["", "一、", "其中：", "减：", "加: ", "3、"]
_NAMES = [
    "營業收入", "营业成本", "Accounts Payable", "物業、廠房及設備", "Property, plant and equipment 物業、廠房及設備", "固定资产折旧、油气资产折耗", "累计摊销", "Accum. Depreciation - Equip",
    "期末現金及現金等價物", "Cash and cash equivalents at beginning of period", "货币资金", "經營活動所用現金淨額", "Net cash flows used in investing activities", "購建廠房", "Note payable to bank",
    "未知项目", "Total stockholders' equity", "递延税项资产", "负债和所有者权益(或股东权益)总计", "Goodwill", "31 December",
]
_TAILS = ["", "（附注12）", " 45(a)", "(净额)", "  26", " 2020", " 第二季度"]
_TAGS = ["", "us-gaap:Assets", "ifrs-full_Liabilities", "", "", "x:Unknown", "", "", ""]


def _label(sql: bool) -> str:
    return f"concat({_pick(_LEADS, 'p_partkey', sql)}, {_pick(_NAMES, 'p_partkey * 5', sql)}, {_pick(_TAILS, 'p_partkey', sql)})"


def _rx(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"


def _strip(x: str) -> str:
    """The comparing form of an account label in SQL."""
    low = _rx(f"lower({x})", r"[\s　]+")
    outside = _rx(low, r"[(（\[【][^)）\]】]*[)）\]】]")
    body = f"CASE WHEN {outside} = '' THEN {_rx(low, r'[()（）\[\]【】]')} ELSE {outside} END"
    body = _rx(body, r"^([一二三四五六七八九十]+[、.．]|[0-9]+[、.．]|[ivx]+\.)")
    return _rx(_rx(body, "^(其中|加|减|less|add)[:：]"), r"[,，.。;；:：''\"*、\-—_/]")


def _spellings(x: str) -> str:
    tail = _rx(x, r"[(（]?(附注|注释|note)[0-9一二三四五六七八九十、.\s]*[)）]?$")
    return "[" + ", ".join(map(_strip, (x, tail, _rx(tail, "[^一-鿿、]"), f"trim({_rx(tail, '[一-鿿、，：（）]', ' ')})"))) + "]"


def _rules_sql() -> str:
    rows, put = [], lambda *r: rows.append(r)
    for f, words in labels.PERIOD_WORDS:
        [put("period", w, "", f) for w in words]
    accounts = [*statements.ACCOUNTS, *labels.MORE_ACCOUNTS]
    [put("tag", t.lower(), "", a.name) for a in accounts for t in a.tags]
    for names in ({a.name: a.names for a in accounts}, labels.MORE_NAMES, labels.cash_flow_names()):
        [put("name", w, "", f) for f, words in names.items() for w in words]
    for words, bans, f in labels.CONTAINED:
        [put("contains", w, bans[0] if bans else "", f) for w in words]
    [put("prefix", start, "", f) for start, f in labels.BEGINNINGS]
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(map(quote, r))}, {k})" for k, r in enumerate(rows))
    key = f"CASE WHEN kind = 'name' THEN {_strip(_SIMPLE.format('key'))} ELSE key END"
    return f"SELECT kind, {key} AS key, ban, field, place FROM (VALUES {values}) AS r(kind, key, ban, field, place)"


_SIMPLE = f"translate({{}}, '{TRADITIONAL}', '{SIMPLIFIED}')"
# a number at the end counts as a note's where no digit stands before it
_BARE = r"regexp_replace(regexp_replace(w, '(^|[^0-9])\s*[（(]?[0-9]{1,3}(\([a-zA-Z]\)|[)）])?\s*$', '\1'), '\s+$', '')"


@query(
    f"""WITH r AS ({_rules_sql()}), d AS (SELECT DISTINCT {_label(True)} AS label, {_pick(_TAGS, "p_partkey", True)} AS tag FROM part), s AS (SELECT label, tag, {_SIMPLE.format("label")} AS w FROM d),
b AS (SELECT label, tag, w, {_BARE} AS bare FROM s), l AS (SELECT label, tag, list_concat({_spellings("w")}, {_spellings("bare")}) AS cs FROM b),
c AS (SELECT label, tag, i, cs[i] AS c FROM (SELECT label, tag, cs, unnest(range(1, len(cs) + 1)) AS i FROM l) WHERE cs[i] <> ''),
f AS (SELECT label, tag, field, 2 AS stage, i AS o, place AS p FROM c JOIN r ON kind = 'name' AND key = c
UNION ALL SELECT label, tag, field, 3, place, i FROM c JOIN r ON kind = 'contains' AND contains(c, key) AND NOT (ban <> '' AND contains(c, ban))
UNION ALL SELECT label, tag, field, 4, i, place FROM c JOIN r ON kind = 'prefix' AND starts_with(c, key)
UNION ALL SELECT label, tag, field, 1, place, place FROM d JOIN r ON kind = 'tag' AND tag <> '' AND key = lower(regexp_replace(tag, '^.*[:_]', ''))
UNION ALL SELECT label, tag, field, 0, place, i FROM c JOIN r ON kind = 'period' AND contains(c, key) WHERE (label, tag) IN (SELECT (label, tag) FROM c WHERE contains(c, '现金') OR contains(c, 'cash')))
SELECT p_partkey, field, ['period', 'tag', 'name', 'contains', 'prefix'][stage + 1] AS via FROM (SELECT p_partkey, {_label(True)} AS label, {_pick(_TAGS, "p_partkey", True)} AS tag FROM part) p
LEFT JOIN (SELECT label, tag, field, stage FROM f QUALIFY row_number() OVER (PARTITION BY label, tag ORDER BY stage, o, p) = 1) USING (label, tag)"""
)
def account_labels(spark, sf_dir):
    """Labels to accounting fields by the whole table of rules (J10, J11, K3-K6): every stage, bans, both scripts, tails and lead-ins."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_label(False)).alias("label"), F.expr(_pick(_TAGS, "p_partkey", False)).alias("tag"))
    return labels.identify(rows, labels.default_rules(spark), "label", "tag").select("p_partkey", "field", "via")


#: What pages are put together from: a heading, a body of words of statements, something that stands in front.
_FRONT = ["", "四、分部报告（续） ", "Segment information ", "项目 本期数 变动比例 主要变动原因 ", "MANAGEMENT DISCUSSION AND ANALYSIS ", "母公司资产负债表 ", "母公司 利润表 合并 ", "填" * 210 + "分部报告 ", "填" * 310 + "变动比例 "]
_BODIES = [
    "合并资产负债表 資產總計 负债合计 流动资产合计 货币资金 应收账款 存货 预付款项", "Total assets Total liabilities Current assets Inventories Loans and advances", "营业收入 营业利润 净利润 营业成本 销售费用 研发费用 分部信息",
    "营业收入 净利润 税金及附加", "Revenue Profit before tax Cost of Sales Gross Profit Insurance revenue", "经营活动产生的现金流量净额 投资活动产生的现金流量净额 筹资活动产生的现金流量净额 支付的各项税费 收到的税费返还 購建固定資產",
    "Net cash used in operating activities Net cash used in investing activities Income tax paid Interest received", "管理层讨论", "资产总计",
]


def _page(sql: bool) -> str:
    return f"concat({_pick(_FRONT, 'p_partkey', sql)}, {_pick(_BODIES, 'p_partkey * 7 + p_size', sql)}, ' ', {_pick(_BODIES, 'p_partkey * 11 + p_size', sql)})"


def _hits(value: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words, True)}, lambda x: contains({value}, x)))"


def _score(kind: str) -> str:
    def by_groups(groups) -> str:
        hits = [_hits("low", [w.lower() for w in g]) for g in groups]
        reached = " + ".join(f"CAST({h} > 0 AS INT)" for h in hits)
        return f"CASE WHEN {reached} >= 2 THEN 100 * ({reached}) + {' + '.join(hits)} ELSE 0 END"

    best = f"greatest({by_groups(statements.PAGE_MARKERS[kind])}, {by_groups(statements.PAGE_MARKERS_EN[kind])})"
    return f"CAST(CASE WHEN rows < 2 OR {best} = 0 THEN 0 ELSE {best} + 25 * {_hits('low', loading.DETAIL_LINES[kind])} - cost END AS INTEGER) AS {kind}"


@query(
    rf"""WITH t AS (SELECT p_partkey, p_size % 5 AS rows, {_SIMPLE.format(_page(True))} AS t FROM part), p AS (SELECT p_partkey, rows, lower(t) AS low,
CASE WHEN regexp_matches(t, '母公司\s*(资产负债表|利润表|现金流量表|损益表)') AND NOT contains(t, '合并') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(lower(t[1:200]), '分部报告|分部間|分部利润|分部分析|分部資料|segment information|segment results') THEN 80 ELSE 0 END
+ CASE WHEN regexp_matches(lower(t[1:300]), '情况说明|变动原因|变动比例|变动情况|主要原因|management discussion and analysis|change \(%\)') THEN 100 ELSE 0 END AS cost FROM t)
SELECT p_partkey, {", ".join(map(_score, ("balance", "income", "cash_flow")))} FROM p"""
)
def page_evidence(spark, sf_dir):
    """Evidence that a page is a statement, and what speaks against it (G26, G27, K7-K9): pages put together from words."""
    pages = read(spark, sf_dir, "part").select("p_partkey", F.expr(_page(False)).alias("text"), (F.col("p_size") % 5).alias("rows"))
    return loading.page_evidence(pages).select("p_partkey", *(F.col(k).cast("int").alias(k) for k in ("balance", "income", "cash_flow")))


#: What pages of running text are put together from: runs of names, some not known, and amounts.
_RUNS = ["货币资金", "流动资产合计应收账款", "项目应收账款存货", "不认识的科目", "归属于母公司股东的净利润", "净利润", "其中：存货", "负债和所有者权益总计", "表头 固定资产"]
_FIGURES = [" 5 1,000.00 900.00", " 20 ", "(1,234.5) —", " 401 7 6 5 4", " 12 34 56 78 90 12 34", " x 9", "  8.0　7.5 ", " — 3"]
_NAMES_BACK = "|".join(n[::-1] for n in sorted(notes.account_names(), key=lambda n: (-len(n), n)))


def _flow_page(sql: bool) -> str:
    parts = [f"{_pick(_RUNS, f's_suppkey * {a} + {k}', sql)}, {_pick(_FIGURES, f's_suppkey * {b} + {k}', sql)}, ' '" for k, (a, b) in enumerate([(1, 1), (2, 3), (5, 5), (7, 1), (4, 7), (1, 3), (8, 5), (2, 1), (7, 7), (5, 3)])]
    return f"concat({', '.join(parts)})"


@query(
    rf"""WITH t AS (SELECT s_suppkey, regexp_extract_all({_flow_page(True)}, '[一-鿿：]+|\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?|—|[^\s　]') AS t FROM supplier),
k AS (SELECT s_suppkey, t, unnest(range(1, len(t) + 1)) AS k FROM t),
p AS (SELECT s_suppkey, k, list_transform(regexp_extract_all(reverse(t[k]), '{_NAMES_BACK}'), lambda x: reverse(x)) AS labels, t[k + 1 : k + 6] AS f, list_transform(t[k + 1 : k + 6], lambda x: regexp_full_match(x, '\(?-?[0-9][0-9,]*(\.[0-9]+)?\)?|—')) AS a FROM k WHERE regexp_matches(t[k], '[一-鿿]')),
v AS (SELECT s_suppkey, k, labels, CASE WHEN list_contains(a, false) THEN f[1 : list_position(a, false) - 1] ELSE f END AS v FROM p),
n AS (SELECT *, len(v) >= 3 AND regexp_full_match(v[1], '[0-9]{{1,3}}') AND try_cast(v[1] AS INT) <= 400 AS numbered FROM v WHERE len(labels) > 0 AND len(v) > 0),
c AS (SELECT *, CASE WHEN numbered THEN v[2:] ELSE v END AS c, unnest(range(1, len(labels) + 1)) AS j FROM n)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY k, j) - 1 AS INTEGER) AS row_no, labels[j] AS label, CASE WHEN j = 1 AND numbered THEN v[1] ELSE '' END AS note,
CASE WHEN j = 1 THEN coalesce(c[1], '') ELSE '' END AS "current", CASE WHEN j = 1 THEN coalesce(c[2], '') ELSE '' END AS prior, count(DISTINCT k) OVER (PARTITION BY s_suppkey) >= 8 AS flows FROM c"""
)
def text_flow_rows(spark, sf_dir):
    """Tables that were read as running text, names run together among them (F13-F15): pages put together from runs and amounts."""
    pages = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_flow_page(False)).alias("t"))
    return notes.text_flow_rows(pages, "t", notes.account_names())
