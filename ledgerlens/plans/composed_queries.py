"""Detectors and parsers over texts put together from parts by key; the SQL reads the same texts with its own patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.text import ASSUMPTION_KINDS, GAAP_MARKERS
from ..operators import audit, notes, overlap, recipes
from ..sources import files, markets
from .label_queries import _list, _pick
from .table_queries import query, read

_SCOPES = ["合并财务报表 ", "母公司 ", "Consolidated statements ", "", "Parent company only "]
_UNITS = ["单位：人民币万元 ", "单位:元 ", "in millions ", "百萬 ", "HK$ in thousands ", "USD ", "单位: 千元 ", "", "亿元 ", "单位：百万元 in billions "]
_RULES = ["按企业会计准则 ", "IFRS ", "under U.S. GAAP and IFRS ", "HKFRS ", "", "generally accepted accounting principles ", "国际财务报告准则 中国会计准则 "]
_KINDS = ["营业收入增长率", "Terminal growth", "WACC 折现率", "gross margin", "capex plan", "税率", "", "倍数 and growth", "working capital days"]


def _mixed(sql: bool) -> str:
    return f"concat({_pick(_SCOPES, 'o_orderkey', sql)}, {_pick(_UNITS, 'o_orderkey * 3 + o_custkey', sql)}, {_pick(_RULES, 'o_orderkey * 5', sql)}, {_pick(_KINDS, 'o_orderkey * 7 + o_custkey', sql)})"


_CJK_N, _LETTERS = "CAST(length(regexp_replace(t, '[^一-鿿㐀-䶿]', '', 'g')) AS DOUBLE)", "length(regexp_replace(t, '[^A-Za-z]', '', 'g'))"
_HITS = [f"len(list_filter({_list(marks, True)}, lambda x: contains(low, x)))" for _, marks in GAAP_MARKERS]
_TOP = f"greatest({', '.join(_HITS)})"
_GAAP = f"CASE WHEN {_TOP} = 0 THEN NULL {' '.join(f"WHEN {h} = {_TOP} THEN '{kind}'" for h, (kind, _) in zip(_HITS, GAAP_MARKERS, strict=True))} END"
_KIND = "CASE " + " ".join(f"WHEN len(list_filter({_list(words, True)}, lambda x: contains(low, x))) > 0 THEN '{kind}'" for kind, words in ASSUMPTION_KINDS) + " END"


@query(
    rf"""WITH m AS (SELECT o_orderkey, {_mixed(True)} AS t FROM orders), l AS (SELECT o_orderkey, t, lower(t) AS low FROM m)
SELECT o_orderkey, CASE WHEN {_CJK_N} / nullif({_CJK_N} + {_LETTERS} / 3.0, 0) > 0.2 THEN 'zh' ELSE 'en' END AS lang, {_GAAP} AS gaap, {_KIND} AS kind,
CASE WHEN regexp_matches(low, '合并|consolidated') THEN 'consolidated' WHEN regexp_matches(low, '母公司|parent company') THEN 'parent' ELSE 'single' END AS scope,
CASE WHEN regexp_matches(low, '单位[:：]?\s*(人民币)?百万元') THEN 1e6 WHEN regexp_matches(low, '单位[:：]?\s*(人民币)?万元') THEN 1e4 WHEN regexp_matches(low, '单位[:：]?\s*(人民币)?千元') THEN 1e3 WHEN regexp_matches(low, '单位[:：]?\s*(人民币)?亿元') THEN 1e8 WHEN regexp_matches(low, '单位[:：]?\s*(人民币)?元') THEN 1.0
WHEN contains(low, 'in billions') THEN 1e9 WHEN contains(low, 'in millions') OR contains(low, '百萬') THEN 1e6 WHEN contains(low, 'in thousands') OR contains(low, '千元') THEN 1e3 END::DOUBLE AS scale,
CASE WHEN regexp_matches(low, '人民币|rmb|cny') THEN 'CNY' WHEN regexp_matches(low, '港元|港币|hk\$|hkd') THEN 'HKD' WHEN regexp_matches(low, '美元|us\$|u\.s\. dollars|usd') THEN 'USD' WHEN contains(low, '元') THEN 'CNY' END AS currency FROM l"""
)
def detected_texts(spark, sf_dir):
    """Language, standard, kind of assumption, scope, unit and currency of texts."""
    t = F.col("t")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_mixed(False)).alias("t"))
    return rows.select("o_orderkey", text.language(t).alias("lang"), text.gaap(t).alias("gaap"), text.ordered_case(t, ASSUMPTION_KINDS).alias("kind"), text.scope(t).alias("scope"), text.unit(t)["scale"].cast("double").alias("scale"), text.unit(t)["currency"].alias("currency"))


_OPENS, _CLOSES = ["", "(", "-", "$ ", "（", ""], ["", ")", "）", " ", "%", ")", ""]


def _cell(sql: bool) -> str:
    as_text = "VARCHAR" if sql else "STRING"
    a = f"CAST(o_orderkey % 900 + 1 AS {as_text})"
    b, c = (f"lpad(CAST(o_orderkey * {n} % 1000 AS {as_text}), 3, '0')" for n in (7, 11))
    cores = [f"concat({a}, ',', {b})", f"concat({a}, '.', {b}, '.', {c})", f"concat({a}, ',', {b}, '.50')", f"concat({a}, ', ', {b}, '.75')", a, f"concat({a}, '.', {b}, ',75')", f"concat('x', {a})", "'—'", "''", f"concat({a}, ',', {b}, ',', {c}, '.2')", f"concat('US$', {a})"]
    at = f"CAST((o_orderkey * 3 + o_custkey) % {len(cores)} AS INT) + 1"
    core = f"[{', '.join(cores)}][{at}]" if sql else f"element_at(array({', '.join(cores)}), {at})"
    return f"concat({_pick(_OPENS, 'o_orderkey', sql)}, {core}, {_pick(_CLOSES, 'o_orderkey * 2 + o_custkey', sql)})"


@query(
    rf"""WITH m AS (SELECT o_orderkey, {_cell(True)} AS cell FROM orders), s AS (SELECT *, trim(cell) AS s, regexp_replace(trim(cell), '^[(（]|[)）]$', '', 'g') AS body, regexp_replace(trim(cell), '[\s 　]', '', 'g') AS tight FROM m),
r AS (SELECT *, regexp_full_match(s, '[(（].*[)）]') AS neg, regexp_full_match(body, '-?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\.[0-9]{{1,4}})?') AS strict, regexp_replace(trim(body), '\s*([,.])\s*', '\1', 'g') AS r FROM s),
f AS (SELECT *, try_cast(CASE WHEN regexp_full_match(r, '-?[0-9]{{1,3}}([.,][0-9]{{3}})+[.,][0-9]{{2}}') THEN regexp_replace(r[1 : length(r) - 3], '[.,]', '', 'g') || '.' || r[length(r) - 1 :] WHEN regexp_full_match(r, '-?[0-9]{{1,3}}(\.[0-9]{{3}}){{2,}}') THEN replace(r, '.', '') END AS DOUBLE) AS fixed,
regexp_replace(regexp_replace(tight, '^(\()?(us\$|hk\$|rmb|usd|[$¥￥€£])', '\1'), '[,，]', '', 'g') AS plain FROM r),
g AS (SELECT *, regexp_replace(regexp_replace(plain, '^[(（]|[)）]$', '', 'g'), '^[$¥￥€£]', '') AS bare FROM f)
SELECT o_orderkey, CASE WHEN s = '' THEN 'empty' WHEN regexp_full_match(s, '[-–—－]+') THEN 'dash' WHEN strict THEN 'ok' WHEN fixed IS NOT NULL THEN 'repaired' ELSE 'suspect' END AS status, CASE WHEN neg THEN -1 ELSE 1 END * CASE WHEN strict THEN try_cast(replace(body, ',', '') AS DOUBLE) ELSE fixed END AS amount,
CASE WHEN plain <> '' AND NOT regexp_full_match(plain, '[-–—－]+') AND regexp_full_match(bare, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN CASE WHEN regexp_full_match(plain, '[(（].*[)）]') THEN -1 ELSE 1 END * try_cast(bare AS DOUBLE) END AS number,
regexp_full_match(s, '[(（]?-?[0-9][0-9,.\s]*[)）]?|[-–—]+') AS looks, regexp_full_match(s, '[0-9]{{1,3}}') AND coalesce(try_cast(s AS INT) <= 400, false) AS row_number FROM g"""
)
def amount_cells(spark, sf_dir):
    """Cells as strict and as lenient numbers, and what they look like."""
    c = F.col("cell")
    cells = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_cell(False)).alias("cell"))
    return cells.select("o_orderkey", numbers.amount(c)["status"].alias("status"), numbers.amount(c)["value"].alias("amount"), numbers.lenient_number(c).alias("number"), numbers.looks_like_amount(c).alias("looks"), numbers.row_number_like(c).alias("row_number"))


_MARKS = ["【第 3 页】", "no mark ", "【第 12–15 页】", "【第 7-9 页 表】", "第 4 页", "【第 20 页】 and 【第 18 页】"]


def _passage(sql: bool) -> str:
    return f"concat({_pick(_MARKS, 'o_orderkey', sql)}, ' text ', {_pick(_MARKS, 'o_orderkey * 5 + o_custkey', sql)})"


@query(
    f"""WITH m AS (SELECT o_orderkey, {_passage(True)} AS t FROM orders), n AS (SELECT o_orderkey, list_transform(list_filter(list_concat(regexp_extract_all(t, '【第 ([0-9]+)(?:[–-]([0-9]+))? 页', 1), regexp_extract_all(t, '【第 ([0-9]+)(?:[–-]([0-9]+))? 页', 2)), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS n FROM m)
SELECT o_orderkey, 'src ' || CASE WHEN len(n) = 0 THEN '第 ' || o_orderkey || ' 段' WHEN list_min(n) = list_max(n) THEN '第 ' || list_min(n) || ' 页' ELSE '第 ' || list_min(n) || '–' || list_max(n) || ' 页' END AS label FROM n"""
)
def cited_places(spark, sf_dir):
    """Labels of citations: the range of pages marked, else the paragraph."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_passage(False)).alias("t"))
    return rows.select("o_orderkey", text.cite_label(F.lit("src"), F.col("t"), F.col("o_orderkey")).alias("label"))


_KEYS, _VALUES, _TAILS = ["wacc ", "growth", " # note", "tax_rate", "memo"], [" = 0.1", "=5 %", " =", "", " = a = b", "= "], ["", " @high:10-K p. 4", " @low", "  @ :x", " mail@host"]


def _line(sql: bool) -> str:
    return f"concat({_pick(_KEYS, 'o_orderkey', sql)}, {_pick(_VALUES, 'o_orderkey * 5 + o_custkey', sql)}, {_pick(_TAILS, 'o_orderkey * 3 + o_custkey', sql)})"


@query(
    rf"""WITH m AS (SELECT o_orderkey, trim({_line(True)}) AS t FROM orders), k AS (SELECT o_orderkey, t, regexp_extract(t, '^[^=]*=(.*)$', 1) AS r FROM m WHERE NOT starts_with(t, '#') AND contains(t, '='))
SELECT o_orderkey, trim(split_part(t, '=', 1)) AS key, nullif(trim(regexp_replace(r, '\s@[^@]*$', '', 'g')), '') AS value, nullif(regexp_extract(r, '\s@([^:@]*)', 1), '') AS confidence, nullif(trim(regexp_extract(r, '\s@[^:@]*:(.*)$', 1)), '') AS source FROM k"""
)
def answer_file_lines(spark, sf_dir):
    """Lines of answer files with confidence and source."""
    lines = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_line(False)).alias("value"))
    return files.parse_answers(lines, keep=("o_orderkey",))


_HOSTS = ["data.sec.gov", "www.sec.gov", "localhost", "localhost:11434", "127.0.0.1:80", "qt.gtimg.cn", "hq.sinajs.cn", "example.com", "localhost.example.com", "data.sec.gov.evil.org", "[::1]:9", ""]
_CONSENTS = [("qt.gtimg.cn", "purchase"), ("hq.sinajs.cn", "click"), ("example.com", "view")]


@query(
    rf"""WITH r AS (SELECT event_id, {_pick(_HOSTS, 'event_id * 5 + user_id', True)} AS host, event_type AS purpose FROM events), c AS (SELECT * FROM (VALUES {", ".join(map(str, _CONSENTS))}) AS v(host, purpose))
SELECT event_id, host, CASE WHEN regexp_full_match(host, '(localhost|127\.[0-9.]+|\[?::1\]?)(:[0-9]+)?') OR list_contains({_list(audit.ALLOWED_HOSTS, True)}, host) THEN 'ALLOW' WHEN NOT list_contains({_list(audit.CONSENT_HOSTS, True)}, host) THEN 'BLOCK'
WHEN EXISTS (SELECT 1 FROM c WHERE c.host = r.host AND c.purpose = r.purpose) THEN 'ALLOW-CONSENT' ELSE 'CONSENT-REQUIRED' END AS decision FROM r"""
)
def request_decisions(spark, sf_dir):
    """Who may be asked for what, by list, loopback pattern and consent to host and purpose."""
    asked = read(spark, sf_dir, "events").select("event_id", F.expr(_pick(_HOSTS, "event_id * 5 + user_id", False)).alias("host"), F.col("event_type").alias("purpose"))
    return audit.decide(asked, spark.createDataFrame(_CONSENTS, "host string, purpose string")).select("event_id", "host", "decision")


_HEADS, _REST = ["AAPL", "file:", "FILE:/x", "/etc/", "C:", "营业收入" * 5, "营业收入" * 6, "x" * 60], ["", " ", "2024", "abcde", "\\\\tmp", "净"]


@query(
    rf"""WITH p AS (SELECT o_orderkey, concat({_pick(_HEADS, "o_orderkey", True)}, {_pick([r.replace(chr(92) * 2, chr(92)) for r in _REST], "o_orderkey * 5 + o_custkey", True)}) AS v FROM orders)
SELECT o_orderkey, length(v) <= 64 AND NOT regexp_matches(v, '[\r\n\t]') AND NOT regexp_matches(lower(v), '^(file:|/|\\|[a-z]:\\)') AND NOT regexp_matches(v, '[一-鿿]{{21,}}') AS valid FROM p"""
)
def parameter_values(spark, sf_dir):
    """Which values may leave: short, one line, no local path, no long run of Chinese (P10)."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"concat({_pick(_HEADS, 'o_orderkey', False)}, {_pick(_REST, 'o_orderkey * 5 + o_custkey', False)})").alias("v"))
    return rows.select("o_orderkey", overlap.valid_parameter(F.col("v")).alias("valid"))


_TRADES = ["SaaS and software ", "物流 freight ", "a restaurant franchise ", "电商 marketplace ", "clinical drug trials ", "芯片 wafer ", "plain ", "advertising 营销 ", "battery 新能源 photovoltaic ", "tuition "]
_WORDS = ", ".join(f"({i}, '{n}', {_list(words, True)})" for i, (n, words, _) in enumerate(recipes.INDUSTRIES))


def _trade(sql: bool) -> str:
    return f"concat({_pick(_TRADES, 'p_partkey', sql)}, p_name, ' ', {_pick(_TRADES, 'p_partkey * 3 + p_size', sql)}, {_pick(_TRADES, 'p_partkey * 7 + p_size', sql)})"


@query(
    f"""WITH d AS (SELECT p_partkey, lower({_trade(True)}) AS t FROM part), i AS (SELECT * FROM (VALUES {_WORDS}) AS v(place, industry, words)), h AS (SELECT p_partkey, industry, place, len(list_filter(words, lambda w: contains(t, w))) AS n FROM d, i)
SELECT p_partkey, industry, CAST(n AS INTEGER) AS hits, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, place) AS INTEGER) AS rank FROM h WHERE n > 0 QUALIFY rank <= 4"""
)
def industry_ranks(spark, sf_dir):
    """The industries that a description speaks for, by words that it holds."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_trade(False)).alias("t"))
    return recipes.propose_industries(rows, "p_partkey", "t").select("p_partkey", "industry", F.size("evidence").alias("hits"), "rank")


_COMPANIES, _ENDS, _CODES = ["某集团", "AB", "东方能源", "某某控股", "年度报告 2023", "长名" * 20], ["股份有限公司", "有限公司", "集团有限公司2023年", "公司", "集团", "研究所"], ["股票代码： 600519", "Code 00700", "代碼:123", "代码: 12", "no number", "证券代码 300750 / 代码 1"]


def _cover(sql: bool) -> str:
    newline = "chr(10)"
    return f"concat({_pick(_COMPANIES, 's_suppkey', sql)}, {newline}, '  ', {_pick(_COMPANIES, 's_suppkey * 5 + 1', sql)}, s_suppkey, {_pick(_ENDS, 's_suppkey * 7', sql)}, {newline}, {_pick(_CODES, 's_suppkey * 11', sql)}, {newline}, {_pick(_COMPANIES, 's_suppkey + 2', sql)}, {_pick(_ENDS, 's_suppkey + 3', sql)})"


@query(
    rf"""WITH c AS (SELECT s_suppkey, {_cover(True)} AS t FROM supplier), l AS (SELECT s_suppkey, t, list_filter(list_transform(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: coalesce(nullif(regexp_extract(x, '^(.{{4,}}(?:公司|集团))(?:2|２０)', 1), ''), x)), lambda x: length(x) BETWEEN 4 AND 40) AS l FROM c)
SELECT s_suppkey, coalesce(list_filter(l, lambda x: regexp_matches(x, '(股份有限公司|集团有限公司|有限公司)$'))[1], list_filter(l, lambda x: regexp_matches(x, '(公司|集团)$'))[1]) AS company, nullif(regexp_extract(t, '(?i)(?:代码|代碼|code)\s*[:：]?\s*([0-9]{{4,6}})', 1), '') AS code FROM l"""
)
def cover_lines(spark, sf_dir):
    """Company and code on covers with several names."""
    t = F.col("t")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_cover(False)).alias("t"))
    return rows.select("s_suppkey", notes.company_line(t).alias("company"), notes.cover_code(t).alias("code"))


def _bar(sql: bool) -> str:
    day = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)" if sql else "CAST(CAST(o_orderdate AS DATE) AS STRING)"
    price = "CAST(o_orderkey % 90 + 1 AS VARCHAR)" if sql else "CAST(o_orderkey % 90 + 1 AS STRING)"
    shapes = [
        f"concat('[\"', {day}, '\", \"1\", \"', {price}, '\", \"9\", \"1\", \"5\", \"more\"]')", f"concat('[\"', {day}, '\", 1, ', {price}, ']')", f"concat('[\"2024-13-01\", \"1\", \"', {price}, '\", \"9\", \"1\", \"5\"]')",
        f"concat('[\"', {day}, '\", \"1\", \"n/a\", \"9\", \"1\", \"5\"]')", f"concat('[\" ', {day}, ' \", 1, ', {price}, '.25, 9, 1, 5]')", "'no list'",
    ]
    at = f"CAST((o_orderkey * 5 + o_custkey) % {len(shapes)} AS INT) + 1"
    return f"[{', '.join(shapes)}][{at}]" if sql else f"element_at(array({', '.join(shapes)}), {at})"


@query(
    rf"""WITH b AS (SELECT o_orderkey AS code, {_bar(True)} AS v FROM orders), p AS (SELECT code, list_transform(string_split(regexp_replace(v, '[\[\]"]', '', 'g'), ','), lambda x: trim(x)) AS a FROM b WHERE starts_with(v, '['))
SELECT code, try_cast(a[1] AS DATE) AS date, try_cast(a[3] AS DOUBLE) AS close FROM p WHERE len(a) >= 6 AND try_cast(a[1] AS DATE) IS NOT NULL AND try_cast(a[3] AS DOUBLE) IS NOT NULL"""
)
def bar_lists(spark, sf_dir):
    """Bars given as JSON lists in several shapes, short and broken ones dropped."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"), F.expr(_bar(False)).alias("value"))
    return files.parse_bars(markets.bars_from_lists(rows), ["code"]).select("code", "date", "close")


_BEFORE, _AMOUNTS = ["", "x ", "附注 "], [" 1,234.5 ", " (30.25)", "：—5", " 无 ", "、无形资产摊销 7", "－10.5 x", " " * 50 + "9"]
_NET, _CFO = ["净利润 100 ", "净利润 (7.5) ", ""], ["经营活动产生的现金流量净额 125.5", "经营活动产生的现金流量净额 131", ""]


def _note(sql: bool) -> str:
    return f"concat({_pick(_NET, 's_suppkey', sql)}, {_pick(_BEFORE, 's_suppkey * 5', sql)}, '固定资产折旧', {_pick(_AMOUNTS, 's_suppkey * 3', sql)}, ' 无形资产摊销', {_pick(_AMOUNTS, 's_suppkey * 5 + 1', sql)}, ' ', {_pick(_CFO, 's_suppkey * 2', sql)})"


def _after(label: str) -> str:
    """struct of amount and place of the first figure within 48 characters after a label, in SQL."""
    tail = f"substr(t, instr(t, '{label}') + {len(label)}, 48)"
    sign = r"^([^0-9]*?)([(\-" + notes.DASHES + r"]?)([0-9][0-9,]*(?:\.[0-9]+)?)"
    part = lambda k: f"regexp_extract({tail}, '{sign}', {k})"
    return f"CASE WHEN contains(t, '{label}') AND {part(3)} <> '' THEN {{'a': CASE WHEN {part(2)} = '' THEN 1 ELSE -1 END * CAST(replace({part(3)}, ',', '') AS DOUBLE), 'p': instr(t, '{label}') + {len(label)} + length({part(1)})}} END"


@query(
    f"""WITH n AS (SELECT s_suppkey, {_note(True)} AS t FROM supplier), f AS (SELECT s_suppkey, {_after("净利润")} AS n, {_after("固定资产折旧")} AS d, {_after("无形资产摊销")} AS m, {_after("经营活动产生的现金流量净额")} AS c FROM n),
u AS (SELECT *, CASE WHEN m.p IS NULL OR m.p IS NOT DISTINCT FROM d.p THEN NULL ELSE m.a END AS own FROM f)
SELECT s_suppkey, nullif(d.a, 0) AS depreciation, nullif(own, 0) AS amortisation, n.a + coalesce(d.a, 0) + coalesce(own, 0) - c.a AS diff, abs(n.a + coalesce(d.a, 0) + coalesce(own, 0) - c.a) <= greatest(1.0, abs(c.a) * 0.0005) AS ok FROM u"""
)
def note_amounts(spark, sf_dir):
    """Amounts after labels with their signs, a figure that two labels reach once, and the reconciliation."""
    t = F.col("t")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_note(False)).alias("t"))
    d, r = notes.depreciation(t), notes.reconcile(t)
    return rows.select("s_suppkey", F.try_element_at(d, F.lit("固定资产折旧")).alias("depreciation"), F.try_element_at(d, F.lit("无形资产摊销")).alias("amortisation"), r["diff"].alias("diff"), r["ok"].alias("ok"))
