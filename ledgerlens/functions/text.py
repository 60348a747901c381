"""Text functions on columns: tokens, normal forms, detectors. All JVM-side but NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two blocks of Chinese characters that tokens and language guesses use.
CJK = "一-鿿㐀-䶿"
#: What the overlap normaliser strips.
PUNCTUATION = r"""[\s　，。、；：？！“”‘’（）《》【】,.;:?!"'()\[\]{}<>\-—_/\\|*#]+"""


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once for each row, however often ``use`` has it.

    Inside lambdas, and where a text is put into many expressions, Spark works out each mention anew.
    """
    return F.transform(F.array(value), use)[0]


def word_hits(text: Column, groups: list[list[str]]) -> Column:
    """array<int>: how many words of each group a text contains, in Arrow batches."""

    @F.arrow_udf("array<int>")
    def hits(texts: pa.Array) -> pa.Array:
        rows = ((raw or b"").decode("utf-8", "replace") for raw in texts.cast(pa.binary()).to_pylist())
        return pa.array([[sum(w in t for w in g) for g in groups] for t in rows], pa.list_(pa.int32()))

    return hits(text)


def tokenize(text: Column) -> Column:
    """Lower-case Latin words, then single CJK characters, then their bigrams, all in order.

    Bigrams run over the sequence of CJK characters with everything else removed. NULL: no tokens.
    """
    words = lambda low: F.regexp_extract_all(low, F.lit("([a-z0-9][a-z0-9.%]*)"), F.lit(1))
    chars = lambda low: F.regexp_extract_all(low, F.lit(f"([{CJK}])"), F.lit(1))
    bigrams = lambda c: F.when(F.size(c) > 1, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.concat(words(low), once(chars(low), lambda c: F.concat(c, bigrams(c)))))


#: Radical characters that NFKC leaves, and the characters they stand for.
RADICALS = "⺦⺰⻅⻆⻈⻉⻋⻌⻐⻓⻔⻙⻚⻛⻜⻠⻢⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻲⺜⺝⺞⺠⺣⺧⺨⺩⺪⺫⺮⺯⺶⺹⺽⻁⻄⻇⻊⻏⻗⻘⻣⻤⻱"
RADICALS_AS = "丬纟见角讠贝车辶钅长门韦页风飞饣马鱼鸟卤麦黄黾齐齐齿齿龙龙龟日月歹民火牛犬玉疋目竹糸羊老臼虎西角足邑雨青骨鬼龟"


def normal_form(text: Column) -> Column:
    """NFKC, then radicals as the characters they stand for (F2); the same on the side of queries and of the index."""
    return F.translate(nfkc(text), RADICALS, RADICALS_AS)


#: Traditional characters of financial reports and their simplified forms.
TRADITIONAL = (
    "資產負債總額權業務應賬帳項現銀餘結貿廠設備稅潤營動經籌於揮潛購買賣費銷財減淨長計無遞預虧貸儲攤舊發"
    "貨幣損綜報註準則與轉換間屬處終彌補壞誤審閱會師書東聯匯兌為個們來時後從當對國際實質價過運輸車輛"
    "機構築電氣訊號碼頭廣場開關門閉閒險單據證認識議論許諾調試驗專類別級組織線網絡維續繼給約紙純細縮"
    "創劃勞勝勢區協衛參雙變嚴員喪團園圓圖圍壓執獎婦學寫寬導將尋數檢標歸決況測漲確種範簡擬擔盤監獲異"
)
SIMPLIFIED = (
    "资产负债总额权业务应账账项现银余结贸厂设备税润营动经筹于挥潜购买卖费销财减净长计无递预亏贷储摊旧发"
    "货币损综报注准则与转换间属处终弥补坏误审阅会师书东联汇兑为个们来时后从当对国际实质价过运输车辆"
    "机构筑电气讯号码头广场开关门闭闲险单据证认识议论许诺调试验专类别级组织线网络维续继给约纸纯细缩"
    "创划劳胜势区协卫参双变严员丧团园圆图围压执奖妇学写宽导将寻数检标归决况测涨确种范简拟担盘监获异"
)


def simplified(text: Column, pairs: dict[str, str] | None = None) -> Column:
    """Traditional characters of reports as simplified ones (F8); ``pairs``: a fuller table of one's own."""
    pairs = pairs or dict(zip(TRADITIONAL, SIMPLIFIED, strict=True))
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def unmapped_radicals(text: Column) -> Column:
    """Characters of the radical blocks that the normal form leaves."""
    return F.array_distinct(F.regexp_extract_all(normal_form(text), F.lit("([⺀-⻿⼀-⿟])"), F.lit(1)))


def overlap_form(text: Column) -> Column:
    """White space and punctuation stripped, lower case: the form in which texts are compared."""
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in function."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.ArrayType(T.StringType()))
def compatibility_characters(text: pd.Series) -> pd.Series:
    """Distinct characters that NFKC changes, in order of appearance."""
    return text.map(lambda s: [] if s is None else list(dict.fromkeys(c for c in s if unicodedata.normalize("NFKC", c) != c)))


def language(text: Column) -> Column:
    """'zh' if CJK / (CJK + letters / 3) is over 0.2, else 'en'."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]")).cast("double")
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(F.try_divide(cjk, cjk + letters / F.lit(3.0)) > 0.2, "zh").otherwise("en")


def page_range(text: Column) -> Column:
    """struct<first, last> of the page marks in a chunk; NULL without one."""
    mark = "【第 ([0-9]+)(?:[–-]([0-9]+))? 页"
    pages = F.filter(F.concat(F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.regexp_extract_all(text, F.lit(mark), F.lit(2))), lambda x: x != "")
    numbers = F.transform(pages, lambda x: x.cast("int"))
    return F.when(F.size(numbers) > 0, F.struct(F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last")))


def cite_label(source: Column, text: Column, para_start: Column) -> Column:
    """Source and page range if the chunk has page marks, else its first paragraph."""
    r = page_range(text)
    place = (
        F.when(r.isNull(), F.concat(F.lit("第 "), para_start.cast("string"), F.lit(" 段")))
        .when(r["first"] == r["last"], F.concat(F.lit("第 "), r["first"].cast("string"), F.lit(" 页")))
        .otherwise(F.concat(F.lit("第 "), r["first"].cast("string"), F.lit("–"), r["last"].cast("string"), F.lit(" 页")))
    )
    return F.concat_ws(" ", source, place)


def clean_lines(text: Column) -> Column:
    """Runs of blanks folded, trailing blanks and runs of empty lines squeezed; spaces between CJK removed."""
    folded = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t　]+", " ")
    tight = F.regexp_replace(folded, f"(?<=[{CJK}]) (?=[{CJK}])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(tight, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def html_text(html: Column) -> Column:
    """Visible text of a page: script, style and head dropped, tags to blanks, blank runs squeezed."""
    without = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)>", " ")
    plain = F.regexp_replace(F.regexp_replace(without, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), f"[^a-z0-9{CJK}]+", "-"), "^-+|-+$", "")


def digest(data: Column) -> Column:
    """struct<bytes, sha16> of a payload: its length and 16 hex digits of its SHA-256."""
    raw = F.coalesce(data.cast("binary"), F.lit(b""))
    return F.struct(F.octet_length(raw).cast("long").alias("bytes"), F.substring(F.sha2(raw, 256), 1, 16).alias("sha16"))


def ordered_case(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first kind any of whose keywords the lower-case text contains; NULL if none."""
    low, out = F.lower(text), None
    for kind, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(None).cast("string") if out is None else out


#: Markers of accounting standards, in order of judgement.
GAAP_MARKERS = [
    ("CAS", ["企业会计准则", "中国会计准则", "cas"]),
    ("IFRS", ["国际财务报告准则", "international financial reporting standards", "ifrs", "hkfrs"]),
    ("US-GAAP", ["美国公认会计原则", "generally accepted accounting principles", "us gaap", "u.s. gaap"]),
]
#: Kinds of assumption by keyword, the specific ones first.
ASSUMPTION_KINDS = [
    ("terminal_growth", ["永续增长", "terminal growth", "perpetual growth"]),
    ("wacc", ["wacc", "折现率", "discount rate"]),
    ("margin", ["利润率", "毛利率", "margin"]),
    ("capex", ["资本开支", "资本支出", "capex"]),
    ("nwc", ["营运资金", "营运资本", "working capital"]),
    ("tax", ["税率", "tax rate"]),
    ("growth", ["增长", "增速", "growth", "cagr"]),
    ("multiple", ["倍数", "乘数", "multiple"]),
]


def gaap(text: Column) -> Column:
    """The standard with most marker hits in the text, earlier listed on a tie; NULL without hits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.struct(sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, marks) in enumerate(GAAP_MARKERS)]
    best = F.greatest(*hits)
    return F.when(best["n"] > 0, best["kind"])


def scope(text: Column) -> Column:
    """consolidated, parent or single."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("合并|consolidated"), "consolidated").when(low.rlike("母公司|parent company"), "parent").otherwise("single")


def unit(text: Column) -> Column:
    """struct<scale, currency>: the first pattern that matches, a currency only where one is named."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scale = (
        F.when(low.rlike("单位[:：]?\\s*(人民币)?百万元"), 1e6).when(low.rlike("单位[:：]?\\s*(人民币)?万元"), 1e4)
        .when(low.rlike("单位[:：]?\\s*(人民币)?千元"), 1e3).when(low.rlike("单位[:：]?\\s*(人民币)?亿元"), 1e8)
        .when(low.rlike("单位[:：]?\\s*(人民币)?元"), 1.0).when(low.rlike("in billions"), 1e9)
        .when(low.rlike("in millions|百萬"), 1e6).when(low.rlike("in thousands|千元"), 1e3)
    )
    currency = F.when(low.rlike("人民币|rmb|cny"), "CNY").when(low.rlike("港元|港币|hk\\$|hkd"), "HKD").when(low.rlike("美元|us\\$|u\\.s\\. dollars|usd"), "USD").when(low.rlike("元"), "CNY")
    return F.struct(scale.alias("scale"), currency.alias("currency"))


def strip_account_label(label: Column) -> Column:
    """An account label in its comparing form: lower case, without blanks, brackets' content, ordinals or lead-ins."""
    low = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[\s　]+", "")
    outside = F.regexp_replace(low, r"[(（\[【][^)）\]】]*[)）\]】]", "")
    body = F.when(outside == "", F.regexp_replace(low, r"[()（）\[\]【】]", "")).otherwise(outside)
    body = F.regexp_replace(body, r"^([一二三四五六七八九十]+[、.．]|[0-9]+[、.．]|[ivx]+\.)", "")
    body = F.regexp_replace(body, r"^(其中|加|减|less|add)[:：]", "")
    return F.regexp_replace(body, r"[,，.。;；:：'\"*、\-—_/]", "")
