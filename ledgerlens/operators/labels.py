"""Labels to accounting fields by a table of rules of any size.

Rules are rows: an exact tag, an exact name, a word that a label contains unless it contains others, a beginning, or a word that tells the two
ends of a period apart. Only distinct labels are matched, by equi-joins: names as they are, beginnings cut to the lengths that rules have, contained words by
their first two characters. The best find of each label, by stage and order, is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import free_name, simplified, strip_account_label
from ..sources.work import written
from .statements import ACCOUNTS, Account, label_candidates

RULES = "kind string, key string, bans array<string>, field string, place int"
#: Stages in the order in which they decide.
STAGES = ["period", "tag", "name", "contains", "prefix"]
#: Labels that one broadcast may hold.
MAX_BROADCAST_ROWS = 200_000

#: Words that make cash the one at the beginning or the end of a period.
PERIOD_WORDS = [("cash_begin", ["期初", "年初", "beginning"]), ("cash_end", ["期末", "年末", "年终", "endofperiod", "atend", "attheend"])]
#: Contained words, words that forbid it, and the field.
CONTAINED = [
    (["折旧", "折耗", "摊销"], ["累计"], "depreciation_amortization"),
    (["购建固定资产", "购置固定资产", "购买固定资产", "购建物业", "购置物业", "购买物业", "购建厂房", "购置厂房", "购建无形", "购置无形", "购建在建", "购置油气资产", "购建油气资产"], [], "capex"),
]
#: Beginnings of labels that are cut off or carry a tail.
BEGINNINGS = [
    ("accumdepreciation", "accumulated_depreciation"), ("accumulateddepreciation", "accumulated_depreciation"), ("allowancefordoubtful", "accumulated_depreciation"),
    ("accumamort", "accumulated_depreciation"), ("accruedexpense", "accrued_liabilities"), ("accruedliabilit", "accrued_liabilities"), ("notepayable", "long_term_debt"),
    ("paymentsforpurchaseofproperty", "capex"), ("purchaseofpropertyplantandequipment", "capex"),
]
#: Fields beside those of ACCOUNTS.
MORE_ACCOUNTS = [
    Account("accumulated_depreciation", "balance", ("累计折旧", "accumulated depreciation", "less accumulated depreciation", "allowance for doubtful accounts"), ("AccumulatedDepreciationDepletionAndAmortizationPropertyPlantAndEquipment",)),
    Account("fixed_assets_gross", "balance", ("固定资产原价", "固定资产原值"), ("PropertyPlantAndEquipmentGross",)),
    Account("dividends_payable", "balance", ("应付利润", "应付股利", "未付利润"), ("DividendsPayableCurrent", "DividendsPayable")),
    Account("treasury_stock", "balance", ("库存股", "treasury stock", "treasury shares"), ("TreasuryStockValue",)),
    Account("general_risk_reserve", "balance", ("一般风险准备",), ()),
    Account("other_comprehensive_income", "any", ("其他综合收益", "其他权益工具", "other comprehensive income"), ("AccumulatedOtherComprehensiveIncomeLossNetOfTax",)),
    Account("assets_less_current_liabilities", "balance", ("总资产减流动负债", "资产总额减流动负债", "total assets less current liabilities"), ()),
    Account("short_term_investments", "balance", ("短期投资", "以公允价值计量且其变动计入当期损益的金融资产", "short-term investments", "money market account"), ("ShortTermInvestments", "MarketableSecuritiesCurrent")),
    Account("interest_income", "any", ("利息收入", "interest income", "interest revenue"), ("InvestmentIncomeInterest",)),
    Account("stock_compensation", "income", ("股份支付", "以权益结算的股份支付", "share-based compensation"), ("ShareBasedCompensation",)),
    Account("section", "any", ("经营活动", "投资活动", "筹资活动", "current liabilities", "cash flows from operating activities", "cash flows from investing activities", "cash flows from financing activities"), ()),
]
#: Further names of fields in reports under international standards, older rules and of small companies.
MORE_NAMES = {
    "cash": ["现金及银行结余", "银行结余及现金", "现金及短期定期存款", "cash and bank balances", "cash and short-term time deposits", "petty cash", "operating account", "cash at bank and in hand"],
    "accounts_receivable": ["应收款项", "应收账款净额", "贸易应收款项", "trade and other receivables", "client fees receivables", "accounts receivable net"],
    "inventory": ["存货净额", "work in progress"],
    "fixed_assets": ["固定资产净额", "固定资产净值", "固定资产合计", "物业厂房及设备", "total property and equipment", "furniture and fixtures", "leasehold improvements", "office equipment", "machinery and equipment", "net fixed assets", "vehicles"],
    "intangible_assets": ["无形资产净额", "intangibles"],
    "total_assets": ["总资产", "资产总额"],
    "total_current_assets": ["流动资产", "current assets"],
    "total_noncurrent_assets": ["非流动资产", "non-current assets", "total other assets"],
    "total_liabilities": ["总负债", "负债总额"],
    "total_noncurrent_liabilities": ["长期负债合计", "total long-term liabilities"],
    "deferred_tax_assets": ["递延税项资产"],
    "deferred_tax_liabilities": ["递延税项负债"],
    "accounts_payable": ["应付款项", "贸易应付款项"],
    "accrued_liabilities": ["应计费用", "应计及其他应付款项", "其他应付款及应计费用", "accruals", "accruals and other payables"],
    "employee_payable": ["应付工资", "应付福利费", "accrued payroll", "wages payable", "pto payable"],
    "taxes_payable": ["应付税费", "应交税金", "未交税金", "即期税项", "应付所得税", "current taxation", "sales tax payable", "payroll taxes payable"],
    "short_term_debt": ["短期负债", "line of credit"],
    "long_term_debt": ["长期负债", "auto loans", "vehicle loans", "bank loan"],
    "minority_interest": ["非控制性权益"],
    "equity": ["所有者权益", "权益总额", "权益合计", "total shareholders equity", "stockholders equity", "owners equity", "partners capital", "members equity"],
    "equity_parent": ["归属于母公司股东的权益", "母公司所有者权益", "本公司权益股东应占权益总额", "储备", "reserves"],
    "share_capital": ["capital stock", "members contribution", "paid-in capital", "capital contribution"],
    "retained_earnings": ["留存收益", "current year profit", "prior year profit", "accumulated profit", "accumulated loss"],
    "net_current_assets": ["净流动资产", "net working capital"],
    "liabilities_and_equity": ["负债及所有者权益总计", "负债与所有者权益总计", "total liabilities and capital"],
    "revenue": ["主营业务收入", "销售收入", "产品销售收入", "商品销售收入", "营业收入合计", "net revenues", "total sales"],
    "cost_of_revenue": ["主营业务成本", "销售成本", "产品销售成本", "商品销售成本", "total cost of sales", "direct costs"],
    "gross_profit": ["产品销售利润", "主营业务利润", "gross margin"],
    "selling_expenses": ["销售及营销开支", "销售开支", "营销开支", "产品销售费用"],
    "admin_expenses": ["一般及行政开支", "行政开支", "管理费用合计", "salaries", "salaries and wages", "payroll", "rent or lease"],
    "rd_expenses": ["研发支出", "研发开支"],
    "operating_income": ["经营溢利", "营业溢利", "经营亏损", "营业亏损", "profit from operations", "loss from operations", "operating loss"],
    "pretax_income": ["所得税前利润", "除税前溢利", "除税前亏损", "税前亏损", "profit before taxation", "loss before taxation", "income before taxes"],
    "net_income": ["年度利润", "年度溢利", "年度亏损", "loss for the year", "profit for the period", "loss for the period", "net profit"],
    "fx_effect": ["汇率变动影响", "汇率变动之影响", "汇率波动之影响", "外汇汇率变动的影响"],
    "net_change_in_cash": ["现金及现金等价物净减少额", "现金及现金等价物增加净额", "现金及现金等价物减少净额"],
    "capex": ["购建固定资产等支付的现金", "资本开支", "purchases of property, plant and equipment"],
}


def cash_flow_names() -> dict[str, list[str]]:
    """Names of the three net cash flows: each activity with each form that reports use."""
    out: dict[str, list[str]] = {}
    for field, chinese, english in (("cfo", ["经营"], "operating"), ("cfi", ["投资"], "investing"), ("cff", ["筹资", "融资"], "financing")):
        forms = ["产生的现金流量净额", "现金流量净额", "所用现金净额", "所用的现金净额", "使用的现金流量净额", "使用的现金净额", "所得现金净额", "现金流出净额", "净现金流"]
        out[field] = [f"{a}活动{f}" for a in chinese for f in forms]
        out[field] += [f"net cash {flows}{verb} {english} activities" for flows in ("", "flows ") for verb in ("used in", "generated from", "provided by", "from")]
    out["cfo"] += ["net cash used in operations", "net cash generated from operations", "cash generated from operations"]
    return out


def default_rules(spark: SparkSession, accounts: Iterable[Account] = (*ACCOUNTS, *MORE_ACCOUNTS)) -> DataFrame:
    """The built-in rules as a table; add rows or hand over a table of one's own to extend them. The first rule of a key counts."""
    rows: list[tuple] = []
    put = lambda kind, key, field, bans=(): rows.append((kind, key, list(bans), field, len(rows)))
    for field, words in PERIOD_WORDS:
        for w in words:
            put("period", w, field)
    accounts = list(accounts)
    known = {a.name for a in accounts}
    for a in accounts:
        for t in a.tags:
            put("tag", t.lower(), a.name)
    for names in ({a.name: a.names for a in accounts}, MORE_NAMES, cash_flow_names()):
        for field, words in names.items():
            for w in words if field in known else ():
                put("name", w, field)
    for words, bans, field in CONTAINED:
        for w in words:
            put("contains", w, field, bans)
    for start, field in BEGINNINGS:
        put("prefix", start, field)
    return comparable(spark.createDataFrame(rows, RULES))


def comparable(rules: DataFrame) -> DataFrame:
    """Rules with names in the form in which labels are compared."""
    return rules.withColumn("key", F.when(F.col("kind") == "name", strip_account_label(simplified(F.col("key")))).otherwise(F.col("key")))


def candidates(label: Column) -> Column:
    """Spellings to try, from the label as it is to the most cut down: also without a note's number at its end."""
    whole = simplified(F.coalesce(label, F.lit("")))
    bare = F.regexp_replace(whole, r"(?i)(?<![0-9])\s*[（(]?[0-9]{1,3}(?:\([a-z]\)|[)）])?\s*$", "")
    return F.array_distinct(F.concat(label_candidates(whole), label_candidates(bare)))


def match_labels(labels: DataFrame, rules: DataFrame, label: str = "label", tag: str | None = None) -> DataFrame:
    """label[, tag], field, via for each distinct label (and tag) that a rule fits; NULL counts as ''.

    Stages decide in the order of STAGES. Of names the first spelling counts, of contained words the first rule, of beginnings the
    first spelling; a banned word rules out a spelling for that rule. A period's word counts in labels about cash only. A tag
    counts by its part after the last colon or underscore.
    """
    keys = ["label", "tag"] if tag else ["label"]
    own = [F.coalesce(F.col(label), F.lit("")).alias("label"), *([F.coalesce(F.col(tag), F.lit("")).alias("tag")] if tag else [])]
    # both are read once for each stage; the rows themselves are read once
    distinct = written(labels.select(*own).distinct().withColumn("cs", candidates(F.col("label"))), "labels")
    spelled = distinct.select(*keys, F.posexplode("cs").alias("at", "c"))
    rule = written(rules.groupBy("kind", "key").agg(F.min_by(F.struct("bans", "field", "place"), "place").alias("r")).select("kind", "key", "r.*"), "rules")
    find = lambda stage, first, second: [*keys, F.struct(F.lit(STAGES.index(stage)).alias("stage"), F.col(first).alias("first"), F.col(second).alias("second"), F.col("field").alias("field")).alias("found")]
    of = lambda stage: rule.where(F.col("kind") == stage).drop("kind")

    found = [spelled.join(of("name"), F.col("c") == F.col("key")).select(find("name", "at", "place"))]
    if tag:
        own_tag = F.lower(F.regexp_replace("tag", r"^.*[:_]", ""))
        found.append(distinct.where("tag <> ''").join(of("tag"), own_tag == F.col("key")).select(find("tag", "place", "place")))
    # one beginning of each length that a rule has
    lengths = rule.where("kind = 'prefix'").agg(F.collect_set(F.length("key")).alias("lengths"))
    cut = spelled.join(F.broadcast(lengths)).select(*keys, "at", "c", F.explode("lengths").alias("n")).where(F.length("c") >= F.col("n")).withColumn("start", F.substring("c", F.lit(1), F.col("n")))  # one row
    found.append(cut.join(of("prefix"), F.col("start") == F.col("key")).select(find("prefix", "at", "place")))
    # a word's first two characters must be somewhere in the spelling
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.substring(F.col("c"), i, F.lit(2))))
    words = rule.where(F.col("kind").isin("contains", "period")).withColumn("gram", F.substring("key", 1, 2))
    short = rule.where(F.col("kind").isin("contains", "period") & (F.length("key") == 1)).withColumn("gram", F.col("key"))
    several = F.array_distinct(F.concat(grams, F.transform(grams, lambda g: F.substring(g, 1, 1))))
    met = spelled.select(*keys, "at", "c", F.explode(several).alias("gram")).join(words.unionByName(short).distinct(), "gram")
    held = met.where(F.contains("c", "key") & ~F.exists("bans", lambda b: F.contains(F.col("c"), b)))
    found.append(held.where("kind = 'contains'").select(find("contains", "place", "at")))
    of_cash = spelled.where(F.contains("c", F.lit("现金")) | F.contains("c", F.lit("cash"))).select(*keys).distinct()
    found.append(held.where("kind = 'period'").join(of_cash, keys, "left_semi").select(find("period", "place", "at")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy(*keys).agg(F.min("found").alias("b"))
    return best.select(*keys, F.col("b.field").alias("field"), F.element_at(F.array(*map(F.lit, STAGES)), F.col("b.stage") + 1).alias("via"))


def identify(rows: DataFrame, rules: DataFrame, label: str = "label", tag: str | None = None) -> DataFrame:
    """Adds field and via to each row, NULL where no rule fits; columns of these names are replaced, others pass through.

    The distinct labels, with their spellings, and what was found for them are written tables. Rows are not moved while the labels that fit are few, by count; else they meet them by shuffle, where Spark may split a label that very many rows have.
    """
    rows = rows.drop("field", "via")
    found = written(match_labels(rows, rules, label, tag), "fields")
    few = found.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    own, own_tag = free_name(rows, "_label"), free_name(rows, "_tag")
    keys = {own: F.coalesce(F.col(label), F.lit("")), **({own_tag: F.coalesce(F.col(tag), F.lit(""))} if tag else {})}
    found = found.withColumnsRenamed({"label": own, "tag": own_tag})
    return rows.withColumns(keys).join(F.broadcast(found) if few else found, list(keys), "left").drop(*keys)
