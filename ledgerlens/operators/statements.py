"""Statement rows: labels to accounting fields, conflicts between pages, page evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import free_name, once, strip_account_label, word_hits


@dataclass(frozen=True)
class Account:
    """A field, the statement it belongs to, its names and its tags."""

    name: str
    statement: str
    names: tuple[str, ...]
    tags: tuple[str, ...] = ()


#: Accounting fields with common names in two languages and XBRL tags.
ACCOUNTS = [
    Account("revenue", "income", ("营业收入", "营业总收入", "revenue", "revenues", "net sales", "total revenue"), ("Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax")),
    Account("cost_of_revenue", "income", ("营业成本", "cost of revenue", "cost of sales", "cost of goods sold"), ("CostOfRevenue", "CostOfGoodsAndServicesSold")),
    Account("gross_profit", "income", ("毛利", "毛利润", "gross profit"), ("GrossProfit",)),
    Account("operating_income", "income", ("营业利润", "operating income", "operating profit", "income from operations"), ("OperatingIncomeLoss",)),
    Account("pretax_income", "income", ("利润总额", "税前利润", "income before income taxes", "profit before tax"), ("IncomeLossFromContinuingOperationsBeforeIncomeTaxes",)),
    Account("income_tax", "income", ("所得税费用", "所得税", "income tax expense", "provision for income taxes"), ("IncomeTaxExpenseBenefit",)),
    Account("net_income", "income", ("净利润", "net income", "net earnings", "profit for the year"), ("NetIncomeLoss", "ProfitLoss")),
    Account("interest_expense", "income", ("利息费用", "利息支出", "interest expense"), ("InterestExpense",)),
    Account("depreciation_amortization", "any", ("折旧与摊销", "折旧和摊销", "depreciation and amortization"), ("DepreciationDepletionAndAmortization",)),
    Account("cash", "balance", ("货币资金", "现金及现金等价物", "cash and cash equivalents"), ("CashAndCashEquivalentsAtCarryingValue",)),
    Account("accounts_receivable", "balance", ("应收账款", "accounts receivable", "trade receivables"), ("AccountsReceivableNetCurrent",)),
    Account("inventory", "balance", ("存货", "inventories", "inventory"), ("InventoryNet",)),
    Account("total_current_assets", "balance", ("流动资产合计", "total current assets"), ("AssetsCurrent",)),
    Account("total_assets", "balance", ("资产总计", "资产合计", "total assets"), ("Assets",)),
    Account("short_term_debt", "balance", ("短期借款", "short-term borrowings", "short-term debt"), ("ShortTermBorrowings", "DebtCurrent")),
    Account("accounts_payable", "balance", ("应付账款", "accounts payable", "trade payables"), ("AccountsPayableCurrent",)),
    Account("total_current_liabilities", "balance", ("流动负债合计", "total current liabilities"), ("LiabilitiesCurrent",)),
    Account("long_term_debt", "balance", ("长期借款", "long-term debt", "long-term borrowings"), ("LongTermDebtNoncurrent", "LongTermDebt")),
    Account("total_liabilities", "balance", ("负债合计", "负债总计", "total liabilities"), ("Liabilities",)),
    Account("minority_interest", "balance", ("少数股东权益", "non-controlling interests", "noncontrolling interests"), ("MinorityInterest",)),
    Account("equity", "balance", ("所有者权益合计", "股东权益合计", "total equity", "total stockholders equity"), ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    Account("cfo", "cash_flow", ("经营活动产生的现金流量净额", "net cash provided by operating activities"), ("NetCashProvidedByUsedInOperatingActivities",)),
    Account("cfi", "cash_flow", ("投资活动产生的现金流量净额", "net cash used in investing activities"), ("NetCashProvidedByUsedInInvestingActivities",)),
    Account("cff", "cash_flow", ("筹资活动产生的现金流量净额", "net cash provided by financing activities"), ("NetCashProvidedByUsedInFinancingActivities",)),
    Account("capex", "cash_flow", ("购建固定资产、无形资产和其他长期资产支付的现金", "purchases of property and equipment", "capital expenditures"), ("PaymentsToAcquirePropertyPlantAndEquipment",)),
    # further rows of the balance sheet
    Account("trading_assets", "balance", ("交易性金融资产", "financial assets at fair value through profit or loss"), ("TradingSecurities",)),
    Account("notes_receivable", "balance", ("应收票据", "notes receivable", "bills receivable"), ("NotesReceivableNet",)),
    Account("prepayments", "balance", ("预付款项", "预付账款", "prepayments", "prepaid expenses"), ("PrepaidExpenseCurrent",)),
    Account("other_receivables", "balance", ("其他应收款", "other receivables"), ("OtherReceivablesNetCurrent",)),
    Account("contract_assets", "balance", ("合同资产", "contract assets"), ("ContractWithCustomerAssetNetCurrent",)),
    Account("other_current_assets", "balance", ("其他流动资产", "other current assets"), ("OtherAssetsCurrent",)),
    Account("long_term_receivables", "balance", ("长期应收款", "long-term receivables"), ()),
    Account("equity_investments", "balance", ("长期股权投资", "investments in associates", "interests in associates", "equity method investments"), ("EquityMethodInvestments",)),
    Account("investment_property", "balance", ("投资性房地产", "investment property", "investment properties"), ()),
    Account("fixed_assets", "balance", ("固定资产", "property, plant and equipment", "property and equipment, net"), ("PropertyPlantAndEquipmentNet",)),
    Account("construction_in_progress", "balance", ("在建工程", "construction in progress"), ()),
    Account("right_of_use_assets", "balance", ("使用权资产", "right-of-use assets"), ("OperatingLeaseRightOfUseAsset",)),
    Account("intangible_assets", "balance", ("无形资产", "intangible assets", "intangible assets, net"), ("IntangibleAssetsNetExcludingGoodwill",)),
    Account("development_costs", "balance", ("开发支出", "development costs"), ()),
    Account("goodwill", "balance", ("商誉", "goodwill"), ("Goodwill",)),
    Account("deferred_charges", "balance", ("长期待摊费用", "long-term deferred expenses"), ()),
    Account("deferred_tax_assets", "balance", ("递延所得税资产", "deferred tax assets"), ("DeferredIncomeTaxAssetsNet",)),
    Account("other_noncurrent_assets", "balance", ("其他非流动资产", "other non-current assets", "other assets"), ("OtherAssetsNoncurrent",)),
    Account("total_noncurrent_assets", "balance", ("非流动资产合计", "total non-current assets"), ("AssetsNoncurrent",)),
    Account("notes_payable", "balance", ("应付票据", "notes payable", "bills payable"), ("NotesPayableCurrent",)),
    Account("advances_received", "balance", ("预收款项", "预收账款", "advances from customers", "receipts in advance"), ()),
    Account("contract_liabilities", "balance", ("合同负债", "contract liabilities"), ("ContractWithCustomerLiabilityCurrent",)),
    Account("deferred_revenue", "balance", ("递延收入", "递延收益", "deferred revenue", "deferred income"), ("DeferredRevenueCurrent",)),
    Account("employee_payable", "balance", ("应付职工薪酬", "employee benefits payable", "accrued compensation"), ("EmployeeRelatedLiabilitiesCurrent",)),
    Account("taxes_payable", "balance", ("应交税费", "taxes payable", "tax payable", "income tax payable"), ("TaxesPayableCurrent",)),
    Account("other_payables", "balance", ("其他应付款", "other payables", "other payables and accruals"), ()),
    Account("accrued_liabilities", "balance", ("预提费用", "accrued liabilities", "accrued expenses"), ("AccruedLiabilitiesCurrent",)),
    Account("current_portion_of_debt", "balance", ("一年内到期的非流动负债", "current portion of long-term debt"), ("LongTermDebtCurrent",)),
    Account("other_current_liabilities", "balance", ("其他流动负债", "other current liabilities"), ("OtherLiabilitiesCurrent",)),
    Account("bonds_payable", "balance", ("应付债券", "bonds payable"), ()),
    Account("lease_liabilities", "balance", ("租赁负债", "lease liabilities"), ("OperatingLeaseLiabilityNoncurrent",)),
    Account("long_term_payables", "balance", ("长期应付款", "long-term payables"), ()),
    Account("provisions", "balance", ("预计负债", "provisions"), ()),
    Account("deferred_tax_liabilities", "balance", ("递延所得税负债", "deferred tax liabilities"), ("DeferredIncomeTaxLiabilitiesNet",)),
    Account("other_noncurrent_liabilities", "balance", ("其他非流动负债", "other non-current liabilities"), ("OtherLiabilitiesNoncurrent",)),
    Account("total_noncurrent_liabilities", "balance", ("非流动负债合计", "total non-current liabilities"), ("LiabilitiesNoncurrent",)),
    Account("share_capital", "balance", ("实收资本", "股本", "share capital", "common stock"), ("CommonStockValue",)),
    Account("capital_reserve", "balance", ("资本公积", "capital reserve", "additional paid-in capital"), ("AdditionalPaidInCapital",)),
    Account("surplus_reserve", "balance", ("盈余公积", "surplus reserve", "statutory reserve"), ()),
    Account("retained_earnings", "balance", ("未分配利润", "retained earnings", "retained profits", "accumulated deficit"), ("RetainedEarningsAccumulatedDeficit",)),
    Account("equity_parent", "balance", ("归属于母公司所有者权益合计", "归属于母公司股东权益合计", "equity attributable to owners of the company", "total equity attributable to equity shareholders"), ()),
    Account("liabilities_and_equity", "balance", ("负债和所有者权益总计", "负债和股东权益总计", "total liabilities and equity", "total liabilities and stockholders equity"), ("LiabilitiesAndStockholdersEquity",)),
    Account("net_assets", "balance", ("资产净额", "资产净值", "净资产", "net assets"), ()),
    Account("net_current_assets", "balance", ("流动资产净额", "net current assets"), ()),
    # of the income statement
    Account("taxes_and_surcharges", "income", ("税金及附加", "营业税金及附加", "taxes and surcharges"), ()),
    Account("selling_expenses", "income", ("销售费用", "selling expenses", "selling and distribution expenses", "sales and marketing"), ("SellingAndMarketingExpense",)),
    Account("admin_expenses", "income", ("管理费用", "administrative expenses", "general and administrative"), ("GeneralAndAdministrativeExpense",)),
    Account("rd_expenses", "income", ("研发费用", "research and development", "research and development expenses"), ("ResearchAndDevelopmentExpense",)),
    Account("finance_costs", "income", ("财务费用", "融资成本", "finance costs", "finance expenses"), ()),
    Account("other_income", "income", ("其他收益", "other income", "other income and gains"), ("OtherNonoperatingIncomeExpense",)),
    Account("investment_income", "income", ("投资收益", "investment income"), ("InvestmentIncomeNet",)),
    Account("fair_value_gains", "income", ("公允价值变动收益", "fair value gains"), ()),
    Account("asset_impairment", "income", ("资产减值损失", "impairment losses", "impairment of assets"), ("AssetImpairmentCharges",)),
    Account("credit_impairment", "income", ("信用减值损失", "expected credit losses", "credit impairment losses"), ()),
    Account("nonoperating_income", "income", ("营业外收入", "non-operating income"), ("NonoperatingIncomeExpense",)),
    Account("nonoperating_expenses", "income", ("营业外支出", "non-operating expenses"), ()),
    Account("total_costs", "income", ("营业总成本", "total operating costs", "total costs and expenses", "costs and expenses"), ("CostsAndExpenses",)),
    Account("net_income_parent", "income", ("归属于母公司所有者的净利润", "归属于母公司股东的净利润", "profit attributable to owners of the company", "profit attributable to equity shareholders"), ()),
    Account("minority_income", "income", ("少数股东损益", "profit attributable to non-controlling interests"), ("NetIncomeLossAttributableToNoncontrollingInterest",)),
    Account("comprehensive_income", "income", ("综合收益总额", "total comprehensive income"), ("ComprehensiveIncomeNetOfTax",)),
    Account("eps_basic", "income", ("基本每股收益", "basic earnings per share"), ("EarningsPerShareBasic",)),
    Account("eps_diluted", "income", ("稀释每股收益", "diluted earnings per share"), ("EarningsPerShareDiluted",)),
    # of the cash flow statement
    Account("cash_from_customers", "cash_flow", ("销售商品、提供劳务收到的现金", "cash received from customers"), ("ProceedsFromCustomers",)),
    Account("cash_to_suppliers", "cash_flow", ("购买商品、接受劳务支付的现金", "payments to suppliers", "cash paid to suppliers"), ("PaymentsToSuppliers",)),
    Account("cash_to_employees", "cash_flow", ("支付给职工以及为职工支付的现金", "payments to employees"), ("PaymentsToEmployees",)),
    Account("taxes_paid", "cash_flow", ("支付的各项税费", "income tax paid", "income taxes paid"), ("IncomeTaxesPaidNet",)),
    Account("cash_from_borrowings", "cash_flow", ("取得借款收到的现金", "proceeds from borrowings"), ("ProceedsFromIssuanceOfDebt",)),
    Account("repayment_of_borrowings", "cash_flow", ("偿还债务支付的现金", "repayment of borrowings", "repayments of debt"), ("RepaymentsOfDebt",)),
    Account("dividends_paid", "cash_flow", ("分配股利、利润或偿付利息支付的现金", "dividends paid"), ("PaymentsOfDividends",)),
    Account("share_proceeds", "cash_flow", ("吸收投资收到的现金", "proceeds from issue of shares"), ("ProceedsFromIssuanceOfCommonStock",)),
    Account("investing_outflow", "cash_flow", ("投资活动现金流出小计",), ()),
    Account("fx_effect", "cash_flow", ("汇率变动对现金及现金等价物的影响", "effect of foreign exchange rate changes", "effect of exchange rate changes on cash"), ("EffectOfExchangeRateOnCashAndCashEquivalents",)),
    Account("net_change_in_cash", "cash_flow", ("现金及现金等价物净增加额", "net increase in cash and cash equivalents", "net decrease in cash and cash equivalents"), ("CashAndCashEquivalentsPeriodIncreaseDecrease",)),
    Account("cash_begin", "cash_flow", ("期初现金及现金等价物余额", "cash and cash equivalents at beginning of year", "cash and cash equivalents at the beginning of the year"), ()),
    Account("cash_end", "cash_flow", ("期末现金及现金等价物余额", "cash and cash equivalents at end of year", "cash and cash equivalents at the end of the year"), ()),
]
#: What a label must contain, what it must not, and its field; tried in order after exact names.
CONTAINS = [(("经营活动", "现金流量净额"), (), "cfo"), (("投资活动", "现金流量净额"), (), "cfi"), (("筹资活动", "现金流量净额"), (), "cff"), (("operating activities", "net cash"), ("adjust",), "cfo")]
#: Beginnings of labels and their field; tried last.
PREFIXES = [("归属于母公司股东的净利润", "net_income_parent"), ("归属于母公司所有者权益", "equity_parent"), ("购建固定资产", "capex"), ("purchases of property", "capex")]


def field_names() -> dict[str, str]:
    """Comparing form of each name → field; the first definition wins."""
    import re

    out: dict[str, str] = {}
    for a in ACCOUNTS:
        for n in a.names:
            out.setdefault(re.sub(r"[,，.。;；:：'\"*、\-—_/\s]", "", n.lower()), a.name)
    return out


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """A bounded table as one map literal: a hash lookup in the plan, no join."""
    literal = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(literal, key)


def label_candidates(label: Column) -> Column:
    """Spellings to try: as it is, its parts around a change between CJK and Latin script, without a note's tail."""
    tail = F.regexp_replace(label, r"[(（]?(附注|注释|note)[0-9一二三四五六七八九十、.\s]*[)）]?$", "")
    cjk = F.regexp_replace(tail, r"[^一-鿿、]", "")
    latin = F.trim(F.regexp_replace(tail, r"[一-鿿、，：（）]", " "))
    return F.array_distinct(F.filter(F.transform(F.array(label, tail, cjk, latin), strip_account_label), lambda x: x != ""))


def identify(rows: DataFrame, label: str = "label", tag: str | None = None) -> DataFrame:
    """Adds field and via (tag, name, contains, prefix) to each row; both NULL if nothing fits.

    Stages in order: XBRL tag, exact name over the candidate spellings in their order, contained words without banned ones,
    beginning. All tables are small parameters and live in the plan; rows are not shuffled.
    """
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    by_tag = _lookup(F.lower(F.regexp_replace(F.col(tag), "^.*[:_]", "")), {t.lower(): a.name for a in reversed(ACCOUNTS) for t in a.tags}) if tag else F.lit(None).cast("string")
    names = field_names()
    by_name = F.filter(F.transform(label_candidates(F.coalesce(F.col(label), F.lit(""))), lambda x: _lookup(x, names)), lambda x: x.isNotNull())
    contains, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for keys, bans, field in reversed(CONTAINS):
        hit = F.lit(True)
        for k in keys:
            hit = hit & F.contains(low, F.lit(k))
        for b in bans:
            hit = hit & ~F.contains(low, F.lit(b))
        contains = F.when(hit, field).otherwise(contains)
    for start, field in reversed(PREFIXES):
        prefix = F.when(F.startswith(low, F.lit(start)), field).otherwise(prefix)
    found = F.coalesce(
        F.when(by_tag.isNotNull(), F.struct(by_tag.alias("field"), F.lit("tag").alias("via"))),
        F.when(F.size(by_name) > 0, F.struct(F.get(by_name, F.lit(0)).alias("field"), F.lit("name").alias("via"))),
        F.when(contains.isNotNull(), F.struct(contains.alias("field"), F.lit("contains").alias("via"))),
        F.when(prefix.isNotNull(), F.struct(prefix.alias("field"), F.lit("prefix").alias("via"))),
    )
    return rows.withColumn("_m", found).withColumn("field", F.col("_m.field")).withColumn("via", F.col("_m.via")).drop("_m")


def owned_rows(mapped: DataFrame, stmt: str = "stmt") -> DataFrame:
    """Adds owned: whether a row's field belongs to its statement (P5)."""
    owner = _lookup(F.col("field"), {a.name: a.statement for a in ACCOUNTS})
    return mapped.withColumn("owned", F.col("field").isNotNull() & (F.coalesce(owner, F.lit("any")) .isin("any") | (owner == F.col(stmt))))


def mapping_rates(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mapped, rows, rate."""
    n = F.count_if(F.col("field").isNotNull())
    return mapped.groupBy(*keys).agg(n.alias("mapped"), F.count(F.lit(1)).alias("rows"), (n / F.count(F.lit(1))).alias("rate"))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in page and row order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(*keys, "_b.*").select(rows.columns)


def resolve_conflicts(rows: DataFrame, doc: str, field: str, page: str, value: str, seq: str, scale_fields: list[str]) -> DataFrame:
    """doc, field, chosen, basis, rejected: one value for each field of a document.

    Where values differ, the page with the largest scale field decides: the first of ``scale_fields`` that two or more pages of the
    document have. Without such a page the first value stands. What was not chosen is kept.
    """
    scale = rows.where(F.col(field).isin(scale_fields)).groupBy(doc, page, field).agg(F.max(F.abs(value)).alias("_s"))
    rank = F.lit(None).cast("int")
    for k, f in enumerate(scale_fields):
        rank = F.when(F.col(field) == f, k).otherwise(rank)
    used = scale.groupBy(doc, field).agg(F.count(F.lit(1)).alias("_pages")).where("_pages >= 2").groupBy(doc).agg(F.min_by(field, rank).alias("_by"))
    pages = scale.join(used, doc).where(F.col(field) == F.col("_by")).select(doc, page, "_s")
    known = rows.where(F.col(value).isNotNull()).join(pages, [doc, page], "left")
    values = F.collect_set(value)
    agg = known.groupBy(doc, field).agg(
        values.alias("_all"), F.max_by(value, F.struct(F.coalesce("_s", F.lit(-1.0)), -F.col(seq))).alias("_big"), F.min_by(value, seq).alias("_first"), F.max("_s").alias("_top"),
    )
    chosen = F.when((F.size("_all") > 1) & F.col("_top").isNotNull(), F.col("_big")).otherwise(F.col("_first"))
    basis = F.when(F.size("_all") == 1, "only value").when(F.col("_top").isNotNull(), "page of largest scale").otherwise("first seen")
    return agg.select(doc, field, chosen.alias("chosen"), basis.alias("basis"), F.array_sort(F.filter("_all", lambda x: x != chosen)).alias("rejected"))


def page_scores(pages: DataFrame, markers: dict[str, list[list[str]]], text: str = "text") -> DataFrame:
    """A score column for each kind: 100 for each group of keywords hit and 1 for each keyword, from two groups on."""
    low = free_name(pages, "_lower")

    def score(groups: list[list[str]]) -> Column:
        reached = lambda h: F.size(F.filter(h, lambda n: n > 0))
        return once(word_hits(F.col(low), groups), lambda h: F.when(reached(h) >= 2, 100 * reached(h) + F.aggregate(h, F.lit(0), lambda a, n: a + n)).otherwise(0))

    return pages.withColumn(low, F.lower(F.coalesce(F.col(text), F.lit("")))).withColumns({kind: score(groups) for kind, groups in markers.items()}).drop(low)


#: Groups of words that mark the pages of each statement, in Chinese.
PAGE_MARKERS = {
    "balance": [
        ["资产总计", "資產總額", "负债合计", "負債總額", "所有者权益合计", "權益總額", "负债和所有者权益总计", "资产净额", "資產淨額"],
        ["流动资产合计", "非流动资产合计", "流动负债合计", "非流动负债合计", "流動資產淨額", "總資產減流動負債"],
        ["货币资金", "应收账款", "存货", "固定资产", "应付账款", "短期借款", "現金及銀行結餘", "貿易應收款項", "存貨", "物業、廠房及設備"],
    ],
    "income": [
        ["营业收入", "营业总收入", "产品销售收入", "营业收入合计", "营业额", "營業額", "收入", "收益"],
        ["营业利润", "利润总额", "净利润", "除税前溢利", "年度溢利", "本年度溢利", "淨利潤", "利潤總額", "年內溢利", "除稅前溢利"],
        ["营业成本", "税金及附加", "销售费用", "管理费用", "财务费用", "銷售成本", "行政開支", "融資成本", "銷售及分銷成本"],
    ],
    "cash_flow": [
        ["经营活动产生的现金流量净额", "经营活动现金流量净额", "经营活动所用现金净额", "經營活動所得現金淨額", "經營活動所用現金淨額", "經營活動產生的現金流量淨額"],
        ["投资活动产生的现金流量净额", "投资活动现金流量净额", "投资活动所用的现金净额", "投資活動所得現金淨額", "投資活動所用現金淨額", "投資活動產生的現金流量淨額"],
        ["筹资活动产生的现金流量净额", "筹资活动现金流量净额", "融资活动所用的现金净额", "融資活動所得現金淨額", "融資活動所用現金淨額", "籌資活動產生的現金流量淨額"],
        ["期初现金及现金等价物余额", "年初现金及现金等价物", "年初的现金及现金等价物", "於年初之現金及現金等價物", "年初之現金及現金等價物"],
        ["期末现金及现金等价物余额", "年末现金及现金等价物", "年末的现金及现金等价物", "於年末之現金及現金等價物", "年末之現金及現金等價物"],
    ],
}
#: The same in English.
PAGE_MARKERS_EN = {
    "balance": [
        ["total assets", "total liabilities", "total equity", "net assets", "total liabilities and equity"],
        ["current assets", "non-current assets", "current liabilities", "non-current liabilities", "net current assets", "total assets less current liabilities", "total equity attributable to equity shareholders"],
        ["cash and cash equivalents", "cash and bank balances", "trade receivables", "inventories", "property, plant and equipment", "loans and advances", "insurance contract liabilities", "insurance contract assets", "reinsurance contract assets", "financial investments", "notes and bonds payable", "share capital", "retained earnings"],
    ],
    "income": [
        ["operating income", "insurance revenue", "total income", "revenue", "total revenue", "turnover", "interest income", "investment income"],
        ["profit before tax", "profit before taxation", "net profit", "profit for the year", "profit for the period", "loss for the year", "operating profit", "profit from operations"],
        ["insurance service expenses", "operating expenses", "administrative expenses", "cost of sales", "finance costs", "income tax"],
    ],
    "cash_flow": [
        ["net cash flows generated from operating activities", "net cash flows used in operating activities", "net cash generated from operating activities", "net cash used in operating activities", "net cash flows from operating activities", "net cash provided by operating activities"],
        ["net cash flows used in investing activities", "net cash flows generated from investing activities", "net cash used in investing activities", "net cash flows from investing activities", "net cash provided by investing activities"],
        ["net cash flows generated from financing activities", "net cash flows used in financing activities", "net cash used in financing activities", "net cash flows from financing activities", "net cash provided by financing activities"],
        ["cash and cash equivalents at the beginning of the year", "cash and cash equivalents at beginning of year", "cash and cash equivalents at the beginning of the period", "cash and cash equivalents at beginning of period"],
        ["cash and cash equivalents at the end of the year", "cash and cash equivalents at end of year", "cash and cash equivalents at the end of the period", "cash and cash equivalents at end of period"],
    ],
}


def statement_scores(pages: DataFrame, text: str = "text") -> DataFrame:
    """balance, income and cash_flow scores of each page: the greater of the two languages' (G26, K7, K8)."""
    kinds = list(PAGE_MARKERS)
    chinese = page_scores(pages, {f"_zh_{k}": g for k, g in PAGE_MARKERS.items()}, text)
    both = page_scores(chinese, {f"_en_{k}": g for k, g in PAGE_MARKERS_EN.items()}, text)
    return both.withColumns({k: F.greatest(f"_zh_{k}", f"_en_{k}") for k in kinds}).drop(*(f"_{x}_{k}" for x in ("zh", "en") for k in kinds))


def accounts(spark: SparkSession) -> DataFrame:
    """The dimension of fields: field, statement, names, tags (K2, K3)."""
    return spark.createDataFrame([(a.name, a.statement, list(a.names), list(a.tags)) for a in ACCOUNTS], "field string, statement string, names array<string>, tags array<string>")
