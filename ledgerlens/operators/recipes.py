"""Compositions: ask, advise, screen, plan the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ASSUMPTION_KINDS, ordered_case
from .peers import distribution, percentile_rank
from .retrieval import bm25, unknown_citations

#: Accounting terms in two languages, for query expansion.
GLOSSARY = {
    "营业收入": ["revenue", "net sales"], "营业成本": ["cost of revenue"], "毛利": ["gross profit"], "毛利率": ["gross margin"], "营业利润": ["operating income"], "净利润": ["net income"], "利润总额": ["pretax income"],
    "所得税": ["income tax"], "折旧": ["depreciation"], "摊销": ["amortization"], "利息费用": ["interest expense"], "货币资金": ["cash"], "应收账款": ["accounts receivable"], "存货": ["inventory"],
    "固定资产": ["property and equipment"], "无形资产": ["intangible assets"], "商誉": ["goodwill"], "应付账款": ["accounts payable"], "短期借款": ["short-term debt"], "长期借款": ["long-term debt"],
    "总资产": ["total assets"], "总负债": ["total liabilities"], "所有者权益": ["shareholders equity"], "少数股东权益": ["noncontrolling interest"], "现金流": ["cash flow"], "经营活动现金流": ["operating cash flow"],
    "资本开支": ["capital expenditures"], "营运资金": ["working capital"], "分红": ["dividends"], "股权激励": ["stock-based compensation"], "关联交易": ["related party transactions"], "客户集中度": ["customer concentration"],
    "供应商": ["supplier"], "员工": ["employees"], "诉讼": ["litigation"], "风险因素": ["risk factors"], "竞争": ["competition"], "市场份额": ["market share"], "研发费用": ["research and development"], "销售费用": ["selling expenses"],
    "管理费用": ["general and administrative"], "递延收入": ["deferred revenue"], "合同负债": ["contract liabilities"], "租赁负债": ["lease liabilities"], "减值": ["impairment"], "汇率": ["exchange rate"], "担保": ["guarantee"], "质押": ["pledge"],
    "营业总收入": ["total revenue"], "主营业务收入": ["principal business revenue"], "其他业务收入": ["other operating revenue"], "营业外收入": ["non-operating income"], "投资收益": ["investment income"], "公允价值": ["fair value"],
    "财务费用": ["finance costs"], "税金及附加": ["taxes and surcharges"], "每股收益": ["earnings per share"], "净资产收益率": ["return on equity"], "资产负债率": ["debt to assets"], "流动比率": ["current ratio"], "速动比率": ["quick ratio"],
    "预付款项": ["prepayments"], "其他应收款": ["other receivables"], "合同资产": ["contract assets"], "在建工程": ["construction in progress"], "投资性房地产": ["investment property"], "使用权资产": ["right-of-use assets"],
    "长期股权投资": ["equity method investments"], "递延所得税": ["deferred tax"], "应付职工薪酬": ["employee benefits payable"], "应交税费": ["taxes payable"], "预计负债": ["provisions"], "应付债券": ["bonds payable"],
    "股本": ["share capital"], "资本公积": ["capital reserve"], "盈余公积": ["surplus reserve"], "未分配利润": ["retained earnings"], "净利率": ["net margin"], "营业利润率": ["operating margin"], "市盈率": ["price to earnings"], "市净率": ["price to book"],
    "企业价值": ["enterprise value"], "市值": ["market capitalization"], "折现率": ["discount rate"], "永续增长": ["terminal growth"], "自由现金流": ["free cash flow"], "净债务": ["net debt"], "可比公司": ["comparable companies"],
    "并购": ["mergers and acquisitions"], "首次公开发行": ["initial public offering"], "募集资金": ["proceeds"], "控股股东": ["controlling shareholder"], "实际控制人": ["actual controller"], "子公司": ["subsidiary"], "合营企业": ["joint venture"],
    "审计意见": ["audit opinion"], "内部控制": ["internal control"], "会计政策": ["accounting policies"], "会计估计": ["accounting estimates"], "持续经营": ["going concern"], "期后事项": ["subsequent events"], "或有负债": ["contingent liabilities"],
    "产能": ["capacity"], "产量": ["output"], "销量": ["sales volume"], "订单": ["orders"], "毛利润": ["gross profit"], "专利": ["patents"], "商标": ["trademarks"], "抵押": ["mortgage"], "补贴": ["subsidies"], "关税": ["tariffs"],
}
#: Industries with words that speak for them and what to watch.
INDUSTRIES = [
    ("software", ["saas", "software", "软件", "subscription"], "recurring and licence revenue differ"),
    ("internet retail", ["e-commerce", "电商", "marketplace"], "gross and net revenue differ"),
    ("medical devices", ["medical", "医疗器械", "implant"], "registration stages differ"),
    ("pharmaceuticals", ["drug", "药", "clinical"], "pipeline value outweighs earnings"),
    ("semiconductors", ["semiconductor", "芯片", "wafer"], "cycle position differs"),
    ("restaurants", ["restaurant", "餐饮", "franchise"], "owned and franchised shops differ"),
    ("logistics", ["logistics", "物流", "freight"], "asset-heavy and asset-light differ"),
    ("education", ["education", "教育", "tuition"], "prepaid revenue"),
    ("marketing services", ["advertising", "营销", "media buying"], "media costs passed through"),
    ("consumer electronics", ["wearable", "electronics", "消费电子"], "product cycles"),
    ("new energy", ["battery", "新能源", "photovoltaic"], "subsidies"),
    ("industrial machinery", ["machinery", "装备", "automation"], "order backlog"),
]
#: What evidence supports a kind of assumption, strongest first.
EVIDENCE = [
    ("growth", 1, "signed orders and backlog"), ("growth", 2, "industry volume data"), ("growth", 3, "peer growth"), ("margin", 1, "unit costs by product"), ("margin", 2, "peer margins"),
    ("wacc", 1, "yields and betas at the date"), ("wacc", 2, "published premiums"), ("terminal_growth", 1, "long-term nominal growth"), ("terminal_growth", 2, "long-term inflation"),
    ("capex", 1, "asset register and plans"), ("capex", 2, "past spending"), ("nwc", 1, "terms with customers and suppliers"), ("nwc", 2, "past ratios"), ("multiple", 1, "traded peers at the date"), ("tax", 1, "tax returns"),
]


def ask(chunks: DataFrame, question: str, key: str = "chunk_id", top: int = 6) -> DataFrame:
    """The passages that answer a question, with the text, best first (H1)."""
    ranked = bm25(chunks, question, key, top=top, terms=GLOSSARY)
    return ranked.join(chunks, key).orderBy(F.desc("score"), key)


def verify_answers(answers: DataFrame, retrieved: list[str]) -> DataFrame:
    """Answers with citations that retrieval did not give, and whether all are sound."""
    found = unknown_citations(answers, F.array(*map(F.lit, retrieved)) if retrieved else F.array().cast("array<string>"))
    return found.withColumn("sound", F.size("unknown") == 0)


def advise(assumptions: DataFrame, peer_values: DataFrame, key: str = "name", metric: str = "metric", value: str = "value") -> DataFrame:
    """Assumptions beside their peers: distribution, share of peers at or below, kind and the evidence it wants."""
    d = distribution(peer_values, [metric], value)
    r = percentile_rank(assumptions, peer_values, [metric], value, value, key)
    wanted = F.lit(None).cast("string")
    for kind, level, what in EVIDENCE:
        if level == 1:
            wanted = F.when(F.col("kind") == kind, what).otherwise(wanted)
    out = assumptions.join(d, metric, "left").join(r.select(key, "share_at_or_below"), key, "left")
    return out.withColumn("kind", ordered_case(F.col(key), ASSUMPTION_KINDS)).withColumn("evidence_wanted", wanted)


def propose_industries(texts: DataFrame, key: str, text: str = "text", most: int = 4) -> DataFrame:
    """key, industry, hits, caveat: the industries whose words a description has most of."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = [F.struct(F.lit(n).alias("industry"), F.lit(i).alias("place"), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)).alias("evidence"), F.lit(c).alias("caveat")) for i, (n, words, c) in enumerate(INDUSTRIES)]
    found = texts.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*").where(F.size("evidence") > 0)
    w = Window.partitionBy(key).orderBy(F.desc(F.size("evidence")), "place")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("place")


def screening_queries(criteria: DataFrame, blocked: list[str]) -> DataFrame:
    """Adds query: industry, region and listing as public search words; one that names a blocked company raises."""
    q = F.concat_ws(" ", "industry", "geography", F.when(F.col("listed_only"), F.lit("上市公司")), F.lit("可比公司"))
    hit = F.lit(False)
    for name in blocked:
        if len(name.strip()) >= 2:
            hit = hit | F.contains(F.lower(q), F.lit(name.strip().lower()))
    return criteria.withColumn("query", F.when(hit, F.raise_error(F.concat(F.lit("query names a blocked company: "), q)).cast("string")).otherwise(q))


def question_plan(questions: DataFrame, answers: DataFrame, impact: list[str], key: str = "key") -> DataFrame:
    """Open questions, those of most impact first, unlisted ones last in their order."""
    rank = F.lit(len(impact))
    for k, name in reversed(list(enumerate(impact))):
        rank = F.when(F.col(key) == name, k).otherwise(rank)
    return questions.join(answers.select(key).distinct(), key, "left_anti").withColumn("impact", rank).orderBy("impact", "seq")


def propose_field(utterance: Column, aliases: dict[str, str]) -> Column:
    """struct<value, is_percent, candidates>: the first number said and the fields its words may mean.

    No candidate or several leave the choice to the user.
    """
    number = F.regexp_extract(utterance, r"(-?[0-9][0-9,]*\.?[0-9]*)", 1)
    hits = F.array_distinct(F.filter(F.array(*(F.when(F.contains(F.lower(utterance), F.lit(w)), F.lit(f)) for w, f in aliases.items())), lambda x: x.isNotNull()))
    return F.struct(F.replace(number, F.lit(","), F.lit("")).try_cast("double").alias("value"), utterance.rlike("%|％|百分之").alias("is_percent"), hits.alias("candidates"))


def evidence_library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVIDENCE, "kind string, level int, what string")


def last_per_model(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last run of each model (A43, A44, S5); with rounds, judge by the worst: `worst_round`."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b")).select(*keys, "_b.*").select(runs.columns)


def worst_round(rounds: DataFrame, keys: list[str], passed: str = "passed", total: str = "total") -> DataFrame:
    """Models by their worst round, best first."""
    return rounds.groupBy(*keys).agg(F.min(passed).alias("passed"), F.max(total).alias("total")).orderBy(F.desc("passed"), *keys)
