"""Policy decisions on outgoing requests, and summaries of the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public hosts that may be asked, and those that need a consent for each purpose.
ALLOWED_HOSTS = ["data.sec.gov", "www.sec.gov", "efts.sec.gov"]
CONSENT_HOSTS = ["push2his.eastmoney.com", "datacenter.eastmoney.com", "hq.sinajs.cn", "qt.gtimg.cn"]


def decide(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """Adds decision: ALLOW, ALLOW-CONSENT, CONSENT-REQUIRED or BLOCK (P11, P12). Consents: host, purpose."""
    given = consents.select("host", "purpose", F.lit(True).alias("_given")).distinct()
    known = requests.join(given, ["host", "purpose"], "left")
    loopback = F.col("host").rlike(r"^(localhost|127\.[0-9.]+|\[?::1\]?)(:[0-9]+)?$")
    decision = (
        F.when(loopback | F.col("host").isin(ALLOWED_HOSTS), "ALLOW")
        .when(F.col("host").isin(CONSENT_HOSTS) & F.col("_given"), "ALLOW-CONSENT")
        .when(F.col("host").isin(CONSENT_HOSTS), "CONSENT-REQUIRED").otherwise("BLOCK")
    )
    return known.withColumn("decision", decision).drop("_given")


def flatten_parameters(requests: DataFrame, key: str, params: str = "params") -> DataFrame:
    """key, name, value of each parameter; items of a JSON list are numbered."""
    flat = requests.select(key, F.explode(params).alias("name", "raw"))
    items = F.when(F.startswith(F.col("raw"), F.lit("[")), F.from_json("raw", "array<string>"))
    single = F.array(F.struct(F.col("name").alias("name"), F.col("raw").alias("value")))
    many = F.transform(items, lambda x, i: F.struct(F.concat(F.col("name"), F.lit("["), i.cast("string"), F.lit("]")).alias("name"), x.alias("value")))
    return flat.select(key, F.explode(F.coalesce(many, single)).alias("p")).select(key, "p.*")


def summary(events: DataFrame, decision: Column, host: str) -> DataFrame:
    """Counts by outcome, three ways (A40, A41, Q9): allowed, allowed by consent, blocked; and the hosts seen."""
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(decision == "ALLOW").alias("allowed"), F.count_if(decision == "ALLOW-CONSENT").alias("by_consent"),
        F.count_if(~decision.isin("ALLOW", "ALLOW-CONSENT")).alias("blocked"), F.array_join(F.array_sort(F.collect_set(host)), ",").alias("hosts"),
    )


def tail(events: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(F.desc(order)).limit(n)
