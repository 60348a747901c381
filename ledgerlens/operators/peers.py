"""Peer distributions, percentile ranks, multiples and the rules on when they may be used."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_PEERS = 3


def distribution(peers: DataFrame, keys: list[str], value: str, positive_only: bool = False) -> DataFrame:
    """keys, n, min, p25, median, p75, max, mean, enough.

    NULL, NaN and infinite values don't count, nor non-positive ones if asked. Quantiles interpolate linearly.
    """
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if positive_only:
        usable = usable & (v > 0)
    rows = peers.where(usable).select(*keys, v.alias("_v"))
    figures = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"))
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    same = reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    both = quantiles(rows, keys, "_v", shares).alias("a").join(figures.alias("b"), same)
    return both.select(*(F.col(f"a.{k}") for k in keys), "n", "min", *shares, "max", "mean", (F.col("n") >= MIN_PEERS).alias("enough"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = 256) -> DataFrame:
    """keys and a column for each share: the value at share * (n - 1) in order, between two of them in proportion.

    Exact, however few keys there are: each key's values are cut into about ``parts`` ranges at approximate quantiles and counted by range and value; only the
    ranges that hold a wanted place are ordered, each by itself. Equal values are one row by then. NULL values don't count.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    cuts = v.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 4 * parts).alias("_cuts"))
    placed = v.alias("a").join(cuts.alias("b"), same("a", "b")).select(*(F.col(f"a.{k}") for k in keys), "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    counted = placed.groupBy(*keys, "_part", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    sums = counted.groupBy(*keys, "_part").agg(F.sum("_c").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_sum").over(w))
    place = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    holds = [(F.col("_before") <= f(p)) & (f(p) < F.col("_before") + F.col("_sum")) for p in place.values() for f in (F.floor, F.ceil)]
    wanted = sums.where(reduce(or_, holds))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    kept = counted.alias("a").join(wanted.alias("b"), same("a", "b") & (F.col("a._part") == F.col("b._part"))).select(*(F.col(f"a.{k}") for k in keys), "a._part", "_v", "_c", "_before", "_n")
    ranked = kept.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_c"))
    at = lambda p: F.max(F.when((F.col("_from") <= p) & (p < F.col("_to")), F.col("_v")))
    ends = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *(at(f(p)).alias(f"_{name}_{e}") for name, p in place.items() for e, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda name, p: (F.ceil(p) - p) * F.col(f"_{name}_lo") + (p - F.floor(p)) * F.col(f"_{name}_hi")
    return ends.select(*keys, *(F.when(F.floor(p) == F.ceil(p), F.col(f"_{name}_lo")).otherwise(between(name, p)).alias(name) for name, p in place.items()))


def percentile_rank(targets: DataFrame, peers: DataFrame, keys: list[str], target: str, value: str, target_id: str, parts: int = 64) -> DataFrame:
    """Share of peers at or below each target, NULL without peers.

    Peers are counted, not compared target by target. Each key's values are cut into about ``parts`` ranges at approximate
    quantiles; ranges are summed, and only within a range are rows sorted, so a key that holds most rows is
    spread over tasks. The counts are exact: equal values share a range.
    """
    t = targets.select(*keys, F.col(target_id).alias("_id"), F.col(target).cast("double").alias("_v"), F.lit(0).alias("_peer"))
    p = peers.where(F.col(value).isNotNull()).select(*keys, F.lit(None).cast(t.schema["_id"].dataType).alias("_id"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_peer"))
    cuts = p.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 1000).alias("_cuts"))
    placed = t.unionByName(p).join(cuts, keys, "left").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))).drop("_cuts")
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_peer").alias("_sum"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_sum").over(w)).drop("_sum")
    inside = F.sum("_peer").over(Window.partitionBy(*keys, "_part").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("_inside", inside).where("_peer = 0").join(sums, [*keys, "_part"])
    share = F.when(F.col("_n") > 0, (F.col("_before") + F.col("_inside")) / F.col("_n"))
    return ranked.select(*keys, F.col("_id").alias(target_id), share.alias("share_at_or_below"), F.col("_n").alias("n_peers"))


def multiples(companies: DataFrame, price: str, shares: str, net_debt: str, denominators: dict[str, str]) -> DataFrame:
    """Adds market_cap, enterprise_value, a column for each multiple, and gaps.

    ``denominators``: multiple → column; names that start with ev_ divide the enterprise value, others the market
    value. A missing or non-positive denominator gives NULL and a reason, and the row stays.
    """
    cap = F.col(price) * F.col(shares)
    out = companies.withColumn("market_cap", cap).withColumn("enterprise_value", F.col("market_cap") + F.col(net_debt))
    gaps = [F.when(F.col(price).isNull(), F.lit("no price")), F.when(F.col(shares).isNull(), F.lit("no share count"))]
    for name, d in denominators.items():
        top = F.col("enterprise_value" if name.startswith("ev_") else "market_cap")
        out = out.withColumn(name, F.when(F.col(d) > 0, top / F.col(d)))
        gaps.append(F.when(F.col(d).isNull(), F.lit(f"{name}: no {d}")).when(F.col(d) <= 0, F.lit(f"{name}: {d} not positive")))
    if any(n.startswith("ev_") for n in denominators):
        gaps.append(F.when(F.col(net_debt).isNull(), F.lit("no net debt")))
    return out.withColumn("gaps", F.filter(F.array(*gaps), lambda x: x.isNotNull()))


def percent_fields(rows: DataFrame, fields: str, scale_free: list[str]) -> DataFrame:
    """A map column of percent figures as shares of one; ``scale_free`` keys (multiples, amounts) stay."""
    return rows.withColumn(fields, F.transform_values(fields, lambda k, v: F.when(k.isin(scale_free), v).otherwise(v / 100)))


def market_of_currency(currency: Column) -> Column:
    return F.when(currency == "USD", "us").when(currency == "HKD", "hk").when(currency == "CNY", "cn")


def comparison_scope(target_market: Column, target_currency: Column, peer_market: Column, peer_currency: Column) -> Column:
    """struct<ratios, scale, multiples>: what may be compared across markets.

    Ratios always; absolute scale in one currency; multiples only in one market and currency.
    """
    t, p = F.coalesce(target_market, market_of_currency(target_currency)), F.coalesce(peer_market, market_of_currency(peer_currency))
    same_money = F.coalesce(target_currency == peer_currency, F.lit(False))
    return F.struct(F.lit(True).alias("ratios"), same_money.alias("scale"), (same_money & F.coalesce(t == p, F.lit(False))).alias("multiples"))


def screen(rows: DataFrame, value: str, low: float | None, high: float | None, order: str, limit: int) -> DataFrame:
    """Rows in an inclusive range, the first ``limit`` in a stated order."""
    if low is not None:
        rows = rows.where(F.col(value) >= low)
    if high is not None:
        rows = rows.where(F.col(value) <= high)
    return rows.orderBy(order).limit(limit)


def readiness(selection: DataFrame) -> DataFrame:
    """Adds problems: what a comparison still lacks (V13): columns n_peers, as_of, metric, market, currency."""
    checks = [
        F.when(F.coalesce(F.col("n_peers"), F.lit(0)) < MIN_PEERS, F.lit(f"fewer than {MIN_PEERS} peers")),
        F.when(F.col("as_of").isNull(), F.lit("no date")), F.when(F.col("metric").isNull(), F.lit("no metric")),
        F.when(F.col("market").isNull(), F.lit("no market")), F.when(F.col("currency").isNull(), F.lit("no currency")),
    ]
    return selection.withColumn("problems", F.filter(F.array(*checks), lambda x: x.isNotNull()))
