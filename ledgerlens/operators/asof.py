"""As-of joins: the last observation at or before a date, within a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], lookback: Column | None = None, tie: str | None = None, slice_of: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its keys at or before left_at.

    Rows of both sides are merged and the last right row is carried forward: one shuffle and one sort
    on the keys, whatever the number of right rows before each left one, where a range join
    would pair them all. ``lookback`` is how far left_at may lie after right_at; beyond it the columns
    are NULL. On equal times a right row counts, the greatest ``tie`` last. Left rows are kept, repeated
    ones too.

    ``slice_of`` cuts time into slices that grow with it (a day of a timestamp): a key with very many rows is then
    worked on by many tasks, each begun with the last right row of the slices before.
    """
    l = left.select(*left.columns, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"))
    found = F.struct(F.col(right_at).alias("_at"), *columns)
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("_tie"), found.alias("_found"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_slice", F.lit(0) if slice_of is None else slice_of(F.col("_at")))
    w = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    if slice_of is not None:
        slices = both.groupBy(*keys, "_slice").agg(F.max_by("_found", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_own"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        brought = slices.withColumn("_brought", F.last("_own", ignorenulls=True).over(before)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), "_brought")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        carried = carried.join(brought, [*same, F.col("_slice").eqNullSafe(F.col("_s"))], "left").withColumn("_last", F.coalesce("_last", "_brought"))
    fits = F.lit(True) if lookback is None else F.col("_last._at") >= F.col("_at") - lookback
    return carried.select(*left.columns, *(F.when(fits, F.col("_last")[c]).alias(c) for c in columns), F.when(fits, F.col("_last._at")).alias(f"{right_at}_found"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the greatest in ``order``; an aggregation with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(*keys, "_b.*").select(df.columns)


def by_source_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in falling priority, for each key only those rows of the first source that has any."""
    every = None
    for k, f in enumerate(frames):
        f = f.withColumn("_prio", F.lit(k))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    best = every.groupBy(*keys).agg(F.min("_prio").alias("_best"))
    return every.join(best, keys).where("_prio = _best").drop("_prio", "_best")


def runs(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive integers: keys, first, last, n (W9, W10). Repeats count once."""
    d = df.select(*keys, F.col(at).cast("long").alias("_at")).where("_at is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("_at")
    grouped = d.withColumn("_run", F.col("_at") - F.row_number().over(w)).groupBy(*keys, "_run")
    return grouped.agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def expand_from_anchor(scores: DataFrame, keys: list[str], at: str, score: str, ok: Column) -> DataFrame:
    """The run of rows around each key's first greatest score over which ``ok`` holds without a break."""
    anchors = scores.groupBy(*keys).agg(F.max(F.struct(F.col(score), (-F.col(at)).alias("_a"))).alias("_m"))
    placed = scores.join(anchors.select(*keys, (-F.col("_m._a")).alias("_anchor")), keys).withColumn("_ok", ok | (F.col(at) == F.col("_anchor")))
    up = Window.partitionBy(*keys, F.col(at) >= F.col("_anchor")).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, F.col(at) <= F.col("_anchor")).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    kept = placed.withColumn("_up", F.bool_and("_ok").over(up)).withColumn("_down", F.bool_and("_ok").over(down))
    return kept.where(F.when(F.col(at) >= F.col("_anchor"), F.col("_up")).otherwise(F.col("_down"))).select(scores.columns)
