"""Results of several methods in one schema, and the lines of reports and question lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import valuation as v

RESULT = ["entity", "method", "low", "mid", "high", "unit", "is_valuation", "assumptions", "trace", "notes"]


def assumption(name: str, value: Column, unit: str = "", source: Column | None = None) -> Column:
    """struct<name, value, unit, source, confidence>: without a source the confidence is low, without a value missing."""
    given = F.lit(None).cast("string") if source is None else source
    confidence = F.when(value.isNull(), "missing").when(given.isNull(), "low").otherwise("medium")
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), given.alias("source"), confidence.alias("confidence"))


def result(df: DataFrame, method: str, low: str, mid: str, high: str, inputs: list[str], steps: list[str], notes: Column, unit: str = "", is_valuation: bool = True) -> DataFrame:
    """Rows of RESULT from columns of a model: inputs become assumptions, steps the trace (1.3, R17)."""
    trace = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("label"), F.col(s).cast("string").alias("expr")) for i, s in enumerate(steps)))
    source = lambda n: F.col(f"{n}_source") if f"{n}_source" in df.columns else None
    return df.select(
        F.col("entity"), F.lit(method).alias("method"), F.col(low).cast("double").alias("low"), F.col(mid).cast("double").alias("mid"), F.col(high).cast("double").alias("high"), F.lit(unit).alias("unit"),
        F.lit(is_valuation).alias("is_valuation"), F.array(*(assumption(n, F.col(n), unit, source(n)) for n in inputs)).alias("assumptions"), trace.alias("trace"), F.filter(F.array(notes), lambda x: x.isNotNull()).alias("notes"),
    )


def appraise(plans: DataFrame, multiples: DataFrame | None = None, rounds: DataFrame | None = None, rates: tuple[float, ...] = (-0.01, 0.0, 0.01), growths: tuple[float, ...] = (-0.005, 0.0, 0.005)) -> DataFrame:
    """Every method that an entity has inputs for, in one table (H2, H3, H4).

    Discounted flows with the extremes of a grid around the base as range, multiples, venture method. A method without
    a value keeps its row, with the reason in notes.
    """
    base = v.dcf(plans)
    cells = plans.withColumn("_dw", F.explode(F.array(*map(F.lit, rates)))).withColumn("_dg", F.explode(F.array(*map(F.lit, growths))))
    cells = cells.withColumn("wacc", F.col("wacc") + F.col("_dw")).withColumn("growth", F.col("growth") + F.col("_dg"))
    span = v.dcf(cells).groupBy("entity").agg(F.min("equity_value").alias("_low"), F.max("equity_value").alias("_high"))
    share = F.when(F.col("terminal_share") > 0.75, F.lit("terminal value is over 75 % of the whole"))
    out = result(base.join(span, "entity", "left"), "dcf", "_low", "equity_value", "_high", ["wacc", "growth", "net_debt"], ["pv_flows", "pv_terminal", "enterprise_value", "equity_value"], F.coalesce("gap", share))
    if multiples is not None:
        out = out.unionByName(result(v.by_multiples(multiples), "multiples", "low", "mid", "high", ["metric", "multiple_mid", "net_debt"], ["low", "mid", "high"], F.col("gap")))
    if rounds is not None:
        out = out.unionByName(result(v.vc_method(rounds), "vc", "pre_money", "pre_money", "pre_money", ["exit_value", "investment", "years"], ["multiple", "ownership_today", "post_money"], F.when(F.col("inconsistent"), F.lit("multiple and rate of return disagree"))))
    return out


def low_confidence(results: DataFrame) -> DataFrame:
    """entity, weak, gaps: names of assumptions with low confidence and without value, each once."""
    a = results.select("entity", F.explode("assumptions").alias("a"))
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col("a.confidence") == c, F.col("a.name"))))
    return a.groupBy("entity").agg(names("low").alias("weak"), names("missing").alias("gaps"))


def report_lines(results: DataFrame) -> DataFrame:
    """entity, line: one line of text for each result, reverse methods last."""
    figure = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit("—"))
    line = F.concat_ws("  ", "method", F.concat(figure("low"), F.lit(" – "), figure("high")), F.concat(F.lit("mid "), figure("mid")), F.array_join("notes", "; "))
    return results.select("entity", line.alias("line"), (~F.col("is_valuation")).alias("_last"), "method").orderBy("entity", "_last", "method").select("entity", "line")


def football_json(band_rows: DataFrame) -> DataFrame:
    """entity, json: the bands of an entity as one JSON object."""
    bands = F.array_sort(F.collect_list(F.struct("method", "band_low", "band_mid", "band_high", "span", "note")))
    return band_rows.groupBy("entity").agg(F.to_json(F.struct(bands.alias("bands"))).alias("json"))


def template_lines(questions: DataFrame) -> DataFrame:
    """seq, line: a question list to fill in, a heading where the group changes (B7). Columns: seq, group, key, hint."""
    from pyspark.sql.window import Window

    before = F.lag("group").over(Window.partitionBy(F.lit(0)).orderBy("seq"))
    head = F.when(before.isNull() | (before != F.col("group")), F.concat(F.lit("["), F.col("group"), F.lit("]")))
    body = F.concat(F.col("key"), F.lit(" = "), F.coalesce(F.concat(F.lit("  # "), F.col("hint")), F.lit("")))
    headed = questions.select("seq", head.alias("_h"), body.alias("_b"))
    return headed.select("seq", F.explode(F.filter(F.array("_h", "_b"), lambda x: x.isNotNull())).alias("line"))
