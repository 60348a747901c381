"""Early-stage valuations from nested configurations, one JSON object for each entity.

A figure may be a bare number, a list [low, mid, high], or an object with low, mid, high or value and its source and confidence. What is
wrong or missing names itself in the method's row; nothing is guessed, and no entity stops another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.work import written
from . import valuation as v

CONFIG = (
    "unit string, berkus struct<per_factor_cap:string, factors:map<string,string>, revenue_component:string>, scorecard struct<base:string, factors:map<string,string>>, "
    "vc_method struct<exit_value:string, investment:string, years_to_exit:string, target_multiple:string, target_irr:string, future_dilution:string, reverse:boolean, ask_price:string>, "
    "first_chicago struct<outcomes:array<struct<label:string, probability:double, value:double, basis:string>>, note:string>"
)
_SPEC = "low double, mid double, high double, value double, source string, confidence string"
#: Words for confidence, and Chinese names of the scorecard's factors.
CONFIDENCE = {"高": "high", "中": "medium", "低": "low", "缺失": "missing", "high": "high", "medium": "medium", "low": "low", "missing": "missing"}
FACTORS = {"管理团队实力": "team", "机会规模": "opportunity", "产品/技术": "product", "竞争环境": "competition", "营销渠道/合作关系": "channels", "后续融资需求": "financing", "其他": "other"}
VC_INPUTS = ["exit_value", "investment", "years_to_exit", "target_multiple", "target_irr", "future_dilution"]


def _named(table: dict[str, str], key: Column, default: Column) -> Column:
    out = default
    for k, value in table.items():
        out = F.when(key == k, value).otherwise(out)
    return out


def figure(spec: Column, default_confidence: str = "low") -> Column:
    """struct<low, mid, high, source, confidence, problem> of a figure's JSON; values are NULL where problem says why."""
    def read(text: Column) -> Column:
        listed, given = F.from_json(F.when(text.startswith("["), text), "array<double>"), F.from_json(F.when(text.startswith("{"), text), _SPEC)
        return F.struct(text.alias("text"), text.try_cast("double").alias("number"), listed.alias("listed"), given.alias("given"))

    def ends(r: Column) -> Column:
        number, listed, given = r["number"], r["listed"], r["given"]
        mid = F.coalesce(given["mid"], given["value"])
        whole = lambda c: F.when(F.size(listed) == 3, F.get(listed, F.lit(c)))
        low = F.coalesce(number, whole(0), F.when(given["mid"].isNotNull(), F.coalesce(given["low"], mid)), mid)
        high = F.coalesce(number, whole(2), F.when(given["mid"].isNotNull(), F.coalesce(given["high"], mid)), mid)
        return F.struct(r["text"].alias("text"), listed.alias("listed"), given.alias("given"), low.alias("low"), F.coalesce(number, whole(1), mid).alias("mid"), high.alias("high"))

    def judged(r: Column) -> Column:
        text, listed = r["text"], r["listed"]
        missing = F.when(text.isNull() | (text == "null"), "missing").when(listed.isNotNull() & (F.size(listed) != 3), "a range has three numbers")
        return F.struct(r.alias("r"), missing.when(r["low"].isNull() | r["mid"].isNull() | r["high"].isNull(), "not understood").alias("problem"))

    def told(j: Column) -> Column:
        r, problem = j["r"], j["problem"]
        confidence = F.when(problem == "missing", "missing").when(r["given"].isNull(), "low").otherwise(_named(CONFIDENCE, r["given"]["confidence"], F.lit(default_confidence)))
        value = lambda end: F.when(problem.isNull(), r[end]).alias(end)
        return F.struct(value("low"), value("mid"), value("high"), r["given"]["source"].alias("source"), confidence.alias("confidence"), problem.alias("problem"))

    return once(once(once(once(F.trim(spec), read), ends), judged), told)


def parsed(configs: DataFrame, entity: str, json: str) -> DataFrame:
    """entity, c: configurations by their schema; the part ``early_stage`` where there is one. A text that is no JSON gives NULL."""
    inner = F.coalesce(F.get_json_object(json, "$.early_stage"), F.col(json))
    return configs.select(F.col(entity).alias("entity"), F.from_json(inner, CONFIG).alias("c"))


def _factors(rows: DataFrame, base: Column, factors: Column) -> DataFrame:
    """entity, base, factor, f: a row for each factor, one without factor where there are none; written once, as several steps read it."""
    based = rows.select("entity", figure(base).alias("base"), factors.alias("factors"))
    return written(based.select("entity", "base", F.explode_outer("factors").alias("factor", "spec")).select("entity", "base", "factor", figure(F.col("spec")).alias("f")), "factors")


def _by_factors(rows: DataFrame, method: str, base_name: str, fits: Column, neutral: tuple[str, float], value) -> DataFrame:
    """Results of a method that sums over factors, and its problems.

    ``value`` refuses factors out of bounds, so those stand as ``neutral`` (name, figure) in it, and an entity that has one gets no result.
    """
    wrong = F.when(F.col("base.problem").isNotNull(), F.concat(F.lit(f"{base_name}: "), F.col("base.problem"))).when(F.col("factor").isNull(), F.lit("factors: missing"))
    wrong = wrong.when(F.col("f.problem").isNotNull(), F.concat("factor", F.lit(": "), F.col("f.problem"))).when(~fits, F.concat("factor", F.lit(": out of bounds or not known")))
    told = rows.withColumn("wrong", wrong)
    weak = F.array_sort(F.array_distinct(F.concat(F.collect_set(F.when(F.col("f.confidence") == "low", F.col("factor"))), F.collect_set(F.when(F.col("base.confidence") == "low", F.lit(base_name))))))
    notes = told.groupBy("entity").agg(F.min("wrong").alias("problem"), weak.alias("weak"))
    right = F.col("wrong").isNull()
    of = lambda name, otherwise: [F.when(right, F.col(f"{name}.{e}")).otherwise(otherwise).alias(f"{name}_{e}") for e in ("low", "mid", "high")]
    values = value(told.select("entity", F.when(right, F.col("factor")).otherwise(neutral[0]).alias("factor"), *of("f", neutral[1]), *of("base", 1.0)).withColumnsRenamed({f"f_{e}": e for e in ("low", "mid", "high")}))
    shown = [F.when(F.col("problem").isNull(), F.col(e)).alias(e) for e in ("low", "mid", "high")]
    return notes.join(values, "entity", "left").select("entity", F.lit(method).alias("method"), *shown, F.lit(True).alias("is_valuation"), "problem", "weak")


def build(configs: DataFrame, entity: str = "entity", json: str = "config") -> DataFrame:
    """entity, method, low, mid, high, is_valuation, problem, weak: each method that an entity's configuration has.

    Methods: berkus, scorecard, vc, vc_required_exit (a condition, no valuation), first_chicago. weak: figures of low confidence. An entity
    whose text can't be read, or that has no method, has one row without method and the problem.
    """
    rows = written(parsed(configs, entity, json), "configs")
    cap = _factors(rows.where("c.berkus is not null"), F.col("c.berkus.per_factor_cap"), F.col("c.berkus.factors"))
    extra = rows.select("entity", figure(F.col("c.berkus.revenue_component"))["mid"].alias("revenue_component"))
    shares = (F.col("f.low") >= 0) & (F.col("f.high") <= 1) & (F.col("base.low") > 0)
    capped = lambda told: told.withColumnsRenamed({f"base_{e}": f"cap_{e}" for e in ("low", "mid", "high")}).join(extra, "entity")
    berkus = _by_factors(cap, "berkus", "per_factor_cap", shares, ("idea", 0.0), lambda told: v.berkus(capped(told), ["entity"]))

    scored = _factors(rows.where("c.scorecard is not null"), F.col("c.scorecard.base"), F.col("c.scorecard.factors"))
    own = _named(FACTORS, F.col("factor"), F.col("factor"))
    bounds = own.isin(*v.SCORECARD_WEIGHTS) & (F.col("f.low") >= v.SCORECARD_BOUNDS[0]) & (F.col("f.high") <= v.SCORECARD_BOUNDS[1])
    scorecard = _by_factors(scored, "scorecard", "base", bounds, ("other", 1.0), lambda told: v.scorecard(told.withColumn("factor", own), ["entity"]))

    vc = rows.where("c.vc_method is not null").select("entity", F.col("c.vc_method.reverse").alias("reverse"), figure(F.col("c.vc_method.ask_price")).alias("ask"), *(figure(F.col(f"c.vc_method.{n}"), "medium").alias(n) for n in VC_INPUTS))
    needed = ["exit_value", "investment", "years_to_exit"]
    gaps = F.filter(F.array(*(F.when(F.col(f"{n}.problem").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"{n}.problem"))) for n in needed)), lambda x: x.isNotNull())
    target = F.col("target_multiple.mid").isNull() & F.col("target_irr.mid").isNull()
    problem = F.when(F.size(gaps) > 0, F.get(gaps, F.lit(0))).when(target, F.lit("target_multiple or target_irr: missing"))
    weak = F.array_sort(F.filter(F.array(*(F.when(F.col(f"{n}.confidence") == "low", F.lit(n)) for n in VC_INPUTS)), lambda x: x.isNotNull()))
    flat = vc.select("entity", "reverse", problem.alias("problem"), weak.alias("weak"), F.col("ask.mid").alias("pre_money_asked"), *(F.col(f"{n}.mid").alias(n) for n in VC_INPUTS)).withColumnsRenamed({"years_to_exit": "years", "future_dilution": "dilution"})
    flat = written(flat, "ventures")
    forward = v.vc_method(flat).withColumn("problem", F.coalesce("problem", F.when(F.col("pre_money").isNull(), F.lit("inputs out of bounds"))))
    shown = lambda c: [F.when(F.col("problem").isNull(), F.col(c)).alias(e) for e in ("low", "mid", "high")]
    venture = forward.select("entity", F.lit("vc").alias("method"), *shown("pre_money"), F.lit(True).alias("is_valuation"), "problem", "weak")
    asked = v.vc_required_exit(flat.where("reverse").withColumn("pre_money", F.col("pre_money_asked")))
    asked = asked.withColumn("problem", F.when(F.col("pre_money").isNull(), F.lit("ask_price: missing")).when(F.col("target_multiple").isNull(), F.lit("target_multiple: missing")).when(F.col("required_exit").isNull(), F.coalesce("problem", F.lit("inputs out of bounds"))))
    required = asked.select("entity", F.lit("vc_required_exit").alias("method"), *shown("required_exit"), F.lit(False).alias("is_valuation"), "problem", "weak")

    outcomes = rows.where("c.first_chicago is not null").select("entity", F.explode_outer("c.first_chicago.outcomes").alias("o"))
    whole = F.col("o.label").isNotNull() & F.col("o.probability").isNotNull() & F.col("o.value").isNotNull()
    judged = outcomes.groupBy("entity").agg(F.when(F.count("o") == 0, F.lit("outcomes: missing")).when(~F.bool_and(F.coalesce(whole, F.lit(False))), F.lit("an outcome needs label, probability and value")).when(F.abs(F.sum("o.probability") - 1) > 0.001, F.lit("probabilities must sum to 1")).alias("problem"))
    sound = outcomes.join(judged.where("problem is null").select("entity"), "entity", "left_semi").select("entity", "o.*")
    chances = judged.join(v.first_chicago(sound, ["entity"]), "entity", "left").select("entity", F.lit("first_chicago").alias("method"), "low", "mid", "high", F.lit(True).alias("is_valuation"), "problem", F.array().cast("array<string>").alias("weak"))

    methods = ["berkus", "scorecard", "vc_method", "first_chicago"]
    empty = rows.where(F.coalesce(*(F.col(f"c.{m}").cast("string") for m in methods)).isNull())
    nothing = empty.select("entity", F.lit(None).cast("string").alias("method"), *(F.lit(None).cast("double").alias(e) for e in ("low", "mid", "high")), F.lit(False).alias("is_valuation"), F.lit("no method is configured").alias("problem"), F.array().cast("array<string>").alias("weak"))
    return berkus.unionByName(scorecard).unionByName(venture).unionByName(required).unionByName(chances).unionByName(nothing)
