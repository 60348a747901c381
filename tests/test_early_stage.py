"""Configurations to early-stage valuations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import early_stage
from ledgerlens.operators.valuation import SCORECARD_WEIGHTS


def results(spark, **configs):
    rows = [(k, c if c is None or isinstance(c, str) else json.dumps(c, ensure_ascii=False)) for k, c in configs.items()]
    got = early_stage.build(spark.createDataFrame(rows, "entity string, config string")).collect()
    return {(r.entity, r.method): r for r in got}


def test_figures_in_every_form(spark):
    specs = ["3", "[1, 2, 3]", '{"mid": 5, "low": 4, "source": "s", "confidence": "中"}', '{"value": 7}', "[1, 2]", '{"high": 2}', '"x"', None, "null"]
    got = [r.f for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").orderBy("i").select(early_stage.figure(F.col("s")).alias("f")).collect()]
    assert [(f.low, f.mid, f.high) for f in got] == [(3, 3, 3), (1, 2, 3), (4, 5, 5), (7, 7, 7)] + [(None, None, None)] * 5
    assert [f.confidence for f in got] == ["low", "low", "medium", "low", "low", "low", "low", "missing", "missing"]
    assert [f.problem for f in got] == [None] * 4 + ["a range has three numbers", "not understood", "not understood", "missing", "missing"] and got[2].source == "s"


def test_methods_of_a_configuration(spark):
    whole = {
        "unit": "万元",
        "berkus": {"per_factor_cap": {"value": 300, "confidence": "低"}, "factors": {"idea": [0.7, 0.8, 0.9], "team": {"mid": 0.5, "confidence": "高"}}, "revenue_component": 50},
        "scorecard": {"base": [8000, 10000, 12000], "factors": {"管理团队实力": [1.1, 1.2, 1.3], "product": 1}},
        "vc_method": {"exit_value": 50000, "investment": {"value": 1000, "source": "term sheet"}, "years_to_exit": 5, "target_multiple": 10, "future_dilution": 0.3, "reverse": True, "ask_price": 4000},
        "first_chicago": {"outcomes": [{"label": "good", "probability": 0.25, "value": 9000}, {"label": "bad", "probability": 0.75, "value": 0}]},
    }
    got = results(spark, a={"target": "x", "early_stage": whole}, b=whole)
    for e in "ab":
        r = got[(e, "berkus")]
        assert (r.low, r.mid, r.high) == pytest.approx((1.2 * 300 + 50, 1.3 * 300 + 50, 1.4 * 300 + 50)) and r.weak == ["idea", "per_factor_cap"] and r.problem is None
        w = SCORECARD_WEIGHTS["team"] / (SCORECARD_WEIGHTS["team"] + SCORECARD_WEIGHTS["product"])
        r = got[(e, "scorecard")]
        assert (r.low, r.mid, r.high) == pytest.approx((8000 * (1 + 0.1 * w), 10000 * (1 + 0.2 * w), 12000 * (1 + 0.3 * w)))
        assert got[(e, "vc")].mid == pytest.approx(1000 / (10 * 1000 / 50000 / 0.7) - 1000) and "investment" not in got[(e, "vc")].weak
        assert got[(e, "vc_required_exit")].mid == pytest.approx(10 * 1000 / (1000 / 5000 * 0.7)) and not got[(e, "vc_required_exit")].is_valuation
        r = got[(e, "first_chicago")]
        assert (r.low, r.mid, r.high) == (0, 2250, 9000)
    assert len(got) == 10


def test_what_is_wrong_is_named(spark):
    got = results(
        spark, cap={"berkus": {"factors": {"a": 0.5}}}, none={"berkus": {"per_factor_cap": 3, "factors": {}}}, share={"berkus": {"per_factor_cap": 3, "factors": {"a": 0.5, "b": 1.5}}},
        factor={"scorecard": {"base": 5, "factors": {"luck": 1}}}, range={"scorecard": {"base": [1, 2], "factors": {"team": 1}}}, target={"vc_method": {"exit_value": 9, "investment": 1, "years_to_exit": 2}},
        ask={"vc_method": {"exit_value": 50, "investment": 1, "years_to_exit": 2, "target_irr": 0.5, "reverse": True}}, sums={"first_chicago": {"outcomes": [{"label": "a", "probability": 0.5, "value": 1}]}},
        part={"first_chicago": {"outcomes": [{"label": "a", "value": 1}]}}, text="no json", null=None, other={"x": 1},
    )
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        ("cap", "berkus"): "per_factor_cap: missing", ("none", "berkus"): "factors: missing", ("share", "berkus"): "b: out of bounds or not known", ("factor", "scorecard"): "luck: out of bounds or not known",
        ("range", "scorecard"): "base: a range has three numbers", ("target", "vc"): "target_multiple or target_irr: missing", ("ask", "vc_required_exit"): "ask_price: missing", ("sums", "first_chicago"): "probabilities must sum to 1",
        ("part", "first_chicago"): "an outcome needs label, probability and value", ("text", None): "no method is configured", ("null", None): "no method is configured", ("other", None): "no method is configured",
    }
    assert all(r.mid is None for r in got.values() if r.problem) and got[("ask", "vc")].mid is not None


def test_figures_are_parsed_once(spark):
    df = spark.createDataFrame([("[1, 2, 3]",), ('{"value": 4}',), (None,)], "t string").select(early_stage.figure(F.col("t")).alias("f"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1 and plan.count("from_json(") == 2
    assert [(r.f.low, r.f.mid, r.f.high, r.f.problem) for r in df.collect()] == [(1.0, 2.0, 3.0, None), (4.0, 4.0, 4.0, None), (None, None, None, "missing")]
