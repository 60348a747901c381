from __future__ import annotations

import pytest

from ledgerlens.plans import tools


def test_calls_are_validated(spark, small):
    assert tools.call(spark, "run_query", {"query": "audit_tail", "sf_dir": small}).count() == 20
    for name, arguments, error, words in (
        ("nothing", {}, KeyError, "run_query"), ("run_query", {"sf_dir": small}, ValueError, "missing argument 'query'"), ("run_query", {"query": "nope", "sf_dir": small}, ValueError, "one of"),
        ("run_query", {"query": 5, "sf_dir": small, "x": 1}, ValueError, "unknown argument 'x'"),
    ):
        with pytest.raises(error, match=words):
            tools.call(spark, name, arguments)


def test_consent_and_duplicates(spark):
    tool = tools.Tool("outside", lambda s, n: s.range(n), {"n": tools.Parameter(int)}, purpose="prices")
    tools.register(tool)
    with pytest.raises(PermissionError, match="prices"):
        tools.call(spark, "outside", {"n": 3})
    assert tools.call(spark, "outside", {"n": 3}, frozenset({"prices"})).count() == 3
    assert tool.problems({"n": True}) == ["'n' wants int"]
    with pytest.raises(ValueError, match="already"):
        tools.register(tool)
