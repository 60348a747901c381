"""Quantiles and growth against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import checklist, comps, peers


def test_quantiles_against_numpy(spark):
    rng = random.Random(7)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 400 + [1.0], "many": [rng.gauss(0, 10) for _ in range(3000)], "few values": [float(rng.randrange(4)) for _ in range(999)], None: [7.0, 9.0, 8.0], "odd": [math.nan, math.inf, -math.inf, None, 4.0], "none": [None]}
    rows = [(k, v) for k, of in groups.items() for v in of]
    got = {r.k: r for r in peers.distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        of = [v for v in groups[k] if v is not None and math.isfinite(v)]
        assert [r.min, r.p25, r.median, r.p75, r.max, r.mean] == pytest.approx([min(of), *np.percentile(of, [25, 50, 75]), max(of), np.mean(of)]) and r.n == len(of) and r.enough == (len(of) >= 3)
    assert peers.distribution(spark.createDataFrame(rows, "k string, v double").limit(0), ["k"], "v").count() == 0
    positive = peers.distribution(spark.createDataFrame([("a", -1.0), ("a", 2.0)], "k string, v double"), ["k"], "v", positive_only=True).first()
    assert (positive.n, positive.median) == (1, 2.0)


def test_growth_of_us_companies_goes_by_days(spark):
    df = spark.sql("SELECT 121D AS revenue, 100D AS revenue_before, DATE '2022-12-31' AS revenue_end, DATE '2020-12-31' AS revenue_before_end UNION ALL SELECT 1D, -1D, DATE '2022-12-31', DATE '2020-12-31'")
    got = [r.g for r in df.select(comps.metric("us", "revenue_cagr").alias("g")).collect()]
    assert got[0] == pytest.approx(1.21 ** (365.25 / 730) - 1) and got[1] is None


def test_names_and_notes_are_escaped(spark):
    df = spark.createDataFrame([("e", "<a&b>", None, None, None, 'no "x" <y>')], "entity string, method string, band_low double, band_mid double, band_high double, note string")
    page = checklist.football_html(df.withColumn("span", F.lit(None).cast("double"))).first().html
    assert "&lt;a&amp;b&gt;" in page and "no &quot;x&quot; &lt;y&gt;" in page
