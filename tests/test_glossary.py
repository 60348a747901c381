"""Expansion of a column of texts against a plain version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.operators import glossary
from ledgerlens.operators.recipes import GLOSSARY


def plain(text, forms, most):
    if not (text or "").strip():
        return []
    low, taken, added = text.lower(), set(), []
    for form, words in forms:
        if len(added) >= most:
            break
        hay, form = (low, form.lower()) if form.isascii() else (text, form)
        places = (i for i in range(len(hay) - len(form) + 1) if hay.startswith(form, i) and not taken & set(range(i, i + len(form))))
        at = next(places, None)
        if at is not None:
            taken |= set(range(at, at + len(form)))
            for w in words:
                if w.lower() not in low and w.lower() not in [a.lower() for a in added]:
                    added.append(w)
    return added


def test_expansion_against_plain_version(spark):
    rng = random.Random(2)
    terms = {**GLOSSARY, "aa": ["甲"], "aaa": ["乙", "丙"], "A股": ["a share"]}
    forms = glossary.forms(terms)
    assert [len(f) for f, _ in forms] == sorted((len(f) for f, _ in forms), reverse=True)
    words = [w for t, ws in terms.items() for w in [t, *ws]]
    texts = [None, "", " ", "营业利润 and 利润总额", "Gross PROFIT 毛利率", "aaaaaa", "a股 A股", "资产" * 5_000]
    texts += ["".join(rng.choice(words)[rng.choice([0, 0, 0, 1]) :] + rng.choice(["", " ", "的"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    for most in (3, 16):
        got = {r.i: r.a for r in df.select("i", glossary.added_words(F.col("q"), forms, most).alias("a")).collect()}
        assert all(got[i] == plain(t, forms, most) for i, t in enumerate(texts))
    assert df.where("i = 4").select(glossary.expanded(F.col("q"), forms).alias("e")).first().e == "Gross PROFIT 毛利率 gross margin"
    assert df.where("i = 3").select(glossary.added_words(F.col("q"), []).alias("a")).first().a == []
