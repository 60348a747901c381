from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, license_scans, quality_classifier, quality_rules, sharding, text_stats, toxicity
from ledgerlens.llm.common import utf8_size

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


EDGES = [None, "", " ", "\n\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 500, "é ü #*$ %&|<>", "l\nl\n \n \nl", "a b c d e f a b c d e", "one two three four five six seven eight nine ten", "\x0b\x0ca\x1cb"]


def test_statistics_against_brute_force(spark, small):
    docs = [(i, t) for i, t in enumerate(EDGES)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality_rules.judge(df, []).collect():
        want = brute_stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


def test_rules_are_learned_in_order(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    y = (~((x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5)))).astype(int)
    rules = quality_rules.learn_rules(x, y, max_tests=2)
    covered = np.zeros(n, bool)
    for r in rules:
        covered |= quality_rules._covers(r, x, n)
    assert (covered & (y == 1)).sum() <= 4 and (covered & (y == 0)).mean() > 0.25
    assert quality_rules.learn_rules(x, np.ones(n, int)) == [] and quality_rules.learn_rules({k: v[:0] for k, v in x.items()}, y[:0]) == []


def test_decision_list_on_a_table(spark):
    rules = [(quality_rules.Test("symbols_per_word", True, 0.5),), (quality_rules.Test("n_words", False, 11.0), quality_rules.Test("upper_share", True, 0.5))]
    text = ["# " * 12 + "a b", "A B C D E F G H I J", "a b c d e f g h i j"]
    got = quality_rules.judge(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string"), rules).orderBy("doc_id").collect()
    assert [(r.rule, r.kept) for r in got] == [(1, False), (2, False), (0, True)]


def test_rules_reject_junk_and_keep_clean(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.query(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k"), F.avg((F.col("kept") | F.col("base_failed")).cast("double")).alias("passed")).collect()
    rate = {r.quality: (r.k, r.passed) for r in got}
    assert rate[0][0] < 0.15 and rate[1][1] > 0.99
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0


def test_co_training_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.xxhash64("doc_id") % 2 == 0)
    model = quality_classifier.fit(docs, known)
    got = quality_classifier.score(docs, model).join(labels.join(known, "doc_id", "left_anti"), "doc_id").collect()
    kept = {q: np.mean([r.kept for r in got if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.35, kept
    edge = spark.createDataFrame([(None, None, None, None, "k"), (1, "", "en", "s", "k"), (1, "", "en", "s", "k"), (2, "w " * 9000, "en", None, "k")], "doc_id long, text string, lang string, source string, score string")
    rows = quality_classifier.score(edge, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[1].score == rows[2].score
    none = quality_classifier.fit(docs, labels.limit(0))
    assert quality_classifier.score(docs, none).where("not kept").count() == 0
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_co_training_reads_every_unlabelled_document(spark):
    good, bad = "the station of the old town was open", "click here now buy cheap pills today"
    rows = [(i, f"{bad if i % 2 else good} w{i % 7}", "en", "spam" if i % 2 else "press", 40) for i in range(400)]
    ids = [r.doc_id for r in spark.range(400, 5_400).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows += [(d, f"{bad} {'zyxwv' if k >= 4_500 else 'plain'}", "en", "spam", 40) for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    assert model.text.weights[quality_classifier._word_features(b"zyxwv")[1]] < 0  # only the last documents by hash have the word
    again = quality_classifier.fit(docs.repartition(7), labels)
    assert (model.text.weights == again.text.weights).all() and model.threshold == again.threshold


def test_toxicity_chain_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.xxhash64("doc_id") % 2 == 0)
    chain = toxicity.fit(docs, known.withColumn("low_quality", 1 - F.col("quality")), ("low_quality", "toxic"))
    assert [k.category for k in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    held = toxicity.predict(docs.join(labels.join(known, "doc_id", "left_anti"), "doc_id"), chain)
    got = {r.toxic: r.f for r in held.groupBy("toxic").agg(F.avg(F.col("is_toxic").cast("double")).alias("f")).collect()}
    assert got[1] > 0.7 and got[0] < 0.01
    edge = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (3, "idiot " * 5000, 3)], "doc_id long, text string, p_toxic int")
    rows = toxicity.predict(edge, chain).collect()
    assert [r.is_toxic for r in rows[:3]] == [False] * 3 and rows[3].is_toxic
    two = toxicity.fit(docs, labels.withColumn("low", 1 - F.col("quality")), ("low", "toxic"), limit=500)
    assert [k.category for k in two.links] == ["low", "toxic"]
    assert toxicity.predict(docs.limit(0), chain).count() == 0 and toxicity.predict(docs.limit(5), toxicity.fit(docs, labels.limit(0))).count() == 5


def plain_chain(text, chain):
    """The chain's probabilities from its figures, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    signs = set(words) | {"^" + w[:k] for w in words for k in (3, 5, 7) if len(w) >= k}
    hashes = {toxicity._signed(xxhash.xxh3_64_intdigest(s.encode())) for s in signs}
    logits = []
    for link in chain.links:
        z = link.bias + sum(x for h, x in link.words.items() if h in hashes) + sum(a * b for a, b in zip(link.earlier, logits, strict=True))
        logits.append(link.a * z + link.b)
    return [1 / (1 + np.exp(-z)) for z in logits]


def test_toxicity_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.withColumn("low_quality", 1 - F.col("quality")), ("low_quality", "toxic"))
    rows = toxicity.predict(docs, chain).collect()
    for r in rows:
        want = plain_chain(r.text, chain)
        assert r.p_low_quality == pytest.approx(want[0], abs=1e-9) and r.p_toxic == pytest.approx(want[1], abs=1e-9) and r.is_toxic == (want[1] >= toxicity.THRESHOLD)


def test_chain_learns_from_out_of_fold_predictions(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(200)]
    first = np.array([3 in r for r in rows], int)
    second = np.array([3 in r and 7 in r for r in rows], int)
    seen = []
    plain = toxicity._fit

    def spy(x, y, earlier):
        seen.append((len(x), earlier.copy()))
        return plain(x, y, earlier)

    monkeypatch.setattr(toxicity, "_fit", spy)
    chain = toxicity.fit_chain(rows, {"a": first, "b": second}, folds=4)
    assert [n for n, _ in seen] == [150] * 4 + [200] + [150] * 4 + [200]  # four folds, then all, for each link
    # what the second link got of row i comes from the model that has not seen row i
    held = np.zeros(200)
    for f in range(4):
        train, test = np.flatnonzero(np.arange(200) % 4 != f), np.flatnonzero(np.arange(200) % 4 == f)
        words, model = plain([rows[i] for i in train], first[train], np.zeros((150, 0)))
        held[test] = model.logit(toxicity._design([rows[i] for i in test], words, np.zeros((50, 0))))
    a, b = toxicity.fit_platt(held, first)
    assert seen[-1][1][:, 0] == pytest.approx(a * held + b) and len(chain.links[1].earlier) == 1


def test_quality_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    for r in quality_classifier.score(docs, model).collect():
        words = (r.text or "").encode().split()
        z = model.text.bias + sum(model.text.weights[zlib.crc32(w[-2:]) % 4096] + model.text.weights[4096 + zlib.crc32(w.lower()) % 8192] for w in words) / max(len(words), 1)
        z += model.text.weights[12288] * sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1) + sum(a * b for a, b in zip(quality_classifier.shape(r.text), model.text.weights[12289:], strict=True))
        slots = [zlib.crc32(repr(r.lang).encode()) % 16, 16 + zlib.crc32(repr(r.source).encode()) % 64, 80 + zlib.crc32(repr((r.lang, r.source)).encode()) % 256, 336 + min(r.n_chars.bit_length(), 22)]
        v = model.meta.bias + sum(model.meta.weights[k] for k in slots)
        z, v = model.text.a * z + model.text.b, model.meta.a * v + model.meta.b
        want = 1 / (1 + np.exp(-np.clip(z + v - np.log(model.prior / (1 - model.prior)), -35, 35)))
        assert r.score == pytest.approx(want, abs=1e-9) and r.kept == (r.score >= model.threshold)


def test_the_threshold_spares_good_rows():
    good, bad = np.linspace(0.7, 1, 1000), np.array([0.1, 0.2, 0.9])
    assert quality_classifier.choose_threshold(good, bad) == 0.5
    low = np.concatenate([np.full(5, 0.2), good])  # more good rows than may be lost lie below a half
    assert quality_classifier.choose_threshold(low, bad) == 0.2
    assert quality_classifier.choose_threshold(good, bad[:0]) == 0.0 and quality_classifier.choose_threshold(good[:0], bad) == 0.0


def check_shards(rows, n_shards):
    by = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(n_shards)}
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(v == list(range(len(v))) for v in by.values())


class Twister:
    """The generator and the shuffle that Spark's function documents by its source: Mersenne twister, seeded by two words, and Fisher-Yates from the front."""

    def __init__(self, seed):
        low, high = seed & 0xFFFFFFFF, (seed >> 32) & 0xFFFFFFFF
        assert low
        self.random = random.Random(low << 32 | high)

    def below(self, n):
        if n & -n == n:
            return n * (self.random.getrandbits(32) >> 1) >> 31
        while True:
            bits = self.random.getrandbits(32) >> 1
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n

    def shuffled(self, items):
        out = []
        for i, x in enumerate(items):
            j = self.below(i + 1)
            out.append(None)
            if j != i:
                out[i] = out[j]
            out[j] = x
        return out


def plain_shards(rows, shards, seed, bucket_bytes, bucket_rows=50_000):
    """rows: (doc_id, size, h1, h2); gives doc_id -> (shard, slot)."""
    buckets = max(1, -(-sum(r[1] for r in rows) // bucket_bytes), -(-len(rows) // bucket_rows))
    held = [sorted((r for r in rows if r[2] % buckets == b), key=lambda r: (r[2], r[3])) for b in range(buckets)]
    order = []
    for b in range(buckets):  # as many tasks as buckets
        order += Twister(seed + b).shuffled(held[b])
    return {r[0]: (g % shards, g // shards) for g, r in enumerate(order)}


def hashed_rows(docs, seed):
    names = docs.columns
    return [tuple(r) for r in docs.select("doc_id", utf8_size(F.col("text")) if "text" in names else F.lit(1), F.xxhash64(F.lit(seed), *names), F.xxhash64(F.lit(~seed), *names)).collect()]


@pytest.mark.parametrize("settings", [{}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.shuffle.partitions": "3"}, {"spark.sql.shuffle.partitions": "57", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}])
def test_shards_against_plain_version_under_any_plan(spark, small, settings):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = plain_shards(hashed_rows(docs, 5), 7, 5, 20_000)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for given in (docs, docs.repartition(5)):
            got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_to_shards(given, utf8_size(F.col("text")), 7, seed=5, bucket_bytes=20_000).collect()}
            assert got == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shards_are_even_whole_and_repeatable(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    dealt = sharding.shuffle_to_shards(docs.withColumn("slot", F.lit("clash")), utf8_size(F.col("text")), 7, bucket_bytes=20_000)
    rows = dealt.collect()
    check_shards(rows, 7)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    again = sharding.shuffle_to_shards(docs.repartition(5), utf8_size(F.col("text")), 7, bucket_bytes=20_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = sharding.shuffle_to_shards(docs, utf8_size(F.col("text")), 7, seed=1, bucket_bytes=20_000).collect()
    assert sum(a != b for a, b in zip(sorted((r.doc_id, r.shard) for r in rows), sorted((r.doc_id, r.shard) for r in other), strict=True)) > 100
    sharding.write_shards(dealt, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    q = {r.doc_id: r for r in sharding.query(spark, small).collect()}
    for d in docs.collect():
        raw = d.text.encode()
        assert (q[d.doc_id]["size"], q[d.doc_id].text_crc32, q[d.doc_id].law) == (len(raw) + 1, zlib.crc32(raw), "rows")


def test_hot_rows_nulls_maps_and_empty_tables(spark, tmp_path):
    rows = [(None, None)] * 300 + [(7, "same")] * 300 + [(i, f"t{i}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), F.lit(1))).write.parquet(str(tmp_path / "hot"))
    df = spark.read.parquet(str(tmp_path / "hot"))
    got = sharding.shuffle_to_shards(df, utf8_size(F.col("text")), 16, bucket_rows=50).collect()
    check_shards(got, 16)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sharding.shuffle_to_shards(df.limit(0), utf8_size(F.col("text"))).count() == 0


def test_copies_of_many_bytes_are_spread(spark, tmp_path):
    rows = [(1, "x" * 1000)] * 200 + [(i, f"t{i}") for i in range(50)]
    spark.createDataFrame(rows, "h1 long, hot string").write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))  # columns named like the operator's own
    got = sharding.shuffle_to_shards(df, utf8_size(F.col("hot")), 4, bucket_bytes=20_000)
    check_shards(got.collect(), 4)
    assert Counter((r.h1, r.hot) for r in got.collect()) == Counter(rows)


def test_the_order_is_like_chance(spark):
    n = 20_000
    rows = sharding.shuffle_to_shards(spark.range(n).withColumnRenamed("id", "doc_id"), F.lit(400), 16, bucket_rows=1_000).collect()
    place = np.empty(n)
    for r in rows:
        place[r.doc_id] = r.slot * 16 + r.shard
    assert sorted(place) == list(range(n))
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.03  # four standard errors
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.03
    in_order = np.mean(np.diff(place) > 0)
    assert abs(in_order - 0.5) < 0.015
    counts = Counter(r.shard for r in rows if r.doc_id < n // 2)
    assert all(abs(counts[k] - n / 32) < 5 * np.sqrt(n / 64) for k in range(16))


def test_license_scan_against_brute_force(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = set()
    for r in docs.collect():
        t = " ".join(re.findall(r"[^\W_]+", r.text.lower()))
        for name, p in (("MIT", "released under the mit license"), ("Apache-2.0", "licensed under the apache license version 2 0"), ("GPL-3.0", "this work is licensed under the gnu general public license version 3"), ("CC-BY-NC-4.0", "licensed under cc by nc 4 0")):
            if p in t:
                want.add((r.doc_id, name))
    got = license_scans.scan(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == want and all(r.containment >= 0.75 for r in got)


def test_license_scan_finds_changed_long_texts_and_skips_parts(spark):
    notice = license_scans.TEMPLATES["GPL-3.0"][1]
    words = notice.split()
    near = " ".join(["filler"] * 37 + words[:20] + ["changed"] + words[21:] + ["more"] * 50)
    part = " ".join(words[:12])
    df = spark.createDataFrame([(1, near, "x"), (2, part, "x"), (3, None, "x"), (4, "", "x"), (5, "Released under the MIT\nLicense!", "x"), (5, "Released under the MIT\nLicense!", "x")], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.first_word) for r in license_scans.scan(df).collect())
    assert got == [(1, "GPL-3.0", 37), (5, "MIT", 0), (5, "MIT", 0)]
    assert license_scans.scan(df.limit(0)).count() == 0 and license_scans.scan(df, {}).count() == 0


def test_changed_notices_by_brute_force_containment(spark):
    rng = random.Random(11)
    shingle = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    rows, want = [], set()
    for name, texts in license_scans.TEMPLATES.items():
        for t in texts:
            if len(words(t)) < 16:
                continue
            for k in range(12):
                w = words(t)
                for at in rng.sample(range(len(w)), k % 4):
                    w[at] = f"changed{at}"
                share = max(len(shingle(w) & shingle(words(x))) / len(shingle(words(x))) for x in texts)
                key = len(rows)
                rows.append((key, " ".join(["before"] * rng.randrange(20) + w + ["after"] * 5)))
                if share >= 0.75:
                    want.add((key, name))
    got = {(r.doc_id, r.license) for r in license_scans.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 40 and got == want


def test_many_templates_are_searched_in_blocks(spark):
    own = {f"L{i}": [" ".join(f"l{i}w{k}" for k in range(40))] for i in range(12)}
    rows = [(i, "x " + own[f"L{i}"][0] + " y") for i in range(12)] + [(99, "nothing here at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("s", "start", "n", "key", "w", "hit", "row", "doc", "_s", "_start", "template", "best")})
    found = license_scans.scan(df, own, block_words=100).collect()
    assert {(r.doc_id, r.license) for r in found} == {(i, f"L{i}") for i in range(12)} and all(r["_s"] == r["start"] == r["key"] == 7 and r.containment == 1.0 for r in found)
    whole = [f"w{i}" for i in range(1_000)]  # searched at some places only
    changed = [w if i % 25 else f"c{i}" for i, w in enumerate(whole)]
    texts = [(1, " ".join(["x"] * 7 + changed)), (2, " ".join(whole[:500])), (3, "nothing")]
    assert [(r.doc_id, r.first_word, r.end_word) for r in license_scans.scan(spark.createDataFrame(texts, "doc_id long, text string"), {"X": [" ".join(whole)]}).collect()] == [(1, 8, 1_007)]


def test_license_bands_miss_few_windows():
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, (4_000, 16))  # two sets of 12 with 8 in common: J = 0.5
    missed = np.ones(len(h), bool)
    for c in license_scans._constants():
        x = h ^ np.int64(c)
        missed &= x[:, :12].min(axis=1) != x[:, 4:].min(axis=1)
    assert missed.mean() < 0.01


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(len(x), 10)
        windows = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in windows:
                hit.update(range(a, a + k))
                found.add(None if i is None else str(i))
    return len(w), len(hit), sorted(found, key=lambda i: (i is None, i or ""))


def test_decontamination_against_brute_force(spark, small):
    con = connect(small)
    assert spark_rows(decontamination.query(spark, small)) == sql_rows(con, decontamination.SQL)
    items = [(1, "Alpha beta gamma"), (2, None), (3, "!!"), (4, " ".join(f"w{i}" for i in range(14))), (5, "alpha BETA"), (1, "éa İx"), (None, "solo"), (7, "a b a b a b a b a b a b a"), (8, " ".join(f"w{i}" for i in range(9)))]
    texts = [None, "", "ALPHA, beta\ngamma! alpha", "alphabeta gamma", " ".join(f"w{i}" for i in range(3, 20)), " ".join(f"w{i}" for i in range(9)), "x éa-İx y", "Éa İx", "solo_solo", "w1 " * 3000, "b a " * 40, "c a b a b a b a b a b c b a b"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 40, 10):  # one automaton, then one for each few bytes
        for r in decontamination.find_overlaps(docs, bench, block_bytes=block).collect():
            assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, items), r.text
            for s in r.spans:
                assert brute_hits(r.text[s.start : s.end], items)[1] > 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.find_overlaps(docs.limit(0), bench).count() == 0
    named = spark.createDataFrame([("null", "alpha"), (None, "alpha")], "item_id string, text string")
    assert decontamination.find_overlaps(docs, named).where("doc_id = 2").first().item_ids == ["null", None]


def test_blocks_of_items_give_what_windows_give():
    rng = random.Random(8)
    for _ in range(300):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 4, 5, 9, 10, 11, 14, 30])))) for k in range(rng.randint(1, 4))]
        text = " ".join(rng.choice("abcd") for _ in range(rng.choice([5, 20, 120])))
        n, runs, found = decontamination.scan_text(text, decontamination.Items(items, 10))
        assert (n, sum(b - a for a, b in runs), sorted(map(str, found))) == brute_hits(text, items)


def test_large_benchmark_is_searched_without_a_copy_of_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    long_item = " ".join(f"v{rng.randrange(5000)}" for _ in range(30_000))
    words = long_item.split()
    texts = [" ".join(words[k : k + 12]) for k in range(0, 29_000, 997)] + ["other text " * 20] * 5
    path = f"{tmp_path}/d"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    bench = spark.createDataFrame([("long", long_item), ("short", "other text other")], "item_id string, text string")
    made, keep = [], decontamination.materialize
    monkeypatch.setattr(decontamination, "materialize", lambda df, label: made.append((label, df.columns)) or keep(df, label))
    for block in (10_000_000, 60_000):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.find_overlaps(docs, bench, block_bytes=block).collect()}
        assert got == {k: (39, ["short"]) if "other" in t else (12, ["long"]) for k, t in enumerate(texts)}
    assert {label for label, _ in made} == {"items", "finds"} and not any("text" in c for _, c in made)


def test_automaton_of_many_items_is_small():
    rng = np.random.default_rng(4)
    parts = [(str(k), " ".join(f"w{x}" for x in rng.zipf(1.3, 500) % 100_000)) for k in range(1_000)]  # 3 MB
    items = decontamination.Items(parts, 10)
    nodes = items.machine.get_stats()
    assert nodes["total_size"] < 40 * sum(len(t) for _, t in parts)
    assert decontamination.scan_text(parts[7][1], items)[1] == [(0, 500)]


def test_sums_of_many_tasks_are_added_in_rounds(spark, monkeypatch):
    """The sums over 30 partitions with two neighbours a group are those over one partition."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("good fine bad junk word other".split()) for _ in range(rng.randint(3, 30)))
    docs = spark.createDataFrame([(i, text(), "en", "web", 50) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    features = quality_classifier._with_features(docs.withColumn("_y", F.lit(-1)))
    view = lambda size: quality_classifier.View(np.zeros(size), 0.0, 1.0, 0.0)
    views = [view(quality_classifier.TEXT_SIZE), view(quality_classifier.META_SIZE)]
    level = int(quality_classifier._level(np.zeros(1))[0])
    rounds = [(views, [{1: level, 0: level - 1}, {1: quality_classifier.LEVELS, 0: level}])]
    got = []
    for parts, fan in ((1, 64), (30, 2), (30, 64)):
        monkeypatch.setattr(quality_classifier, "FAN_IN", fan)
        got.append(quality_classifier.Pool(quality_classifier.materialize(features.repartition(parts), "features")).sums(rounds))
    assert sum(n for _, n, _ in got[0][0]) == 600
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert [(y, n) for y, n, _ in a] == [(y, n) for y, n, _ in b] and all(np.array_equal(x[2], y[2]) for x, y in zip(a, b, strict=True))
