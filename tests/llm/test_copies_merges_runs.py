from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from ledgerlens.llm import branch_merge, exact_dedup, periodic_runs
from ledgerlens.llm.branch_merge import Branch, Edit
from ledgerlens.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_branch_merge"])
def test_query_matches_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == sql_rows(connect(small), ORACLE_SQL[name])


# ------------------------------------------------------------------ exact dedup

COPIES = [(1, "Ab"), (2, "aB"), (2, "ab"), (None, "AB"), (None, "q"), (None, "q"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (8, "kK"), (9, "kk"), (10, "long " * 200_000), (11, "LONG " * 200_000)]


def brute_copies(rows, largest):
    groups = defaultdict(list)
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for place, (i, t) in enumerate(rows):
        groups[fold(t)].append((i, place))
    out = {}
    for t, of in groups.items():
        ids = [i for i, _ in of if i is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        stays = min(p for i, p in of if i == keep)
        out |= {p: (i, keep, len(of), p == stays, hashlib.sha256(t.encode()).hexdigest()) for i, p in of}
    return [out[p] for p in range(len(rows))]


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda n: F.lit("1").cast("binary"), lambda n: F.octet_length(n).cast("string").cast("binary")])
def test_copies_against_brute_force_also_where_hashes_collide(spark, largest, hashed):
    df = spark.createDataFrame(COPIES, "doc_id long, text string").coalesce(1)
    got = exact_dedup.find_copies(df, keep_largest=largest, hashed=hashed).orderBy("place").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got] == brute_copies(COPIES, largest)


def test_copies_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_ROWS", 0)
    df = spark.createDataFrame(COPIES, "doc_id long, text string").coalesce(1)
    for hashed in (exact_dedup.content_hash, lambda n: F.lit("1").cast("binary")):
        got = exact_dedup.find_copies(df, hashed=hashed).orderBy("place").collect()
        assert [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got] == brute_copies(COPIES, False)


def test_rows_that_stay_keep_clashing_columns(spark):
    rows = [(i, t, f"k{n}", n) for n, (i, t) in enumerate(COPIES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, _place int").coalesce(1)
    stays = [r for r, (_, _, _, kept, _) in zip(rows, brute_copies(COPIES, True), strict=True) if kept]
    assert sorted(map(tuple, exact_dedup.without_copies(df, keep_largest=True).collect()), key=lambda r: r[3]) == stays
    assert exact_dedup.find_copies(df.limit(0)).count() == 0 and exact_dedup.without_copies(df.limit(0)).columns == df.columns


def test_hot_copies_and_native_plan(spark, small):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.find_copies(df, keep_largest=True)
    assert got.where("kept").count() == 20_001 and got.where("group_size = 10000 and keep_id = 29997").count() == 10_000
    plan = QUERIES["op11_exact_dedup"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ branch merge


def brute_merge(rows, code):
    """As the contract says, with dictionaries; ``code(branch, id, name)``."""
    out = []
    for i, text, lang, source in rows:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        state = {}
        for b in "LR":
            cols = {c: {0: "", 1: v + "!", 2: v + "?"}.get(code(b, i, c), v) for c, v in base.items()}
            own = [{0: None, 1: x + "!", 2: x + "?"}.get(code(b, i, str(k)), x) for k, x in enumerate(lines)]
            gaps = [{3: "!", 4: "?"}.get(code(b, i, str(k))) for k in range(len(lines))]
            row = code(b, i, "row")
            state[b] = {"gone": row == 0, "add": {3: "!", 4: "?"}.get(row), "cols": cols, "lines": own, "gaps": gaps, "changed": cols != base or own != lines or any(g is not None for g in gaps)}
        left, right = state["L"], state["R"]
        n = [0, 0, 0, 0]
        tell = lambda cols, own, gaps: (cols["lang"], cols["source"], "\n".join(x for pair in zip(own, gaps, strict=True) for x in pair if x is not None))

        def pick(a, b, base, conflict, n=n):
            if a == b:
                n[0] += b != base
            elif a == base or b == base:
                n[0] += 1
            else:
                n[conflict(a, b)] += 1
            return a if b == base else b

        if left["gone"] or right["gone"]:
            other = right if left["gone"] else left
            if not (left["gone"] and right["gone"]) and other["changed"]:
                n[2] = 1
                there = tell(right["cols"], right["lines"], right["gaps"]) if left["gone"] else (None, None, None)
            else:
                n[0], there = 1, (None, None, None)
        else:
            cols = {c: pick(left["cols"][c], right["cols"][c], v, lambda a, b: 1) for c, v in base.items()}
            own = [pick(a, b, x, lambda a, b: 2 if a is None or b is None else 1) for a, b, x in zip(left["lines"], right["lines"], lines, strict=True)]
            gaps = [pick(a, b, None, lambda a, b: 3) for a, b in zip(left["gaps"], right["gaps"], strict=True)]
            there = tell(cols, own, gaps)
        out.append((i, *there, *n))
        if left["add"] or right["add"]:
            n = [0, 0, 0, 0]
            text = pick(left["add"], right["add"], None, lambda a, b: 3, n)
            out.append((None if i is None else -1 - i, base["lang"], base["source"], text, *n))
    return sorted(out, key=repr)


def checksum(branch, i, name):
    return zlib.crc32(f"{branch}:{'' if i is None else i}:{name}".encode()) % 7


def merged(df, edits=branch_merge.EDITS, branches=None):
    left, right = branches or (branch_merge.checksum_branch(b, ["lang", "source"]) for b in "LR")
    return sorted(map(tuple, branch_merge.merge_branches(df, left, right, edits).collect()), key=repr)


def test_merge_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "\n", "a\n\nb\r\n", "é\n" * rng.randrange(4), "\n".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))])
    rows = [(i, text(), rng.choice([None, "", "en"]), rng.choice([None, "", "web"])) for i in range(600)]
    rows += [(7, "again", "en", "web"), (7, "again", "en", "web"), (None, "a\nb", None, "x"), (-5, "neg", "", ""), (10**15, "line\n" * 200_000, "en", "s")]
    got = merged(spark.createDataFrame(rows, DOCS))
    assert got == brute_merge(rows, checksum)
    # every kind of outcome occurs
    assert all(sum(r[k] for r in got) > 0 for k in range(4, 8)) and any(r[3] is None for r in got)


def test_merge_of_other_edits_and_missing_codes(spark):
    rows = [(1, "a\nb\nc", "x", [1], [None, 0, 9]), (2, "a", None, None, []), (3, None, "y", [1], [1])]
    df = spark.createDataFrame(rows, "doc_id int, text string, tag string, left array<int>, right array<int>").withColumn("l", F.lit("clash")).withColumn("n_clean", F.lit(1))
    none = F.lit(None).cast("int")
    branches = [Branch(none, {"tag": F.lit(1)}, F.col("left")), Branch(none, {"tag": none}, F.col("right"))]
    got = merged(df, [Edit(drop=True), Edit(append="+")], branches)
    assert got == [(1, "x+", "a+\nc", 3, 0, 0, 0), (2, "+", "a", 1, 0, 0, 0), (3, "y+", "+", 2, 0, 0, 0)]
    both = [Branch(none, {}, F.array(F.lit(1))), Branch(none, {}, F.array(F.lit(0)))]
    assert merged(df.where("doc_id = 2"), [Edit(drop=True), Edit(append="+", insert="-")], both) == [(2, "-", 1, 0, 1, 0)]
    assert merged(df.limit(0), [Edit()], both) == []


# ------------------------------------------------------------------ periodic runs


def brute_runs(words):
    """Every stretch with words q apart equal, for each q; the smallest q of a stretch counts."""
    n, w, found = len(words), np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(4_000):
        n, k = rng.choice([0, 1, 5, 6, 7, 8, 9, 12, 33, 64, 100]), rng.choice([1, 2, 2, 3, 5])
        w = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else w[i] for i in range(a, n)]
        texts = [[x.encode() for x in w], [x.encode() for x in w[::-1]]]
        assert periodic_runs.runs_of_texts(texts) == [brute_runs(w), brute_runs(w[::-1])]


@pytest.mark.parametrize("words", [["x"] * 300_000, ["x", "y", "x", "z"] * 50_000 + ["end"], list("ab" * 3 + "c") * 20_000])
def test_long_texts_of_repeats(words):
    got = periodic_runs.runs_of_texts([[x.encode() for x in words]])[0]
    assert max(got, key=lambda r: r[1])[1] in (len(words), len(words) - 1) and len(got) < 3


EDGES = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3, "x " * 50 + "y", "é é " * 9, "a\x1ca " * 6, "p q r s " * 40 + "p q"]


def test_run_query_against_brute_force(spark, small, tmp_path):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "z " * 8), (3, "a"), (3, "a")] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = brute_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a " * 6, "clash", {"k": 1})], "doc_id long, text string, runs string, extra map<string,int>")
    got = periodic_runs.mark_runs(df).collect()
    assert got[0].asDict(recursive=True) == {"doc_id": 1, "text": "a " * 6, "extra": {"k": 1}, "n_words": 6, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a"}
    assert periodic_runs.mark_runs(df.limit(0)).count() == 0
