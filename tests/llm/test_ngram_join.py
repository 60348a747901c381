from __future__ import annotations

import random
from collections import defaultdict

import pytest
from oracle import connect, spark_rows, sql_rows

from ledgerlens.llm import components, ngram_join


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)].append(d)
    return sorted(((d, len(s), min(names[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def joined(spark, docs):
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, n_shingles string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()), key=repr)


def near_copies(n, words, most, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(most)):
            w[at] = f"e{k}x{at}"
        out.append(" ".join(w))
    return out


def test_sql_gives_the_same(spark, small):
    assert spark_rows(ngram_join.query(spark, small)) == sql_rows(connect(small), ngram_join.SQL)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "é b"), (8, "É b"), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d E"), (11, "x " * 4000), (12, "x " * 4000 + "y"), (None, None)]
    assert joined(spark, docs) == brute(docs)
    assert ngram_join.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "LIST_PART", 16)
    texts = near_copies(120, 60, 8, seed) + near_copies(40, 25, 5, seed + 9) + ["shared " * 3 + " ".join(f"u{i}n{k}" for i in range(30)) for k in range(30)]
    texts += [texts[3]] * 60
    docs = list(enumerate(random.Random(seed).sample(texts, len(texts))))
    assert joined(spark, docs) == brute(docs)


def test_hot_lists_and_components_are_spread(spark, monkeypatch):
    from ledgerlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(ngram_join, "LIST_PART", 16)
    texts = near_copies(80, 40, 8, 3) + near_copies(60, 30, 6, 4)
    docs = list(enumerate(texts))
    assert joined(spark, docs) == brute(docs)
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 1)
    assert joined(spark, docs) == brute(docs)


def test_all_bits_of_the_hash(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 18)  # as in large tables
    docs = list(enumerate(near_copies(60, 40, 8, 5) + ["", "a b"]))
    assert joined(spark, docs) == brute(docs)


def test_pages_of_one_template_are_not_paired(spark, monkeypatch):
    """Of 400 pages that share 82 % of their words in a row no two link, and the last step makes no pairs of them."""
    met = []
    plain = ngram_join._remaining_pairs

    def spy(lists):
        out = plain(lists)
        met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_remaining_pairs", spy)
    template = [f"t{i}" for i in range(164)]
    pool = [" ".join(f"f{k}x{i}" for i in range(36)) for k in range(400)]
    docs = [(k, " ".join(template) + " " + pool[k]) for k in range(400)]
    assert all(c == d for d, _, c in joined(spark, docs)) and met == [0]


def test_chain_links_through_neighbours(spark):
    chain = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in range(0, 60, 4)]
    docs = list(enumerate(chain))
    got = joined(spark, docs)
    assert got == brute(docs) and {c for _, _, c in got} == {0}


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
