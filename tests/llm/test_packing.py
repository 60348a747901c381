from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import packed_binary, packing, token_counts
from ledgerlens.llm.best_fit import best_fit_counts, best_fit_decreasing
from ledgerlens.llm.encoders import BYTE_LEVEL_PATTERN, SAFE_TEXT, TokenCounter, counter, default_vocabulary, encoder, is_byte_level, prove_whole

TEXTS = ["", None, "a", "héllo wörld  \n\n x", "<|endoftext|> in <|endoftext|>", "word " * 3000, "x" * 5000, "数字１２３   ٣ ॐ", "'s don't WE'LL", "\t\t  tail  ", "a՘b ₏"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_encoder_gives_the_librarys_ids(library):
    enc = encoder(default_vocabulary())
    for t in TEXTS:
        assert enc.ids(t).tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_safe_characters_split_alike(library):
    import regex

    find, split = regex.compile(BYTE_LEVEL_PATTERN).findall, library.pre_tokenizer.pre_tokenize_str
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000 and SAFE_TEXT.fullmatch(chr(c)):
            s = f"a{chr(c)}1{chr(c)} {chr(c)}."
            assert find(s) == [s[a:b] for _, (a, b) in split(s)]


def long_texts(n):
    return {
        "spaces": " " * n + "a", "newlines": "x" + "\n" * n, "mixed": " \t\n\u3000" * (n // 4) + "'s", "letters": "a" * n, "marks": "!?" * (n // 2), "digits": "7" * n,
        "accents": "\u0301" * (n // 4), "foreign": "\u0e04\u0e04 \U0001f600" * (n // 8), "between": "<|endoftext|>" + " " * n + "<|endoftext|>" + "\n" * 5000 + "b", "end": "a" + " " * n,
    }


@pytest.mark.parametrize("name", sorted(long_texts(8)))
def test_long_runs_have_the_librarys_ids(library, name):
    text = long_texts(5_000_000 if name in ("spaces", "newlines") else 1_200_000)[name]
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder(default_vocabulary()).ids(text).tolist() == want
    assert counter(default_vocabulary(), prove_whole(default_vocabulary())).count(text) == len(want)


def test_random_texts_have_the_librarys_ids(library):
    rng = np.random.default_rng(5)
    parts = [" ", "\n", "\t", "a", "é", "\u0e04", "\U0001f600", "1", "\u0663", "!", "'s", "\xa0", "\u0301", "<|endoftext|>", "\x1c", "\u180e", "数", " " * 5000]
    enc, count = encoder(default_vocabulary()), counter(default_vocabulary(), prove_whole(default_vocabulary())).count
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(1, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.ids(text).tolist() == want and count(text) == len(want)


def test_whole_tables_with_long_runs(spark, library):
    texts = [*long_texts(1_200_000).values(), "plain text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, default_vocabulary()).collect()} == {i: len(x) for i, x in want.items()}
    rows = packing.pack_documents(df, default_vocabulary()).select("doc_id", "length").collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {i: len(x) + 1 for i, x in want.items()}
    got = packed_binary.pack_ids(df, default_vocabulary()).agg({"n_tokens": "sum"}).first()[0]
    assert got == sum(total.values())


def test_whole_tokens_are_proved(library):
    whole = prove_whole(default_vocabulary())
    assert len(whole) > 40_000
    for t in sorted(whole)[::977]:
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_counts_by_every_public_vocabulary(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect()}
        if name.endswith(".json"):
            lib = Tokenizer.from_file(path)
            want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
        else:
            import sentencepiece

            want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in TEXTS]
        assert got == {i: (len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(TEXTS, want, strict=True))}
    assert not is_byte_level(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.count_tokens(docs.limit(0), default_vocabulary()).count() == 0


def test_memo_stays_bounded():
    c = TokenCounter(default_vocabulary(), prove_whole(default_vocabulary()))
    c._memo.room = 10
    for i in range(50):
        c.count(f"zq{i}xv kj{i}")
    assert len(c._memo) <= c._memo.fixed + 11


def test_knapsack_and_plan_against_brute_force():
    import itertools

    values = np.array([-1.0, 0.2, 0.35, -1.0, 0.8, -1.0])
    best, pattern = packing.price_pattern(np.pad(values, (0, 3), constant_values=-1.0), 8)
    brute = max(a * 0.2 + b * 0.35 + c * 0.8 for a, b, c in itertools.product(range(9), range(5), range(3)) if a + 2 * b + 4 * c <= 8)
    assert best == pytest.approx(brute) and sum(k * v for k, v in pattern.items()) <= 8
    rng = np.random.default_rng(1)
    for top in (1, 30, 3000):
        demand = np.zeros(65, np.int64)
        demand[1:65] = rng.integers(0, top + 1, 64)
        plan = packing.plan_sequences(demand, 64)
        served = Counter()
        for classes, n in plan:
            assert sum(classes) <= 64
            served.update({c: k * n for c, k in Counter(classes).items()})
        assert +served == Counter({c: int(demand[c]) for c in range(1, 65) if demand[c]})
        assert sum(n for _, n in plan) <= -(-int(demand @ np.arange(65)) // 64) * 1.02 + 2


def test_priced_patterns_carry_the_plan():
    rng = np.random.default_rng(7)
    for scale in (1, 40):
        demand = np.zeros(257, np.int64)
        demand[1:] = scale * rng.integers(0, 60, 256)
        demand[256] = 900 * scale
        solved = packing.solve_patterns(demand, 256)
        priced = sum(int(x + 1e-6) for p, x in solved if len(p) > 1)
        needed = sum(x for _, x in solved)
        plan = packing.plan_sequences(demand, 256)
        total = sum(n for _, n in plan)
        assert total <= needed * 1.001 + 1 and total * 256 >= demand @ np.arange(257)
        from_patterns = {tuple(sorted(p.elements(), reverse=True)) for p, _ in solved}
        carried = sum(n for p, n in plan if p in from_patterns)
        assert carried > 0.95 * total and priced > 0.75 * (total - demand[256]), (carried, priced, total)


def test_best_fit_on_counts_is_best_fit_piece_by_piece():
    rng = np.random.default_rng(9)
    for capacity in (8, 32, 100):
        for _ in range(40):
            sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 200))).tolist()
            one = best_fit_decreasing(sizes, capacity)
            counts = best_fit_counts(Counter(sizes), capacity)
            assert sorted(capacity - sum(sizes[k] for k in s) for s in one) == sorted(capacity - sum(p) for p in counts.elements())
            assert Counter(x for p in counts.elements() for x in p) == Counter(sizes)
    many = best_fit_counts(Counter({k: 10**12 + k for k in range(1, 1025)}), 1024)
    assert sum(len(p) * n for p, n in many.items()) == sum(10**12 + k for k in range(1, 1025)) and len(many) < 20_000


def test_clashing_columns_pass_through(spark):
    names = ["n", "row", "class", "part", "base", "nth", "_k", "_lo", "_base", "times", "slot"]
    df = spark.createDataFrame([tuple(range(i, i + 11)) for i in range(1, 40)], names)
    rows = packing.pack_lengths(df, "n", 64, 4).collect()
    assert len(rows) == 39 and all(r["_base"] == r["n"] + 8 and r["nth"] == r["n"] + 5 for r in rows)
    docs = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id long, text string, ids int, sequence_id string")
    assert packed_binary.pack_ids(docs, default_vocabulary()).count() == 1


def check_packed(rows, docs, library):
    """Every id once, sequences gapless and not over the capacity."""
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in docs]
    want = Counter()
    for (d, _), x in zip(docs, ids, strict=True):
        for s in range(0, len(x), 1024):
            want[(d, s, len(x[s : s + 1024]), zlib.crc32(x[s : s + 1024].tobytes()), len(x))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    return len(by)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_packing_is_lossless(spark, library, monkeypatch, most):
    monkeypatch.setattr(packing, "MAX_BASES", most)  # few sums are sent, many are met by shuffle
    docs = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS * 40)] + [(5, "same text here")] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack_documents(df.withColumn("length", F.lit("clash")), default_vocabulary()).collect()
    n = check_packed(rows, docs, library)
    assert n <= len(best_fit_decreasing([r.length for r in rows], 1024)) * 1.01 + 1
    empty = packing.pack_documents(df.limit(0), default_vocabulary())
    assert empty.count() == 0


def test_lengths_out_of_range_raise(spark):
    with pytest.raises(Exception, match="length outside"):
        packing.pack_lengths(spark.createDataFrame([(1, 2000)], "id long, n long"), "n").count()


def test_query_on_the_small_tables(spark, small, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = packing.query(spark, small).collect()
    n = check_packed(rows, docs, library)
    assert n * 1024 <= sum(r.length for r in rows) * 1.02


def test_best_fit_decreasing_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 33, 40).tolist()
        free, want = [], []
        for k in sorted(range(40), key=lambda k: (-sizes[k], k)):
            fit = [r for r in free if r >= sizes[k]]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - sizes[k])
            else:
                free.append(32 - sizes[k])
        got = best_fit_decreasing(sizes, 32)
        assert sorted(k for s in got for k in s) == list(range(40))
        assert sorted(32 - sum(sizes[k] for k in s) for s in got) == sorted(free)


def test_matrix_round_trip(spark, library, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed_binary.write_packed(packed_binary.pack_ids(df, default_vocabulary()), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    parts = defaultdict(dict)
    m = packed_binary.matrix(rows)
    assert m.shape == (len(rows), 1024)
    for r, row in zip(rows, m, strict=True):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.padding == 1024 - r.n_tokens
        assert r.ids_crc32 == zlib.crc32(row[: r.n_tokens].astype("<u4").tobytes()) and not row[r.n_tokens :].any()
        positions = packed_binary.position_ids(r.position_resets, r.n_tokens)
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[d][s] = row[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for d, t in docs:
        assert [x for _, p in sorted(parts[d].items()) for x in p] == [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert packed_binary.pack_ids(df.limit(0), default_vocabulary()).count() == 0


def test_padding_does_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = [packed_binary.pack_ids(docs.repartition(n), default_vocabulary()).agg(F.count("*"), F.sum("padding"), F.min("sequence_id"), F.max("sequence_id")).first() for n in (1, 40)]
    assert tuple(got[0]) == tuple(got[1]) and got[0][3] == got[0][0] - 1
