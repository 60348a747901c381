"""Whole-text statistics as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    r"""The runs ``[^\x20\x09-\x0D]+`` of a text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def window_hashes(w: Column, size: int) -> Column:
    """A 64-bit hash of each run of ``size`` words; none if there are fewer words."""
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(w: Column, size: int) -> Column:
    """Words in windows of ``size`` words that the text holds twice or more, the first included.

    Windows are compared by 64-bit hash. Texts without a repeat, found by a hash set,
    stop there. Otherwise windows are sorted by hash, those with an equal neighbour keep
    their position, and the covered words are the sum of the steps between positions, at
    most ``size`` each.
    """

    def covered(h: Column) -> Column:
        # position in the low bits of a pair; structs sort by hash, then position
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def steps(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x
            )

        return let(let(pairs, repeats), steps)

    return let(window_hashes(w, size), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def duplicate_lines(text: Column) -> Column:
    r"""\n-split lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def word_stats(text: Column, window: int = 5) -> Column:
    """struct<n_words, n_distinct, word_chars, n_repeat_words> (long)."""
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, window).cast("long").alias("n_repeat_words"),
        ),
    )
