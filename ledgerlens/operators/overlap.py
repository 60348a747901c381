"""Overlap of outgoing text with a confidential corpus, and blocklists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import overlap_form

MIN_OVERLAP = 8
#: Characters of values that one broadcast may hold.
MAX_BROADCAST_CHARS = 4_000_000
#: Characters of the corpus that are searched at once.
SEARCHED_CHARS = 1 << 18


def char_grams(df: DataFrame, key: str, text: str, size: int = MIN_OVERLAP) -> DataFrame:
    """(key, at, gram): each window of ``size`` characters of the comparing form."""
    norm = df.select(key, overlap_form(F.col(text)).alias("_t"))
    last = F.length("_t") - size
    return norm.where(last >= 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.substring(F.col("_t"), i + 1, F.lit(size)).alias("gram")))).alias("g")).select(key, "g.*")


def longest_overlaps(values: DataFrame, corpus: DataFrame, value_key: str, corpus_key: str, value: str = "value", text: str = "text", size: int = MIN_OVERLAP) -> DataFrame:
    """(value_key, corpus_key, at, length): the longest run that a value shares with a corpus document, leftmost of equal ones.

    Any overlap of ``size`` or more characters shares a window of ``size``; matching windows at
    consecutive places on both sides are one run. Values counted to be under the bound are sent to all executors, which scan
    whole documents; more of them are met by an equi-join on the window.
    """
    norm = values.select(value_key, overlap_form(F.col(value)).alias("_t")).where(F.length("_t") >= size)
    if (norm.agg(F.sum(F.length("_t"))).first()[0] or 0) <= MAX_BROADCAST_CHARS:
        found = _scanned(norm, corpus.select(corpus_key, overlap_form(F.col(text)).alias("_t")), value_key, corpus_key, size)
    else:
        found = _joined(values, corpus, value_key, corpus_key, value, text, size)
    # one number that is greatest for the longest run, leftmost of equal ones
    best = found.groupBy(value_key, corpus_key).agg(F.max("_rank").alias("_rank"))
    length = F.shiftright(F.col("_rank") + F.lit((1 << 32) - 1), 32)
    return best.select(value_key, corpus_key, (F.shiftleft(length, 32) - F.col("_rank")).cast("int").alias("at"), length.alias("length"))


def _joined(values: DataFrame, corpus: DataFrame, value_key: str, corpus_key: str, value: str, text: str, size: int) -> DataFrame:
    v = char_grams(values, value_key, value, size).withColumnRenamed("at", "i")
    c = char_grams(corpus, corpus_key, text, size).withColumnRenamed("at", "j")
    met = v.join(c, "gram").select(value_key, corpus_key, "i", "j", (F.col("j") - F.col("i")).alias("diagonal"))
    w = Window.partitionBy(value_key, corpus_key, "diagonal").orderBy("i")
    runs = met.withColumn("run", F.col("i") - F.row_number().over(w)).groupBy(value_key, corpus_key, "diagonal", "run").agg(F.min("i").alias("at"), (F.count(F.lit(1)) + (size - 1)).alias("length"))
    return runs.select(value_key, corpus_key, (F.shiftleft("length", 32) - F.col("at")).alias("_rank"))


class _Texts:
    """Texts in a row as code points, with the hash, place and text of each window that lies within one."""

    def __init__(self, texts: list[str], size: int):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        n = max(len(self.codes) - size + 1, 0)
        h = np.zeros(n, np.uint64)
        for k in range(size if n else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.codes[k : k + n]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.at = np.flatnonzero(self.owner[:n] == self.owner[size - 1 : size - 1 + n])
        self.hash = h[self.at]


class _Search:
    """The longest runs that texts share with fixed values."""

    BITS = 22

    def __init__(self, values: list[str], size: int):
        self.size, self.values = size, _Texts(values, size)
        order = np.argsort(self.values.hash, kind="stable")
        self.hash, self.at = self.values.hash[order], self.values.at[order]
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self.hash >> np.uint64(64 - self.BITS)] = True

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, text, length << 32 - place) of the best run of each pair that has one."""
        c, v = _Texts(texts, self.size), self.values
        some = self.known[c.hash >> np.uint64(64 - self.BITS)]
        h, at = c.hash[some], c.at[some]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = high - low
        j = np.repeat(at, n)
        i = self.at[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(j))]
        same = np.ones(len(j), bool)  # equal hashes are no proof
        for k in range(self.size):
            same &= v.codes[i + k] == c.codes[j + k]
        i, j = i[same], j[same]
        if not len(i):
            return (np.empty(0, np.int64),) * 3
        m = len(v.codes) + 1
        key = np.sort((j - i + m) * m + i)
        i = key % m
        j = key // m - m + i
        pair = c.owner[j] * len(v.start) + v.owner[i]
        first = np.flatnonzero(np.r_[True, (np.diff(key) != 1) | (np.diff(pair) != 0)])
        length = np.diff(np.r_[first, len(key)]) + self.size - 1
        rank = (length << 32) - (i[first] - v.start[v.owner[i[first]]])
        pair = pair[first]
        order = np.argsort(pair, kind="stable")
        pair, rank = pair[order], rank[order]
        groups = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
        return pair[groups] % len(v.start), pair[groups] // len(v.start), np.maximum.reduceat(rank, groups)


def _scanned(values: DataFrame, corpus: DataFrame, value_key: str, corpus_key: str, size: int) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(values.schema[value_key].dataType)
    rows = values.collect()
    shared = values.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    schema = T.StructType([values.schema[value_key], corpus.schema[corpus_key], T.StructField("_rank", T.LongType())])

    def run(batches):
        keys, texts = shared.value
        search, keys = _Search(texts, size), pa.array(keys, kind)
        for batch in batches:
            found = [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in found])
            cuts = np.flatnonzero(np.diff(ends // SEARCHED_CHARS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True):
                value, at, rank = search.runs(found[a:b])
                if len(rank):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(value)), batch.column(0).take(pa.array(at + a)), pa.array(rank, pa.int64())], schema.names)

    return corpus.mapInArrow(run, schema)


def blocked_values(values: DataFrame, terms: list[str], value: str = "value") -> DataFrame:
    """Values that hold a blocked term, with the terms (J15). The list is a parameter and goes into the plan."""
    found = F.filter(F.array(*(F.lit(t) for t in terms if t)), lambda t: F.contains(F.col(value), t)) if any(terms) else F.array().cast("array<string>")
    return values.withColumn("blocked", found).where(F.size("blocked") > 0)


def outgoing_decision(values: DataFrame, overlaps: DataFrame, terms: list[str], key: str, value: str = "value") -> DataFrame:
    """key, allowed, reason: blocked by a term, by overlap with the corpus, or allowed."""
    blocked = blocked_values(values, terms, value).select(key, F.lit(True).alias("_term"))
    held = overlaps.groupBy(key).agg(F.max("length").alias("_length"))
    both = values.select(key).join(blocked, key, "left").join(held, key, "left")
    reason = F.when(F.col("_term"), "blocked term").when(F.col("_length").isNotNull(), "corpus overlap")
    return both.select(key, reason.isNull().alias("allowed"), reason.alias("reason"), F.col("_length").alias("overlap"))


def valid_parameter(value: Column) -> Column:
    """Whether an outgoing parameter may leave at all: short, one line, no local reference, no long CJK run (P10)."""
    return (F.length(value) <= 64) & ~value.rlike(r"[\r\n\t]") & ~F.lower(value).rlike(r"^(file:|/|\\|[a-z]:\\)") & ~value.rlike("[一-鿿]{21,}")
