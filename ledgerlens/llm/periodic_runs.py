"""Periodic runs of words, by Main and Lorentz's divide and conquer.

Words become numbers. The sequence is cut at midpoints, again and again. A run of exponent 4 or more that crosses a
midpoint has two whole periods on one side of it, so the Z-function that starts there (forwards over the right half, or
backwards over the left one) is at least p at offset p. Each such offset is extended both ways to the whole
stretch; equal stretches count once, with their smallest period.

All midpoints of a level are taken at once as arrays: the Z-values of all offsets grow word by word while any offset
still matches, and the few that match for more than DEPTH words are extended by comparing slices of doubling length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

#: What makes a stretch a run: this many periods at least, and this many words.
EXPONENT = 4
LEAST_WORDS = 6
#: Words up to which the Z-values of all offsets grow together.
DEPTH = 8
#: Words that are searched as one sequence; a longer text is one by itself.
BATCH_WORDS = 200_000

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
OUTPUT = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]

Fold = Callable[[object, list[bytes]], list[bytes]]


def _z_candidates(w: np.ndarray, mids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(midpoint, offset p) with a Z-value of p or more, for offsets up to ``most``; of offsets over DEPTH those with DEPTH or more."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // most)
    for k in range(0, len(mids), step):
        part = mids[k : k + step]
        # z >= 1
        at, p = np.nonzero(w[part[:, None] + np.arange(1, most + 1)] == w[part][:, None])
        m, p = part[at], p + 1
        for depth in range(1, DEPTH):
            whole = p <= depth
            found.append((m[whole], p[whole]))
            m, p = m[~whole], p[~whole]
            same = w[m + depth] == w[m + depth + p]
            m, p = m[same], p[same]
        found.append((m, p))
    return np.concatenate([m for m, _ in found]), np.concatenate([p for _, p in found])


def _matching(w: np.ndarray, i: int, j: int, way: int) -> int:
    """Words that are equal from i and j > i on, forwards (way 1) or backwards (way -1)."""
    n, chunk = 0, 16
    while True:
        if way > 0:
            room = min(chunk, len(w) - j - n)
            a, b = w[i + n : i + n + room], w[j + n : j + n + room]
        else:
            room = min(chunk, i + 1 - n)
            a, b = w[i + 1 - n - room : i + 1 - n][::-1], w[j + 1 - n - room : j + 1 - n][::-1]
        if not room:
            return n
        other = a != b
        first = int(other.argmax())
        if other[first]:
            return n + first
        n, chunk = n + room, chunk * 2


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal stretch of EXPONENT periods and LEAST_WORDS words or more.

    ``longest``: words that no run exceeds, where it's known. Time is about n log n for texts with few repeats.
    """
    n = len(words)
    longest = n if longest is None else longest
    if longest < LEAST_WORDS:
        return []
    size = 8
    while size < n:
        size *= 2
    # numbers that occur once stand behind the end, so no comparison needs a bound
    w = np.concatenate([words.astype(np.int64), np.arange(-1, -1 - (2 * size - n), -1) + min(0, int(words.min(initial=0)))])
    back = np.concatenate([w[:size][::-1], w[size:]])
    runs: dict[tuple[int, int], int] = {}
    # the run that covers each word: of those found so far the longest
    start_of, end_of, period_of = (np.zeros(n + 1, np.int64) for _ in range(3))
    while size >= 8:
        mids = np.arange(size // 2, n + size, size)
        most = min(size // EXPONENT, longest // EXPONENT)
        if most:
            right = _z_candidates(w, mids[mids < n], most)
            left = _z_candidates(back, len(back) // 2 - mids[(mids > 0) & (mids <= len(back) // 2)], most)
            # (first word of a square, period)
            at = np.concatenate([right[0], len(back) // 2 - left[0] - 2 * left[1]])
            p = np.concatenate([right[1], left[1]])
            ok = (at >= 0) & (at + 2 * p <= n)
            at, p = at[ok], p[ok]
            q = period_of[at]
            known = (q > 0) & (at >= start_of[at]) & (at + 2 * p <= end_of[at]) & (p % np.maximum(q, 1) == 0)
            at, p = at[~known], p[~known]
            order = np.lexsort((at, p))
            seen: dict[int, int] = {}
            for a, d in zip(at[order].tolist(), p[order].tolist(), strict=True):
                if seen.get(d, -1) >= a + 2 * d or (period_of[a] and start_of[a] <= a and a + 2 * d <= end_of[a] and d % period_of[a] == 0):
                    continue
                start = a - _matching(w, a - 1, a - 1 + d, -1)
                end = a + d + _matching(w, a, a + d, 1)
                seen[d] = end
                if end - start >= max(LEAST_WORDS, EXPONENT * d):
                    key = (start, end - start)
                    runs[key] = min(d, runs.get(key, d))
                    shorter = slice(start, end)
                    if (end_of[shorter] - start_of[shorter] < end - start).all():
                        start_of[shorter], end_of[shorter], period_of[shorter] = start, end, d
        size //= 2
    return sorted((s, length, d) for (s, length), d in runs.items())


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each word list; all are searched as one sequence, parted by numbers that occur once."""
    number: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for k, words in enumerate(texts):
        begins.append(at)
        parts.append(np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words)))
        parts.append(np.array([-1 - k], np.int64))
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    found = find_runs(np.concatenate(parts), max(map(len, texts)))
    which = np.searchsorted(begins, [s for s, _, _ in found], "right") - 1
    for k, (s, length, p) in zip(which.tolist(), found, strict=True):
        out[k].append((s - begins[k], length, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that any run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        gone[s + p] += 1
        gone[s + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def mark_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fold: Fold | None = None) -> DataFrame:
    r"""Adds n_words, runs (start, length, period; by start, then period) and collapsed to each row.

    Words are the runs ``[^\x20\x09-\x0D]+`` of the whole text, numbered from 0. A run is a stretch of words with smallest period p
    that holds EXPONENT periods and LEAST_WORDS words or more and can't be longer with that period. collapsed: the words that no
    run holds after its first period, joined by one space. ``fold`` may change a row's words beforehand, given its id
    (None where it is NULL). NULL, empty and blank texts have no words, no runs and an empty collapsed text. Rows are
    handled one by one, repeated ones alike; columns named like an output are replaced, others pass through.

    One scan, no shuffle. A worker holds one Arrow batch and BATCH_WORDS words, or one text that is longer.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    out = {f.name for f in OUTPUT}
    kept = [i for i, c in enumerate(docs.columns) if c not in out]
    id_at, text_at = docs.columns.index(doc_id), docs.columns.index(text)
    schema = T.StructType([docs.schema[i] for i in kept] + OUTPUT)
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in OUTPUT]

    def run(batches):
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            texts = [(x or "").encode().split() for x in batch.column(text_at).to_pylist()]
            if fold:
                texts = [fold(i, words) for i, words in zip(batch.column(id_at).to_pylist(), texts, strict=True)]
            runs: list = []
            first = 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (last == first or held + len(texts[last]) <= BATCH_WORDS):
                    held += len(texts[last])
                    last += 1
                runs += runs_of_texts(texts[first:last])
                first = last
            added = [
                pa.array([len(x) for x in texts], kinds[0]),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kinds[1]),
                pa.array([b" ".join(collapse(x, r)).decode() for x, r in zip(texts, runs, strict=True)], kinds[2]),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *added], names)

    return docs.mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, for one document in ten by the checksum of its id; a document without id has none."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), fold=planted).drop("text")
    # greatest length first; then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
