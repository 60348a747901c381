"""Packing by cutting-stock column generation.

Lengths fall into size classes of ``grain`` tokens, so the linear program has a row
for each class, however many documents there are. Its columns are patterns: how
many pieces of each class one sequence holds. A knapsack dynamic program prices
columns, from nothing but one-class patterns on; the pattern counts are rounded down and what they leave, a
few pieces for each pattern, is packed best fit decreasing, still as counts. Every piece is ranked within its class, by the task that cut it, and its rank
tells its pattern, sequence and slot. Only the histogram (capacity / grain numbers)
and the patterns reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .best_fit import best_fit_counts
from .common import bounded_batches, materialize, table
from .encoders import default_vocabulary, encoder

CAPACITY = 1024
GRAIN = 4
#: Sums of parts and classes that are sent to all tasks; of more the pieces meet them by shuffle.
MAX_BASES = 1_000_000


# ---- the plan, on the driver -------------------------------------------------


def price_pattern(values: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """Best value of an unbounded knapsack: class c (1-based) weighs c and is worth values[c]."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        worth = values[1 : w + 1] + best[w - 1 :: -1][:w]
        k = int(np.argmax(worth))
        if worth[k] > best[w - 1] + 1e-12:
            best[w], choice[w] = worth[k], k + 1
        else:
            best[w] = best[w - 1]
    pattern, w = Counter(), capacity
    while w > 0:
        if choice[w]:
            pattern[int(choice[w])] += 1
            w -= int(choice[w])
        else:
            w -= 1
    return float(best[capacity]), pattern


def _inverse(m: np.ndarray) -> np.ndarray:
    """By elimination with row exchange; LAPACK's threads can stand still in a process that has started a JVM."""
    n = len(m)
    both = np.hstack([m, np.eye(n)])
    for k in range(n):
        at = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0.0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = 5e-4, max_pivots: int = 200_000) -> list[tuple[Counter, float]]:
    """Column generation for min sum x, patterns @ x >= demand: (pattern, x) of the last basis.

    Revised simplex from the basis of one-class patterns. When none of the patterns priced so far improves the
    plan, the knapsack prices a new one. It ends when the larger of Farley's bound and the
    material bound shows the plan within ``gap`` of the optimum. Neither the rows nor the
    pivots needed grow with the number of pieces.
    """
    classes = np.array([c for c in np.flatnonzero(demand) if c], np.int64)
    if not len(classes):
        return []
    # shares of a piece more, another for each class, so that no pivot stands still
    d = demand[classes] + 0.05 * (np.arange(1, len(classes) + 1) * 0.6180339887 % 1.0)
    bound = float(d @ classes) / capacity
    priced: list[Counter] = []
    columns = np.zeros((1024, len(classes)))
    basis = [Counter({c: capacity // c}) for c in classes.tolist()]
    inverse = np.diag(1.0 / (capacity // classes))
    x = inverse @ d
    values = np.full(capacity + 1, -1.0)
    for pivot in range(max_pivots):
        if pivot % 4096 == 4095:  # what rounding errors have added goes
            inverse = _inverse(np.array([[p[c] for p in basis] for c in classes.tolist()], float))
            x = np.maximum(inverse @ d, 0.0)
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        worths = columns[: len(priced)] @ duals
        k = int(np.argmax(worths)) if priced else -1
        if k < 0 or worths[k] <= 1 + 1e-6:
            values[classes] = duals
            worth, pattern = price_pattern(values, capacity)
            bound = max(bound, float(duals @ d) / max(worth, 1.0))
            if worth <= 1 + 1e-6 or x.sum() - bound <= gap * x.sum():
                break
            k = len(priced)
            if k == len(columns):
                columns = np.vstack([columns, np.zeros_like(columns)])
            columns[k] = [pattern[c] for c in classes.tolist()]
            priced.append(pattern)
        step = inverse @ columns[k]
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1.0), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0.0)
        x[out] = theta
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0.0
        inverse -= np.outer(others, inverse[out])
        basis[out] = priced[k]
    return list(zip(basis, x, strict=True))


#: Classes of one sequence, falling, and the number of such sequences.
Plan = list[tuple[tuple[int, ...], int]]


def plan_sequences(demand: np.ndarray, capacity: int) -> Plan:
    """(classes of one sequence, number of such sequences); serves the demand exactly.

    Where rounding up would serve more than is there, the surplus slots are given up.
    """
    left = Counter({int(c): int(demand[c]) for c in np.flatnonzero(demand) if c})
    plan: Plan = []
    for pattern, x in sorted(solve_patterns(demand, capacity), key=lambda p: sorted(p[0].items(), reverse=True)):
        n = min([int(x + 1e-6), *(left[c] // k for c, k in pattern.items())])
        if n > 0:
            plan.append((tuple(sorted(pattern.elements(), reverse=True)), n))
            for c, k in pattern.items():
                left[c] -= n * k
    plan += sorted(best_fit_counts(+left, capacity).items(), reverse=True)
    return plan


def slot_rows(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces of the class in a sequence, first slot)."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for classes, n in plan:
        slot = 0
        for c, k in sorted(Counter(classes).items(), reverse=True):
            rows.append((c, taken[c], taken[c] + n * k, sequence, k, slot))
            taken[c] += n * k
            slot += k
        sequence += n
    return rows


# ---- over a table ------------------------------------------------------------


def number_pieces(pieces: DataFrame, length: str, capacity: int, grain: int) -> DataFrame:
    """row (all columns of ``pieces``), n (its length), class, part and nth of each piece, as a written table.

    nth counts a task's pieces of a class, part is the task. Columns go along as one, so they may have any names.
    """
    size = F.col(f"`{length}`")
    usable = F.when(size.between(1, capacity), size).otherwise(F.raise_error(F.lit("length outside 1 to capacity")))
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row"), usable.cast("long").alias("n"))
    schema = T.StructType([*rows.schema, *(T.StructField(c, T.LongType()) for c in ("class", "part", "nth"))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Numbers(grain)
        for batch in batches:
            added = [pa.array(c, pa.int64()) for c in zip(*map(count, batch.column(1).to_pylist()), strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    bounded_batches(pieces.sparkSession)
    return materialize(rows.mapInArrow(number, schema), "numbered")


class _Numbers:
    """(class, part, nth) of the lengths that a task meets."""

    def __init__(self, grain: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.grain, self.part, self.seen = grain, context.partitionId() if context else 0, Counter()

    def __call__(self, length: int) -> tuple[int, int, int]:
        cls = -(-length // self.grain)
        nth = self.seen[cls]
        self.seen[cls] += 1
        return cls, self.part, nth


def place_pieces(numbered: DataFrame, plan: Callable[[np.ndarray, int], Plan], capacity: int, grain: int) -> DataFrame:
    """The columns of ``numbered`` but class, part and nth, and sequence_id and slot of each piece.

    ``plan`` makes the patterns from the number of pieces of each class. A piece's rank in its class is its number in its part and the
    pieces in the parts before. These sums are sent to all tasks if a count shows that they are few, so that pieces
    stay where they are; else each part's pieces of a class meet them by shuffle, no more than a task wrote.
    """
    spark = numbered.sparkSession
    units = -(-capacity // grain)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("class", "part").agg(F.count(F.lit(1)).alias("times"))
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("times").over(before), F.lit(0))), "bases")
    demand = np.zeros(units + 1, np.int64)
    for c, n in bases.groupBy("class").agg(F.sum("times")).collect():  # a row for each class
        demand[c] = n
    # (class, first rank) tells the pattern: a few thousand rows, whatever the number of pieces
    slots = np.array(slot_rows(plan(demand, units)), np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    few = bases.count() <= MAX_BASES
    sums = bases.select("class", "part", "base").toArrow() if few else None
    held = None if sums is None else np.column_stack([sums.column(k).to_numpy() for k in range(3)]).astype(np.int64)
    held = None if held is None else held[np.lexsort((held[:, 1], held[:, 0]))]
    shared = spark.sparkContext.broadcast((slots, held))
    if not few:
        numbered = numbered.join(bases.drop("times"), ["class", "part"])
        numbered = numbered.withColumn("nth", F.col("nth") + F.col("base")).drop("base")
    own = [c for c in numbered.columns if c not in ("class", "part", "nth")]
    at = len(own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value
        first_ranks = known[:, 0] << 44 | known[:, 1]
        for batch in batches:
            cls, part, rank = (batch.column(at + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            if sums is not None:
                rank = rank + sums[np.searchsorted(sums[:, 0] << 40 | sums[:, 1], cls << 40 | part), 2]
            _, first, _, sequence, each, slot = known[np.searchsorted(first_ranks, cls << 44 | rank, "right") - 1].T
            in_pattern = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sequence + in_pattern // each), pa.array(slot + in_pattern % each)], [*own, "sequence_id", "slot"])

    bounded_batches(spark)
    schema = T.StructType([*(numbered.schema[c] for c in own), T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    return numbered.select(*own, "class", "part", "nth").mapInArrow(place, schema)


def _with_offsets(placed: DataFrame, length: str) -> DataFrame:
    before_slot = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length).over(before_slot), F.lit(0)).cast("long"))


def pack_lengths(pieces: DataFrame, length: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id, slot and offset (all long) to each row of ``pieces``.

    ``length`` holds 1 to ``capacity``; other values raise. An empty table gives an empty result. Columns named
    sequence_id, slot or offset are replaced, others pass through, whatever their names.
    """
    numbered = number_pieces(pieces.drop("sequence_id", "slot", "offset"), length, capacity, grain)
    return _with_offsets(place_pieces(numbered, plan_sequences, capacity, grain), "n").select("row.*", "sequence_id", "slot", "offset")


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, grain: int = GRAIN, eos: int = 0, width: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens, class, part, nth[, ids], as a written table.

    A document is the ids of its whole text, then ``eos``; a NULL or empty text is the
    end alone; a text may be of any length. Each id is in exactly one piece; only documents over the capacity are cut,
    at its multiples. class, part and nth are those of `number_pieces`. ids, with a ``width`` such as "<u2": numbers
    of that many bytes; the digest is of 4-byte ones. Other columns are dropped.
    """
    kinds = {c: pa.int64() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "nth")}
    if width:
        kinds["ids"] = pa.binary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, number = encoder(vocabulary).ids, _Numbers(grain)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py()), np.uint32(eos)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *number(len(piece)), *((piece.astype(width).tobytes(),) if width else ())))
                    if len(out) >= 4096:
                        yield _batch(out, kinds)
                        out = []
            if out:
                yield _batch(out, kinds)

    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in kinds)
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema), "pieces")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Every id of every document in one sequence of at most ``capacity`` ids, with little padding.

    One scan tokenises and writes the pieces' digests;
    all that follows works on those small rows. Repeated rows are packed as often as they
    occur; a NULL doc_id is kept; an empty table gives no rows; other columns are dropped.
    """
    return _with_offsets(place_pieces(cut_documents(docs, vocabulary, capacity, grain), plan_sequences, capacity, grain), "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot")
