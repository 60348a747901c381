"""Packed token-id output: best-fit decreasing with a segment tree over free room."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import best_fit_counts
from .common import bounded_batches, table
from .encoders import default_vocabulary, encoder
from .packing import CAPACITY, Plan, cut_documents, place_pieces

SCHEMA = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens long, padding long, ids_crc32 long, ids binary"


def best_fit_plan(demand: np.ndarray, capacity: int) -> Plan:
    """The patterns of best-fit decreasing over so many pieces of each length."""
    return sorted(best_fit_counts(Counter({int(n): int(demand[n]) for n in np.flatnonzero(demand) if n}), capacity).items(), reverse=True)


def pack_ids(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, eos: int = 0, pad: int = 0) -> DataFrame:
    """One row for each sequence: a row of the id matrix and what its segments are.

    A document is the ids of its whole text (NULL: none) and ``eos``; one over the
    capacity is split at its multiples, each piece a segment of its own; a text may be of any length. ids: ``capacity``
    little-endian numbers (2 bytes if the vocabulary allows, else 4), ``pad`` after n_tokens.
    cu_seqlens: 0, then the end of each segment; position_resets: where position ids go
    back to 0; doc_ids and starts: the document of each segment and its ids before it.
    ids_crc32 is that of the n_tokens ids as 4-byte numbers. sequence_id counts from 0. An empty table gives no rows;
    repeated rows are packed as often as they occur; other columns are dropped.

    The lengths of the whole table are packed at once, as counts, so padding doesn't depend on files or
    partitions: pieces are written, ranked within their length where they are, and meet by sequence.
    One shuffle, of ids only. Not more than ``capacity`` pieces meet in a group.
    """
    width = "<u2" if encoder(vocabulary).size <= 1 << 16 else "<u4"
    pieces = cut_documents(docs, vocabulary, capacity, 1, eos, width).select("doc_id", "start", "ids", "class", "part", "nth")
    placed = place_pieces(pieces, best_fit_plan, capacity, 1)
    segment = F.struct("slot", "doc_id", "start", "ids")
    sequences = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64(), longs, longs, ints, ints, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows = []
            for sequence, segments in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = segments.as_py()
                parts = [np.frombuffer(s["ids"], width) for s in held]
                ends = np.cumsum([0, *map(len, parts)]).tolist()
                ids = np.full(capacity, pad, width)
                ids[: ends[-1]] = np.concatenate(parts)
                crc = zlib.crc32(ids[: ends[-1]].astype("<u4").tobytes())
                rows.append((sequence, [s["doc_id"] for s in held], [s["start"] for s in held], ends, ends[:-1], ends[-1], capacity - ends[-1], crc, ids.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    bounded_batches(docs.sparkSession)
    return sequences.mapInArrow(lay_out, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet files of matrix rows, compressed, as training jobs read them."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(rows: list, width: str = "<u2") -> np.ndarray:
    """The id matrix of some rows."""
    return np.stack([np.frombuffer(r["ids"], width) for r in rows]) if rows else np.empty((0, 0), width)


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """Positions from 0 in each segment."""
    out = np.arange(n_tokens)
    for a, b in zip(resets, [*resets[1:], n_tokens], strict=True):
        out[a:b] -= a
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_ids(table(spark, sf_dir, "documents"), default_vocabulary())
