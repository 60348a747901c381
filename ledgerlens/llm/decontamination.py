"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Items and texts are normalised to words: A-Z in lower case, words being runs of
digits, letters and non-ASCII characters. Each window of an item holds one of the item's aligned blocks of half its
length whole, so the automaton holds these blocks only, a few nodes for each word of the items. Each text is scanned
once; a block that is found is extended word by word along the item, and what reaches a window's length is a hit. Hits are mapped back to offsets
in the original.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, free_name, materialize, table

WINDOW = 10
#: Bytes of item text for one automaton, which takes some 40 times as much of a worker's memory; more items are searched in blocks.
BLOCK_BYTES = 16_000_000
#: Words from which an item is cut into parts that overlap by a window.
PART_WORDS = 10_000
#: Documents with a find that one broadcast may hold when blocks are put together.
MAX_BROADCAST_ROWS = 200_000

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Each byte after normalisation: word bytes stay, A-Z go to lower case, others part words.
_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
OUTPUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("word_spans", SPAN),
    T.StructField("spans", SPAN),
]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


#: A word's number is written with three digits, each with characters of its own, so matches can't begin inside a word.
_DIGITS = 3
_OTHER = chr(0x4FF) * _DIGITS


def _code(number: int) -> str:
    return chr(0x100 + number % 128) + chr(0x180 + number // 128 % 128) + chr(0x200 + number // 16384)


class Items:
    """The automaton over the blocks of item parts, and the words to extend a block along."""

    def __init__(self, parts: list[tuple[str | None, str]], window: int):
        number: dict[bytes, int] = {}
        blocks: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.ids, self.begins, held, at = [], [], [], 0
        self.needed: list[int] = []
        size = (window + 1) // 2
        for item_id, text in parts:
            words = [number.setdefault(w, len(number)) for w in words_of(text)]
            if not words:
                continue
            step = min(size, len(words))
            for k in range(0, len(words) - step + 1, step):
                blocks[tuple(words[k : k + step])].append(at + k)
                if len(words) < window:
                    break
            self.ids.append(item_id)
            self.begins.append(at)
            self.needed.append(min(window, len(words)))
            held += [*words, -2]  # no text has this number
            at += len(words) + 1
        self.words = np.array([-2, *held], np.int32)[1:]
        self.codes = {w: _code(k) for w, k in number.items()}
        self.numbers = number
        self.begins = np.array(self.begins, np.int64)
        self.places = [np.array(p, np.int64) for p in blocks.values()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for k, block in enumerate(blocks):
            self.machine.add_word("".join(map(_code, block)), (len(block), k))
        if blocks:
            self.machine.make_automaton()


def _equal(text: np.ndarray, items: np.ndarray, t: int, i: int, way: int) -> int:
    """Words that are equal from t in the text and i in the items on, forwards or backwards."""
    n, chunk = 0, 16
    while True:
        if way > 0:
            room = min(chunk, len(text) - t - n, len(items) - i - n)
            differ = text[t + n : t + n + room] != items[i + n : i + n + room]
        else:
            room = min(chunk, t + 1 - n, i + 1 - n)
            differ = (text[t + 1 - n - room : t + 1 - n] != items[i + 1 - n - room : i + 1 - n])[::-1]
        if room <= 0:
            return n
        if differ.any():
            return n + int(differ.argmax())
        n, chunk = n + room, chunk * 4


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(text: str | None, items: Items | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit runs as [first word, end word) and ids of the items found."""
    words = words_of(text)
    if items is None or not items.places or not words:
        return len(words), [], set()
    matches = list(items.machine.iter("".join(map(items.codes.get, words, repeat(_OTHER)))))
    if not matches:
        return len(words), [], set()
    numbers = np.fromiter(map(items.numbers.get, words, repeat(-1)), np.int32, len(words))
    runs, found = [], set()
    #: of each item place against text place the words that are compared already
    upto: dict[int, int] = {}
    for last, (size, block) in matches:
        end = (last + 1) // _DIGITS
        for place in items.places[block].tolist():
            shift = place - end + size
            if upto.get(shift, -1) >= end:
                continue
            left = _equal(numbers, items.words, end - size - 1, place - 1, -1)
            right = _equal(numbers, items.words, end, place + size, 1)
            upto[shift] = end + right
            item = int(np.searchsorted(items.begins, place, "right")) - 1
            if left + size + right >= items.needed[item]:
                runs.append((end - size - left, end + right))
                found.add(items.ids[item])
    return len(words), _merged(runs), found


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets of word runs in the text as it was."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, item_ids, word_spans and spans to each document.

    A word is hit if it lies in any occurrence of ``window`` consecutive words of an item, or of
    a whole item that has fewer. item_ids: sorted strings, and one NULL at the end for items without id. spans:
    merged hit runs as [start, end) code points of the original text. NULL and empty
    texts, and items without words, have no hits. Repeated rows are judged one by one;
    columns named like an output are replaced, others pass through.

    One scan, no shuffle, nothing written: the items reach the workers by broadcast, at most ``block_bytes`` of them. A larger benchmark is searched
    block by block, long items cut into parts that overlap; then only the finds, by the row's place, are written and joined, so ``docs`` should be one whose rows
    keep their places when read again, such as files.
    """
    docs = docs.drop(*(f.name for f in OUTPUT))
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(F.length("t") > 0)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return _scan(docs, _held(items), text, window)
    items = materialize(_parts(items, window, max(window, min(PART_WORDS, block_bytes // 20))).withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "items")
    row, found = free_name(docs, "_row"), free_name(docs, "_found")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    finds: DataFrame | None = None
    for b in range(blocks):
        block = _scan(numbered.select(row, text), _held(items.where(F.col("b") == b)), text, window).where("n_hit > 0").select(row, "item_ids", "word_spans")
        block = materialize(block, "finds")
        finds = block if finds is None else finds.unionAll(block)
    # a document has at most one find a block
    merged = finds.groupBy(row).agg(F.struct(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("ids"), F.flatten(F.collect_list("word_spans")).alias("spans")).alias(found))
    merged = materialize(merged, "finds")
    merged = F.broadcast(merged) if merged.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else merged

    def make():
        def of(value, known):
            runs = _merged([(r["start"], r["end"]) for r in known["spans"]]) if known else []
            return _cells(value, len(words_of(value)), runs, known["ids"] if known else [])

        return of

    return append_columns(numbered.join(merged, row, "left"), OUTPUT, make, [text, found]).drop(row, found)


def item_words(text: Column) -> Column:
    """The normalised words of a text as an array, by Spark's own functions."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _parts(items: DataFrame, window: int, words: int) -> DataFrame:
    """Items as parts of ``words`` words and what a window that begins in the part needs after it."""
    w = F.transform(F.array(item_words(F.col("t"))), lambda x: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(x) - 1, F.lit(words)), lambda i: (i == 0) | (i + window <= F.size(x))),
        lambda i: F.array_join(F.slice(x, i + 1, F.lit(words + window - 1)), " "),
    ))[0]
    return items.where(F.size(item_words(F.col("t"))) > 0).select("i", F.explode(w).alias("t"))


def _held(items: DataFrame) -> tuple[tuple[str | None, str], ...]:
    """One block of items; the order doesn't matter, so it's made the same."""
    return tuple(sorted({(r.i, r.t) for r in items.select("i", "t").toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or "", x[1])))


def _cells(value: str | None, n: int, runs: list[tuple[int, int]], ids) -> tuple:
    as_rows = [{"start": a, "end": b} for a, b in runs]
    spans = [{"start": a, "end": b} for a, b in original_spans(value, runs)] if runs else []
    return n, sum(b - a for a, b in runs), sorted(ids, key=lambda i: (i is None, i or "")), as_rows, spans


#: The last items that this worker has built.
_BUILT: dict[int, Items] = {}


def _built(key: int, parts: tuple[tuple[str | None, str], ...], window: int) -> Items:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(list(parts), window)
    return _BUILT[key]


def _scan(docs: DataFrame, items: tuple[tuple[str | None, str], ...], text: str, window: int) -> DataFrame:
    """Searches one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = hash((items, window))

    def make():
        built = _built(key, shared.value, window)
        return lambda value: _cells(value, *scan_text(value, built))

    return append_columns(docs, OUTPUT, make, [text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), k AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k
), occ AS (
  SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM pos) p JOIN win ON win.k = p.k AND win.s = p.s
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
