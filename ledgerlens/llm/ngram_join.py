"""N-gram Jaccard join by vertical partitioning.

The global n-gram order (by document frequency, then 64-bit hash) is cut into hash
ranges, the fragments. Each block of documents sends each fragment its part of the
block's n-grams; a fragment counts frequencies and answers each block which of its n-grams
other documents share. A document can only have a link if at least the similarity's share of
its n-grams is shared, and two linked documents share one of the rarest n-grams of each
(prefix filter); the rest never travels again. The overlap of a candidate pair is counted
fragment by fragment and summed.

Only components are asked for, so not all pairs of a group are compared: each list of
documents with a common rare n-gram is first compared with a few leaders; then, for
exactness, each document outside its list's most common component is compared with all
documents of other components in that list. Lists leave out pairs that the places of the
common n-gram in the two orders show to share too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_spread, materialize, table
from .components import connected_components

NGRAM = 5
#: Similarity in percent.
PERCENT = 75
BLOCK_DOCS = 4096
BLOCK_GRAMS = 500_000
#: N-grams that one fragment holds, about; a fragment is one group of one task.
FRAGMENT_GRAMS = 1_000_000
#: From so many documents of a block on, a common n-gram is sent once with its count.
LOCAL_HOT = 16
HOT_MARK = 0xFFFF
#: Fragments by which the overlap of a pair is counted: ranges of the hash's top bits.
PAIR_FRAGMENT_BITS = 3
#: Bits of the hash that tell the fragment, at least and at most.
LEAST_BITS, MOST_BITS = 5, 20
LEADERS = 4
LEADER_ROUNDS = 2
#: Members of a list that one row of the last step holds.
LIST_PART = 4096
#: Step between size bands of a list.
BAND = 1.1

_U = np.uint64
#: Multipliers of the word positions, from the golden ratio's steps; all odd.
_STEPS = np.array([(k * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, NGRAM + 1)], _U)


class _Words(dict):
    """Hash of each word, kept for so many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def gram_hashes(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; a shorter text is one gram, an empty one has none."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, _U)
    a = np.fromiter(map(words.__getitem__, w), _U, len(w))
    n = len(a) - NGRAM + 1
    if n < 1:
        return _mix((a * _STEPS[: len(a)]).sum(keepdims=True) + _U(len(a)))
    h = a[:n] * _STEPS[0]
    for k in range(1, NGRAM):
        h += a[k : k + n] * _STEPS[k]
    return np.unique(_mix(h))


_WIRE = "block long, fragment long, lo binary, hi binary, idx binary, n binary, doc_id array<long>, key binary"
_NAMES = [f.split()[0] for f in _WIRE.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]


def _wire(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _low(bits: int) -> int:
    """Bits of a hash that go with an n-gram besides its fragment's: 48 as far as there are so many."""
    return min(48, 64 - bits)


def _pack(h: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """The bits below a fragment's top bits, as 4 and 2 bytes."""
    low = h >> _U(64 - _low(bits) - bits)
    low &= _U((1 << _low(bits)) - 1)
    return low.astype("<u4").tobytes(), ((low >> _U(32)) & _U(0xFFFF)).astype("<u2").tobytes()


def _unpack(lo: bytes, hi: bytes, fragment: int, bits: int) -> np.ndarray:
    """Fingerprints: the fragment, then the low bits."""
    return np.frombuffer(lo, "<u4").astype(_U) | np.frombuffer(hi, "<u2").astype(_U) << _U(32) | _U(fragment << _low(bits))


def _block_rows(block: int, docs: list[tuple[int | None, np.ndarray]], bits: int) -> list[tuple]:
    """What a block sends: a row for each fragment it has n-grams of, and one about its documents.

    Of documents with equal sets only the first sends its n-grams.
    """
    keys = [xxhash.xxh3_128_digest(h.tobytes()) for _, h in docs]
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    senders = [i for i, k in enumerate(keys) if first[k] == i]
    grams = np.concatenate([docs[i][1] for i in senders]) if senders else np.empty(0, _U)
    idx = np.repeat(np.array(senders, "<u2"), [len(docs[i][1]) for i in senders])
    order = np.argsort(grams, kind="stable")
    grams, idx = grams[order], idx[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(grams)])
    hot = np.repeat(counts >= LOCAL_HOT, counts)
    hot_starts, hot_counts = starts[counts >= LOCAL_HOT], counts[counts >= LOCAL_HOT]

    sent = np.concatenate([grams[~hot], grams[hot_starts]])
    sent_idx = np.concatenate([idx[~hot], np.full(len(hot_starts), HOT_MARK, "<u2")])
    weight = np.concatenate([np.ones(int((~hot).sum()), "<u2"), hot_counts.astype("<u2")])
    fragment = (sent >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(fragment, kind="stable")
    sent, sent_idx, weight, fragment = sent[order], sent_idx[order], weight[order], fragment[order]
    cuts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]]).tolist() if len(sent) else []
    rows: list[tuple] = []
    for a, b in zip(cuts, [*cuts[1:], len(sent)], strict=False):
        marked = sent_idx[a:b] == HOT_MARK
        rows.append((block, int(fragment[a]), *_pack(sent[a:b], bits), sent_idx[a:b].tobytes(), weight[a:b][marked].tobytes(), None, None))
    sizes = np.array([len(h) for _, h in docs], "<u4").tobytes()
    lo, hi = grams[hot_starts].astype("<u8").tobytes(), hot_counts.astype("<u2").tobytes()
    rows.append((block, -1 - block, lo, hi, idx[hot].tobytes(), sizes, [d for d, _ in docs], b"".join(keys)))
    return rows


def send_grams(docs: DataFrame, bits: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        words, held, n_held = _Words(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = gram_hashes(text.as_py(), words)
                held.append((doc_id, h))
                n_held += len(h)
                if len(held) >= BLOCK_DOCS or n_held >= BLOCK_GRAMS:
                    yield _wire(_block_rows(block, held, bits))
                    block, held, n_held = block + 1, [], 0
        if held:
            yield _wire(_block_rows(block, held, bits))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(send, _WIRE)


def _answer(bits: int):
    """One fragment: which n-grams two or more documents have, and how many; goes back to each block."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows or rows[0]["fragment"] < 0:
            return table
        fragment = rows[0]["fragment"]
        grams = [_unpack(r["lo"], r["hi"], fragment, bits) for r in rows]
        idx = [np.frombuffer(r["idx"], "<u2") for r in rows]
        every = np.concatenate(grams)
        weight = np.ones(len(every), np.int64)
        weight[np.concatenate(idx) == HOT_MARK] = np.frombuffer(b"".join(r["n"] for r in rows), "<u2")
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        total = np.add.reduceat(weight[order], starts) if len(starts) else np.empty(0, np.int64)
        df = np.empty(len(every), np.int64)
        df[order] = np.repeat(total, np.diff(np.r_[starts, len(ranked)]))
        out, a = [], 0
        for r, g, i in zip(rows, grams, idx, strict=True):
            shared = df[a : a + len(g)] > 1
            if shared.any():
                out.append((r["block"], fragment, g[shared].astype("<u8").tobytes(), None, i[shared].tobytes(), np.minimum(df[a : a + len(g)][shared], 0xFFFFFFFF).astype("<u4").tobytes(), None, None))
            a += len(g)
        return pa.Table.from_batches([_wire(out)])

    return answer


_DOCS = "rid long, doc_id long, n long, key binary, shared long, prefix array<long>, segments array<array<long>>"


def _gather(bits: int):
    """One block: the documents, and of those that can have a link the rare and the shared n-grams."""

    def gather(table: pa.Table) -> pa.Table:
        grams, idx, dfs = [np.empty(0, _U)], [np.empty(0, "<u2")], [np.empty(0, "<u4")]
        about = None
        for r in table.to_pylist():
            if r["fragment"] < 0:
                about = r
            else:
                grams.append(np.frombuffer(r["lo"], "<u8"))
                idx.append(np.frombuffer(r["idx"], "<u2"))
                dfs.append(np.frombuffer(r["n"], "<u4"))
        gram, at, df = np.concatenate(grams), np.concatenate(idx), np.concatenate(dfs)
        marked = at == HOT_MARK
        if marked.any():  # n-grams that were sent once: put back to each of their documents
            hot = np.frombuffer(about["lo"], "<u8") >> _U(64 - _low(bits) - bits)
            counts = np.frombuffer(about["hi"], "<u2")
            known = np.argsort(gram[marked])
            where = known[np.searchsorted(gram[marked][known], hot)]
            gram = np.concatenate([gram[~marked], np.repeat(hot, counts)])
            at = np.concatenate([at[~marked], np.frombuffer(about["idx"], "<u2")])
            df = np.concatenate([df[~marked], np.repeat(df[marked][where], counts)])
        sizes = np.frombuffer(about["n"], "<u4").astype(np.int64)
        order = np.lexsort((gram, df, at))
        gram, at = gram[order], at[order]
        ends = np.searchsorted(at, np.arange(len(sizes) + 1, dtype=np.int64))
        rows = []
        for i, (doc_id, n) in enumerate(zip(about["doc_id"], sizes.tolist(), strict=True)):
            shared, least = gram[ends[i] : ends[i + 1]], -(-PERCENT * n // 100)
            prefix = segments = None
            if n and len(shared) >= least:
                # the rarest n - least + 1; those that nobody shares come first and find nobody
                prefix = shared[: max(0, len(shared) - least + 1)].astype(np.int64).tolist()
                part = (shared >> _U(_low(bits) + bits - PAIR_FRAGMENT_BITS)).astype(np.int64)
                segments = [shared[part == f].astype(np.int64).tolist() for f in range(1 << PAIR_FRAGMENT_BITS)]
            rows.append((about["block"] << 16 | i, doc_id, n, about["key"][16 * i : 16 * i + 16], len(shared), prefix or None, segments if prefix else None))
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), longs, pa.list_(longs)]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _DOCS.split(", ")])

    return gather


def gram_table(docs: DataFrame) -> DataFrame:
    """_DOCS for each row of ``docs``; written, so that rid stays as it is."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, int(np.ceil(np.log2(max(1, total / 6 / FRAGMENT_GRAMS))))))
    answered = send_grams(docs, bits).groupBy("fragment").applyInArrow(_answer(bits), _WIRE)
    return materialize(answered.groupBy("block").applyInArrow(_gather(bits), _DOCS), "grams")


def _can_link(n: Column, rest: Column, m: Column, other_rest: Column) -> Column:
    """Whether sets of n and m n-grams can link if the first they share has so many from it on in each.

    Of a pair that links, the list of its first common n-gram passes; it is met there.
    """
    return (100 + PERCENT) * F.least(rest, other_rest) >= PERCENT * (n + m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link: overlaps counted by fragment, then summed."""
    side = lambda p: sets.select(F.col("rid").alias(p), F.col("n").alias(f"n{p}"), F.col("segments").alias(f"s{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    by_fragment = F.zip_with("sa", "sb", lambda x, y: F.size(F.array_intersect(x, y)))
    both = both.select("a", "b", "na", "nb", F.aggregate(by_fragment, F.lit(0), lambda s, x: s + x).cast("long").alias("o"))
    return both.where(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _met(near: DataFrame, others: str, *group: str) -> DataFrame:
    """Distinct (a, b) of each rid and those of its array ``others`` of another component that it can link with."""
    fit = F.filter(others, lambda x: (x["component"] != F.col("component")) & _can_link(F.col("n"), F.col("rest"), x["n"], x["rest"]))
    met = near.select("rid", *group, F.transform(fit, lambda x: x["rid"]).alias("ys")).where(F.size("ys") > 0)
    met = met.groupBy("rid", *group).agg(F.array_distinct(F.flatten(F.collect_set("ys"))).alias("ys"))
    return met.select("rid", F.explode("ys").alias("y")).select(F.least("rid", "y").alias("a"), F.greatest("rid", "y").alias("b")).distinct()


def _leader_pairs(lists: DataFrame, round_: int) -> DataFrame:
    """Each list's members against LEADERS of them.

    Half are those with the most n-grams left from the common one on: the least changed of a group
    of near copies, with the most links. The others are the least by a hash.
    """
    def leader(k: int) -> Column:
        h = F.xxhash64(F.lit(round_ * LEADERS + k), "rid")
        first = [(-F.col("rest")).alias("by")] if k % 2 == 0 else [F.lit(0).cast("long").alias("by")]
        return F.min(F.struct(*first, h.alias("h"), "rid", "n", "rest", "component")).alias(f"l{k}")

    leaders = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), *map(leader, range(LEADERS))).where("c > 1")
    leaders = materialize(leaders.select("gram", "c", F.array(*(F.col(f"l{k}") for k in range(LEADERS))).alias("ls")), "leaders")
    return _met(join_spread(lists, leaders, "gram", "c"), "ls")


def _band(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / float(np.log(BAND))).cast("int")


def _remaining_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of different components that a list lets link, each by an end outside the list's most common component.

    A member looks for others only in the bands of sizes that its place in the list lets it link with; where much of a set comes
    before the common n-gram, as in pages of one template with text of their own, these are empty. A long list
    is held in parts, and each member meets each part in a task of its own.
    """
    counts = lists.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m"))
    about = counts.groupBy("gram").agg(F.sum("m").alias("c"), F.max(F.struct("m", "component"))["component"].alias("top"), F.count(F.lit(1)).alias("kinds"))
    about = materialize(about.where("kinds > 1").select("gram", "c", "top", F.ceil(F.col("c") / LIST_PART).cast("int").alias("parts")), "mixed")
    most = F.least(F.floor((100 + PERCENT) * F.col("rest") / PERCENT) - F.col("n"), F.floor(100 * F.col("n") / PERCENT))
    mixed = materialize(join_spread(lists, about, "gram", "c").withColumn("most", most).where(F.col("most") >= F.floor(PERCENT * F.col("n") / 100)), "mixed")
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    held = mixed.groupBy("gram", _band(F.col("n")).alias("band"), part.alias("part")).agg(F.collect_list(F.struct("rid", "n", "rest", "component")).alias("others"))
    outside = mixed.where("component <> top").withColumn("band", F.explode(F.sequence(_band(F.floor(PERCENT * F.col("n") / 100)), _band(F.col("most")))))
    outside = outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("gram", "band", "part", "rid", "n", "rest", "component")
    return _met(outside.join(held, ["gram", "band", "part"]), "others", "band", "part")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("component", F.col("rid"))
    return nodes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id of each row of ``docs``.

    Words are the runs ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set is its
    distinct 5-word shingles, or all its words as one if fewer. Sets link at a Jaccard
    similarity of PERCENT or more; component_id is the least doc_id reachable, its own if
    none. NULL, empty and blank texts have size 0 and link with nothing. Repeated rows
    link with each other; a NULL doc_id is carried and never a component's name. Other columns
    are dropped. Shingles are compared by 64-bit hash, of which the first 53 bits decide, in large tables all 64.
    """
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


def gram_key(text: str | None, words: _Words) -> bytes:
    """What texts of equal sets have in common; linked_rows has it of each row."""
    return xxhash.xxh3_128_digest(gram_hashes(text, words).tobytes())


def linked_rows(docs: DataFrame) -> DataFrame:
    """link_components with the key of each row's set, and whether it is the one that stays of the component.

    That is the least doc_id, and of its rows the least key: a doc_id may have rows of several components.
    """
    grams = gram_table(docs)
    # of equal sets one document stands for all
    classes = grams.where("n > 0").groupBy("key").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least_doc"))
    classes = materialize(classes, "classes")
    sets = grams.where(F.col("prefix").isNotNull()).join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    sets = materialize(sets.select("rid", "n", "shared", "prefix", "segments"), "sets")
    rows = sets.select("rid", "n", "shared", F.posexplode("prefix").alias("at", "gram")).withColumn("rest", F.col("shared") - F.col("at")).drop("shared", "at")
    shared = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    rows = materialize(join_spread(rows, shared, "gram", "c"), "lists")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    for step in range(LEADER_ROUNDS + 1):
        lists = _labelled(rows, labels)
        pairs = _leader_pairs(lists, step) if step < LEADER_ROUNDS else _remaining_pairs(lists)
        found = materialize(verified(pairs, sets), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionAll(found)
        labels = materialize(connected_components(links), "components")

    if labels is None:
        named = classes.select("key", F.col("least_doc").alias("component_id"), F.col("key").alias("first_key"))
    else:
        placed = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        first = F.min(F.when(F.col("least_doc").isNotNull(), F.struct("least_doc", "key"))).alias("first")
        placed = materialize(placed.select("key", "component", "least_doc"), "placed")
        names = placed.groupBy("component").agg(first, F.count(F.lit(1)).alias("c"))
        names = materialize(names.select("component", "c", F.col("first.least_doc").alias("component_id"), F.col("first.key").alias("first_key")), "names")
        named = join_spread(placed, names, "component", "c").select("key", "component_id", "first_key")
    found = grams.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    worded = F.col("n_shingles") > 0
    stays = ~worded | F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("first_key")), F.lit(False))
    return found.select("doc_id", "n_shingles", F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", stays.alias("stays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL; it pairs all documents with a common shingle, so it is for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
