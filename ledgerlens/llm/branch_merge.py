"""Three-way merge of two branches of a table of texts, with Arrow kernels.

A branch gives each row, column and line a code: the number of an edit in a short list. What two codes make of a line is a
table of all pairs of edits, so merging is looking up: the line lists of a batch are flattened, each line's pair of
codes is taken from the table, outcomes are counted by parent row, and what stays is put into new lists and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table


@dataclass(frozen=True)
class Edit:
    """What a code does. A line or column: ``drop`` it (a column becomes empty), ``append`` to it, ``insert`` a line after it.

    A row: ``drop`` it, or ``insert`` a row with this text beside it.
    """

    drop: bool = False
    append: str = ""
    insert: str | None = None


@dataclass(frozen=True)
class Branch:
    """Columns that give a branch's codes: of the row, of each merged column, and an array with one for each line. NULL is no edit."""

    row: Column
    columns: dict[str, Column]
    lines: Column


COUNTS = ["n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = range(4)


def _outcome(left, right, none) -> tuple[object, int | None]:
    """The merged state of one thing, and what is counted: nothing, CLEAN or a conflict (-1)."""
    if left == right:
        return right, None if right == none else CLEAN
    if left == none:
        return right, CLEAN
    if right == none:
        return left, CLEAN
    return right, -1


class Outcomes:
    """For each pair of codes (left * k + right) what becomes of a line and of the gap after it."""

    def __init__(self, edits: list[Edit]):
        import pyarrow as pa

        every = [*edits, Edit()]  # the last code: no edit
        self.none, self.size = len(edits), len(every)
        keeps, suffix, gaps = [], [], []
        counts = np.zeros((len(COUNTS), self.size**2), np.int64)
        for pair in range(self.size**2):
            a, b = every[pair // self.size], every[pair % self.size]
            line, what = _outcome((a.drop, a.append), (b.drop, b.append), (False, ""))
            if what is not None:
                counts[what if what >= 0 else EDIT_DELETE if a.drop or b.drop else EDIT_EDIT, pair] += 1
            gap, what = _outcome(a.insert, b.insert, None)
            if what is not None:
                counts[what if what >= 0 else INSERT_INSERT, pair] += 1
            keeps.append(not line[0])
            suffix.append("" if line[0] else line[1])
            gaps.append(gap)
        self.keeps, self.counts = np.array(keeps), counts
        self.has_gap = np.array([g is not None for g in gaps])
        self.suffix, self.gap = pa.array(suffix, pa.large_string()), pa.array([g or "" for g in gaps], pa.large_string())
        self.changes = np.array([e != Edit() for e in every])


def _codes(column, none: int) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column.cast("int64"), none).to_numpy(zero_copy_only=False)


def merge_lines(texts, left: np.ndarray, right: np.ndarray, lines, parents: np.ndarray, of: Outcomes):
    """(merged texts, counts by row) of line lists, given the codes of all lines."""
    import pyarrow as pa
    import pyarrow.compute as pc

    pair = left * of.size + right
    flat = lines.flatten()
    n, rows = len(flat), len(texts)
    counted = pa.table({"row": parents} | {c: of.counts[k].take(pair) for k, c in enumerate(COUNTS)})
    by_row = counted.group_by("row").aggregate([(c, "sum") for c in COUNTS])
    counts = np.zeros((rows, len(COUNTS)), np.int64)
    counts[by_row["row"].to_numpy()] = np.stack([by_row[f"{c}_sum"].to_numpy() for c in COUNTS], axis=1)

    outcome = pa.array(pair)
    edited = pc.binary_join_element_wise(flat, of.suffix.take(outcome), pa.scalar("", pa.large_string()))
    # each line has two slots in the new lists, itself and the gap after it
    stays = np.empty(2 * n, bool)
    stays[0::2], stays[1::2] = of.keeps.take(pair), of.has_gap.take(pair)
    slots = np.empty(2 * n, np.int64)
    slots[0::2], slots[1::2] = np.arange(n), n + np.arange(n)
    content = pa.concat_arrays([edited, of.gap.take(outcome)]).take(pa.array(slots[stays]))
    ends = np.concatenate([[0], np.cumsum(stays)])
    line_ends = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=rows))])
    offsets = pa.array(ends[2 * line_ends], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, content), pa.scalar("\n", pa.large_string())), counts


def _values(base: list[str], codes: np.ndarray, edits: list[Edit]) -> list[str]:
    return [v if c >= len(edits) else "" if edits[c].drop else v + edits[c].append for v, c in zip(base, codes.tolist(), strict=True)]


def merge_branches(docs: DataFrame, left: Branch, right: Branch, edits: list[Edit], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    r"""Each row of ``docs`` merged, and each row that a branch adds: doc_id, the merged columns, text and the four COUNTS.

    Columns are those that the branches give codes for; they and the text become strings, NULL being empty. Lines are what ``text`` is split into at
    \n; an empty text has one empty line. Each column, line and gap after a line merges by itself: a change in one branch or the
    same one in both counts as one clean merge, different ones as one conflict, which takes the right branch's state; edits are compared by
    the value they lead to. A dropped line keeps its gap. A dropped row counts alone: as one edit-delete conflict if the other
    branch keeps the row and changes any of it, and then the right branch's state is what stays; else as one clean merge.
    An added row gets the id -1 - id, the base's columns and the text that its edit inserts; added by both with different texts it is an
    insert-insert conflict. Ids are whole numbers. Of a row that isn't there any more columns and text are NULL.

    Rows are merged one by one: repeated ids give a row each, also of what they add, a NULL id stays NULL. Codes outside ``edits`` and NULL codes change nothing; missing codes
    of further lines neither. Other columns of ``docs`` may have any names and don't come out; an empty table gives no rows. One scan, no shuffle, nothing through
    the driver; a worker holds one batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    bounded_batches(docs.sparkSession)
    names = list(left.columns)
    taken = {"id": F.col(doc_id), "text": F.coalesce(F.col(text).cast("string"), F.lit(""))}
    for k, c in enumerate(names):
        taken |= {f"v{k}": F.coalesce(F.col(c).cast("string"), F.lit("")), f"l{k}": left.columns[c], f"r{k}": right.columns[c]}
    taken |= {"l": left.row, "r": right.row, "left_lines": left.lines, "right_lines": right.lines}
    given = docs.select(*(c.alias(k) for k, c in taken.items()))
    id_type = given.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(f"v{k}", T.StringType()) for k in range(len(names))), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def aligned(codes, lengths: np.ndarray, none: int) -> np.ndarray:
        """The codes of all lines; lines without a code have none."""
        have = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False)
        flat = _codes(codes.flatten(), none)
        if not (have == lengths).all():
            out, at = np.full(int(lengths.sum()), none, np.int64), 0
            to = np.concatenate([[0], np.cumsum(lengths)])
            for k, n in enumerate(have.tolist()):
                m = min(n, int(lengths[k]))
                out[to[k] : to[k] + m] = flat[at : at + m]
                at += n
            flat = out
        return np.where((flat < 0) | (flat > none), none, flat)

    def run(batches):
        of = Outcomes(edits)
        inserts = [*(e.insert for e in edits), None]
        drops = np.array([*(e.drop for e in edits), False])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            texts = col["text"].cast(pa.large_string())
            lines = pc.split_pattern(texts, "\n")
            lengths = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
            parents = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
            whole = lambda c: np.where((c < 0) | (c > of.none), of.none, c)
            lc, rc = aligned(col["left_lines"], lengths, of.none), aligned(col["right_lines"], lengths, of.none)
            row_l, row_r = whole(_codes(col["l"], of.none)), whole(_codes(col["r"], of.none))
            gone_l, gone_r = drops[row_l], drops[row_r]

            base = [col[f"v{k}"].to_pylist() for k in range(len(names))]
            sides = [[_values(b, whole(_codes(col[f"{s}{k}"], of.none)), edits) for k, b in enumerate(base)] for s in "lr"]
            changed = []
            for codes, values in ((lc, sides[0]), (rc, sides[1])):
                any_line = np.bincount(parents, weights=of.changes[codes], minlength=rows) > 0
                for b, v in zip(base, values, strict=True):
                    any_line |= np.array([x != y for x, y in zip(b, v, strict=True)])
                changed.append(any_line)
            conflict = (gone_l & ~gone_r & changed[1]) | (gone_r & ~gone_l & changed[0])
            absent = gone_r | (gone_l & ~changed[1])
            # a row that only the left branch drops and the right one changes: the right one's state
            lc = np.where(gone_l[parents], of.none, lc)
            merged, counts = merge_lines(texts, lc, rc, lines, parents, of)
            values = []
            for b, left_v, right_v in zip(base, *sides, strict=True):
                out = []
                for k, (x, y, z) in enumerate(zip(b, left_v, right_v, strict=True)):
                    state, what = _outcome(x if gone_l[k] else y, z, x)
                    out.append(state)
                    if what is not None:
                        counts[k, CLEAN if what == CLEAN else EDIT_EDIT] += 1
                values.append(pa.array(out, pa.string()))
            alone = gone_l | gone_r
            counts[alone] = 0
            counts[alone & ~conflict, CLEAN] = 1
            counts[conflict, EDIT_DELETE] = 1
            there = pa.array(~absent)
            null = lambda x: pc.if_else(there, x, pa.scalar(None, x.type))
            yield pa.RecordBatch.from_arrays([col["id"], *(null(v) for v in values), null(merged).cast(pa.string()), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], schema.names)

            new = [_outcome(inserts[a], inserts[b], None) for a, b in zip(row_l.tolist(), row_r.tolist(), strict=True)]
            at = pa.array([k for k, (text, _) in enumerate(new) if text is not None], pa.int64())
            if len(at):
                added = np.zeros((len(at), len(COUNTS)), np.int64)
                for j, k in enumerate(at.to_pylist()):
                    added[j, CLEAN if new[k][1] == CLEAN else INSERT_INSERT] = 1
                ids = pc.subtract(pa.scalar(-1, pa.int64()), col["id"].take(at).cast(pa.int64())).cast(col["id"].type)
                yield pa.RecordBatch.from_arrays([ids, *(col[f"v{k}"].take(at) for k in range(len(names))), pa.array([new[k][0] for k in at.to_pylist()], pa.string()), *(pa.array(added[:, k]) for k in range(len(COUNTS)))], schema.names)

    out = given.mapInArrow(run, schema)
    return out.select(F.col("id").alias(doc_id), *(F.col(f"v{k}").alias(c) for k, c in enumerate(names)), F.col("text").alias(text), *COUNTS)


#: The edits by code: a code of 5 and more changes nothing.
EDITS = [Edit(drop=True), Edit(append="!"), Edit(append="?"), Edit(insert="!"), Edit(insert="?")]
CODES = 7


def checksum_branch(name: str, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> Branch:
    """A branch whose codes are checksums of ``branch:id:what`` modulo CODES; a NULL id is written as nothing."""
    head = F.concat(F.lit(f"{name}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))

    def code(what: Column) -> Column:
        return (F.crc32(F.concat(head, what).cast("binary")) % CODES).cast("int")

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    last = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit("")))
    return Branch(code(F.lit("row")), {c: code(F.lit(c)) for c in columns}, F.transform(F.sequence(F.lit(0), last), lambda i: code(i.cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    merged = merge_branches(docs, *(checksum_branch(b, ["lang", "source"]) for b in "LR"), EDITS)
    return merged.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *COUNTS)


#: The same rows in DuckDB's SQL; the checksum is worked out byte by byte.
SQL = r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS v FROM t WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), names AS (
  SELECT n, doc_id, b, unnest(list_concat(['row', 'lang', 'source'], [CAST(i AS VARCHAR) FOR i IN range(len(w))])) AS name FROM d, (VALUES ('L'), ('R')) AS x(b)
), coded AS (
  SELECT n, b, name, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(b || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name, '')]),
    lambda a, x: xor(a // 256, crc.v[xor(a, x) % 256 + 1])), 4294967295) % 7 AS INT) AS code FROM names, crc
), pairs AS (
  SELECT n, name, max(code) FILTER (b = 'L') AS l, max(code) FILTER (b = 'R') AS r FROM coded GROUP BY n, name
), line AS (
  SELECT p.n, CAST(name AS INT) AS i, w[CAST(name AS INT) + 1] AS s,
    CASE WHEN l < 3 THEN l END AS le, CASE WHEN r < 3 THEN r END AS re, CASE WHEN l IN (3, 4) THEN l END AS lg, CASE WHEN r IN (3, 4) THEN r END AS rg
  FROM pairs p JOIN d ON d.n = p.n WHERE name NOT IN ('row', 'lang', 'source')
), state AS (
  SELECT *, coalesce(re, le) AS e, coalesce(rg, lg) AS g FROM line
), marked AS (
  SELECT n, i, unnest([
    {'v': 'm', 'k': 0, 's': CASE e WHEN 0 THEN NULL WHEN 1 THEN s || '!' WHEN 2 THEN s || '?' ELSE s END}, {'v': 'm', 'k': 1, 's': CASE g WHEN 3 THEN '!' WHEN 4 THEN '?' END},
    {'v': 'r', 'k': 0, 's': CASE re WHEN 0 THEN NULL WHEN 1 THEN s || '!' WHEN 2 THEN s || '?' ELSE s END}, {'v': 'r', 'k': 1, 's': CASE rg WHEN 3 THEN '!' WHEN 4 THEN '?' END}], recursive := true) FROM state
), texts AS (
  SELECT n, coalesce(string_agg(s, chr(10) ORDER BY i, k) FILTER (v = 'm'), '') AS m, coalesce(string_agg(s, chr(10) ORDER BY i, k) FILTER (v = 'r'), '') AS r FROM marked GROUP BY n
), lines AS (
  SELECT n, count(*) FILTER ((le IS NOT NULL OR re IS NOT NULL) AND (le IS NULL OR re IS NULL OR le = re)) + count(*) FILTER ((lg IS NOT NULL OR rg IS NOT NULL) AND (lg IS NULL OR rg IS NULL OR lg = rg)) AS clean,
    count(*) FILTER (le <> re AND le > 0 AND re > 0) AS ee, count(*) FILTER (le <> re AND (le = 0 OR re = 0)) AS ed, count(*) FILTER (lg <> rg) AS ii,
    bool_or(le IS NOT NULL OR lg IS NOT NULL) AS lch, bool_or(re IS NOT NULL OR rg IS NOT NULL) AS rch
  FROM line GROUP BY n
), cols AS (
  SELECT d.n, p.name, v, CASE l WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS lv, CASE r WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS rv
  FROM pairs p JOIN d ON d.n = p.n, LATERAL (SELECT CASE p.name WHEN 'lang' THEN lang ELSE source END AS v) WHERE p.name IN ('lang', 'source')
), byrow AS (
  SELECT n, max(CASE WHEN rv <> v THEN rv ELSE lv END) FILTER (name = 'lang') AS lang, max(CASE WHEN rv <> v THEN rv ELSE lv END) FILTER (name = 'source') AS source,
    max(rv) FILTER (name = 'lang') AS rlang, max(rv) FILTER (name = 'source') AS rsource,
    count(*) FILTER ((lv <> v OR rv <> v) AND (lv = v OR rv = v OR lv = rv)) AS clean, count(*) FILTER (lv <> v AND rv <> v AND lv <> rv) AS ee, bool_or(lv <> v) AS lch, bool_or(rv <> v) AS rch
  FROM cols GROUP BY n
), j AS (
  SELECT d.n, d.doc_id, d.lang AS blang, d.source AS bsource, p.l, p.r, c.*, t.m, t.r AS rtext, x.clean + c.clean AS clean2, x.ee + c.ee AS ee2, x.ed, x.ii, x.lch OR c.lch AS lchanged, x.rch OR c.rch AS rchanged
  FROM d JOIN pairs p ON p.n = d.n AND p.name = 'row' JOIN byrow c ON c.n = d.n JOIN texts t ON t.n = d.n JOIN lines x ON x.n = d.n
), flagged AS (
  SELECT *, l = 0 AS gl, r = 0 AS gr, (l = 0 AND r <> 0 AND rchanged) OR (r = 0 AND l <> 0 AND lchanged) AS clash, r = 0 OR (l = 0 AND NOT rchanged) AS absent FROM j
)
SELECT doc_id, CASE WHEN absent THEN NULL WHEN gl THEN rlang ELSE lang END AS lang, CASE WHEN absent THEN NULL WHEN gl THEN rsource ELSE source END AS source,
  CASE WHEN absent THEN NULL WHEN gl THEN sha256(rtext) ELSE sha256(m) END AS text_sha256,
  CAST(CASE WHEN clash THEN 0 WHEN gl OR gr THEN 1 ELSE clean2 END AS BIGINT) AS n_clean, CAST(CASE WHEN gl OR gr THEN 0 ELSE ee2 END AS BIGINT) AS n_edit_edit,
  CAST(CASE WHEN clash THEN 1 WHEN gl OR gr THEN 0 ELSE ed END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN gl OR gr THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert
FROM flagged
UNION ALL
SELECT -1 - doc_id, blang, bsource, sha256(CASE WHEN r IN (3, 4) THEN CASE r WHEN 3 THEN '!' ELSE '?' END WHEN l = 3 THEN '!' ELSE '?' END),
  CAST(CASE WHEN l IN (3, 4) AND r IN (3, 4) AND l <> r THEN 0 ELSE 1 END AS BIGINT), 0, 0, CAST(CASE WHEN l IN (3, 4) AND r IN (3, 4) AND l <> r THEN 1 ELSE 0 END AS BIGINT)
FROM flagged WHERE l IN (3, 4) OR r IN (3, 4)
"""
