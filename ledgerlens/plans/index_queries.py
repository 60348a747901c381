"""Queries over what documents and pages are stored as: an index, a folder of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glossary, index
from ..sources import materials
from ..sources.work import new_folder
from .table_queries import _TOKENS, SEARCH, SQL, query, read


def _built(spark, sf_dir):
    path = new_folder(spark, "index")
    index.write_index(read(spark, sf_dir, "documents"), path)
    return index.open_index(spark, path)


@query(SQL["bm25_topk"])
def index_search(spark, sf_dir):
    """Ranked search by a stored index with pruned folders and block maxima."""
    return index.search(_built(spark, sf_dir), SEARCH).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"""SELECT source, term, count(*) AS df, CAST(max(tf) AS INTEGER) AS max_tf, CAST(min(len) AS INTEGER) AS min_len
FROM (SELECT doc_id, source, len, term, count(*) AS tf FROM (SELECT doc_id, coalesce(source, '') AS source, len(t) AS len, unnest(t) AS term FROM (SELECT doc_id, source, {_TOKENS} AS t FROM documents)) GROUP BY ALL) GROUP BY source, term"""
)
def index_terms(spark, sf_dir):
    """What a stored index says about each term of each source, read without the lists."""
    postings = _built(spark, sf_dir).postings
    return postings.groupBy(F.coalesce("source", F.lit("")).alias("source"), "term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))


@query("SELECT page_id, 'html' AS kind, md5(html) AS md5, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def landed_pages(spark, sf_dir):
    """Pages landed as files and read again by the data source for materials."""
    materials.register(spark)
    folder = new_folder(spark, "landed")
    pages = read(spark, sf_dir, "pages").select(F.concat((F.col("page_id") % 16).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    pages.write.format("materials").mode("append").save(folder)
    landed = spark.read.format("materials").load(folder)
    return landed.select(F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("long").alias("page_id"), "kind", F.md5(F.col("text").cast("binary")).alias("md5"), F.col("length").alias("n_bytes"))


#: Forms of a small glossary in the order in which they take letters, with the words they add.
_FORMS = [("of the", ["de la"]), ("in the", ["en la", "dans le"]), ("de la", ["of the"]), ("that", ["que", "dass"]), ("tion", ["cion"]), ("the", ["le", "der"]), ("and", ["und", "et"]), ("que", ["that"]), ("der", ["the"]), ("an", ["un"]), ("en", ["in"]), ("on", ["sur", "en"]), ("é", ["e"])]


@query(
    f"""WITH RECURSIVE f AS (SELECT * FROM (VALUES {", ".join(f"({k + 1}, '{w}', {words})" for k, (w, words) in enumerate(_FORMS))}) AS v(k, form, words)), t AS (
SELECT conv_id, turn, 0 AS k, coalesce(text, '') AS whole, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS had, CAST([] AS VARCHAR[]) AS added FROM conversations
UNION ALL SELECT conv_id, turn, k, CASE WHEN pos > 0 THEN whole[1 : pos - 1] || repeat('#', length(form)) || whole[pos + length(form) :] ELSE whole END, CASE WHEN pos > 0 THEN low[1 : pos - 1] || repeat('#', length(form)) || low[pos + length(form) :] ELSE low END, had,
CASE WHEN pos > 0 THEN list_concat(added, list_filter(words, lambda w: NOT contains(had, w) AND NOT list_contains(added, w))) ELSE added END
FROM (SELECT t.*, f.k, form, words, CASE WHEN len(added) >= 4 THEN 0 ELSE instr(CASE WHEN form = 'é' THEN whole ELSE low END, form) END AS pos FROM t JOIN f ON f.k = t.k + 1) AS x(conv_id, turn, old, whole, low, had, added, k, form, words, pos))
SELECT conv_id, turn, array_to_string(added, ',') AS added FROM t WHERE k = {len(_FORMS)}"""
)
def expanded_turns(spark, sf_dir):
    """The words that each turn of a conversation adds by its terms (J13, T3): long forms take their letters first, at most 4 words."""
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(glossary.added_words(F.col("text"), _FORMS, 4), ",").alias("added"))
