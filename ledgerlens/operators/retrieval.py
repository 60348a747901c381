"""Ranked retrieval over chunked text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize
from . import glossary

K1, B = 1.5, 0.75


#: What is cut from both ends of a paragraph.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def chunk_bounds(sizes: Column, target: int = 420, overlap: int = 1) -> Column:
    """array<struct<first, end>> of chunks over paragraphs of these sizes, counted from 0, ``end`` not included.

    A running sum over the paragraphs, which a chunk's end sets back to what the next chunk repeats: a chunk ends with the paragraph
    that brings it to ``target``; the next starts ``overlap`` paragraphs before, but after its own start. What the
    last paragraph leaves open are chunks too.
    """
    shape = "struct<first:int,held:bigint,done:array<struct<first:int,end:int>>>"

    def state(first: Column, held: Column, done: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), held.cast("bigint").alias("held"), done.alias("done"))

    def close(x: Column, upto: Column) -> Column:
        """The state once the open chunk has ended, at ``upto`` or before."""
        open_sizes = F.slice(sizes, x["first"] + 1, upto - x["first"])
        none = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("n"))
        grown = F.aggregate(open_sizes, none, lambda a, n: F.when(a["held"] < target, F.struct((a["held"] + n).alias("held"), (a["n"] + 1).alias("n"))).otherwise(a))
        end = x["first"] + grown["n"]
        first = F.when(end - overlap > x["first"], end - overlap).otherwise(end)
        again = F.aggregate(F.slice(sizes, first + 1, upto - first), F.lit(0).cast("bigint"), lambda a, n: a + n)
        return state(first, again, F.concat(x["done"], F.array(F.struct(x["first"].alias("first"), end.cast("int").alias("end")))))

    tries = F.sequence(F.lit(0), F.lit(overlap))  # what is repeated may fill chunks by itself

    def step(x: Column, k: Column) -> Column:
        taken = state(x["first"], x["held"] + F.get(sizes, k), x["done"])
        return F.aggregate(tries, taken, lambda y, _: F.when((y["held"] >= target) & (y["first"] <= k), close(y, k + 1)).otherwise(y))

    n = F.size(sizes)
    start = state(F.lit(0), F.lit(0), F.array().cast("array<struct<first:int,end:int>>")).cast(shape)
    filled = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    rest = F.aggregate(tries, filled, lambda y, _: F.when(y["first"] < n, close(y, n)).otherwise(y))
    return F.when(n > 0, rest["done"]).otherwise(start["done"])


def chunk_documents(docs: DataFrame, key: str, text: str = "text", target: int = 420, overlap: int = 1, split: str = r"\n\s*\n") -> DataFrame:
    """A row for each chunk of each document: key, chunk_no, para_start, para_end, text.

    Paragraphs of up to ``target`` characters together, the last ``overlap`` again in the next chunk. One scan
    with column expressions, no shuffle. NULL and blank texts have no chunks.
    """
    cut = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), split), lambda x: F.regexp_replace(x, f"^{_BLANK}+|{_BLANK}+$", ""))
    paras = docs.select(key, F.filter(cut, lambda x: x != "").alias("_p"))
    # the sizes are made once for each document and bound as a variable, else every step would make them anew
    bounds = F.transform(F.array(F.transform("_p", F.length)), lambda sizes: chunk_bounds(sizes, target, overlap))[0]
    found = paras.select(key, "_p", F.posexplode(bounds).alias("_k", "_b"))
    lines = F.slice("_p", F.col("_b.first") + 1, F.col("_b.end") - F.col("_b.first"))
    return found.select(key, (F.col("_k") + 1).alias("chunk_no"), (F.col("_b.first") + 1).alias("para_start"), F.col("_b.end").alias("para_end"), F.array_join(lines, "\n").alias("text"))


def token_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf): the postings."""
    return docs.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)) (G1).

    Distinct terms leave each document before the shuffle; map-side sums leave one row
    for each term and task.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    terms = docs.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(spark: SparkSession, query: str, terms: dict[str, list[str]] | None = None) -> Counter:
    """Terms of a query with their multiplicity, which weighs (Q10), after glossary expansion."""
    text = spark.range(1).select(glossary.expanded(F.lit(query), glossary.forms(terms))).first()[0] if terms else query
    low = text.lower()
    words = re.findall(r"[a-z0-9][a-z0-9.%]*", low)
    chars = re.findall(r"[一-鿿㐀-䶿]", low)
    return Counter([*words, *chars, *(a + b for a, b in zip(chars, chars[1:], strict=False))])


def bm25(docs: DataFrame, query: str, key: str, text: str = "text", top: int = 6, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """The ``top`` documents by BM25 score, ties by key: key, score.

    Only the query's terms are counted, inside each row; one aggregation gives the corpus figures
    and one scan scores. Nothing but the top rows is sorted or moved. ``terms``: a glossary that expands the query.
    """
    weights = query_terms(docs.sparkSession, query, terms)
    names = sorted(weights)
    tokens = tokenize(F.col(text))
    counted = docs.select(key, tokens.alias("_tokens"))
    times = lambda t: F.size(F.filter("_tokens", lambda x: x == F.lit(t)))
    tf = [times(t) for t in names]
    counted = counted.select(F.col(key), F.size("_tokens").alias("_len"), *(c.alias(f"_tf{i}") for i, c in enumerate(tf)))
    figures = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(names))))
    scored = counted.crossJoin(F.broadcast(figures))  # one row
    length = F.greatest(F.col("_len"), F.lit(1))
    score = F.lit(0.0)
    for i, t in enumerate(names):
        f = F.col(f"_tf{i}")
        part = idf(F.col("_n"), F.col(f"_df{i}")) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("_avg")))
        score = score + F.when(f > 0, F.lit(float(weights[t])) * part).otherwise(0.0)
    return scored.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def keyword_hits(docs: DataFrame, key: str, word: str, text: str = "text", limit: int = 20, before: int = 60, after: int = 90) -> DataFrame:
    """Documents that hold a word, with a snippet around its first place and the number of all hits."""
    at = F.instr(F.col(text), word)
    found = docs.where(at > 0).select(key, F.substring(F.col(text), F.greatest(at - before, F.lit(1)), F.lit(before + after) + F.length(F.lit(word))).alias("snippet"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(key).limit(limit).crossJoin(F.broadcast(total))  # one row


def unknown_citations(answers: DataFrame, allowed: Column, text: str = "text") -> DataFrame:
    """Adds cited and unknown: the [S1] ids of an answer, and those that retrieval did not give."""
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))
    return answers.withColumn("cited", cited).withColumn("unknown", F.array_except("cited", allowed))


def numbered(chunks: DataFrame, path: str, number: str) -> DataFrame:
    """Adds chunk_id: S1, S2, … over all files by path and number in the file (A3).

    Files are counted first; the one ordered task sees a row for each file, not for each chunk.
    """
    before = Window.partitionBy(F.lit(0)).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    files = chunks.groupBy(path).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_base") + F.row_number().over(Window.partitionBy(path).orderBy(number))
    return chunks.join(files, path).withColumn("chunk_id", F.concat(F.lit("S"), place.cast("string"))).select(*chunks.columns, "chunk_id")
