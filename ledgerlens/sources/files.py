"""Readers of materials: directories, text, logs, answers, price rows, fact files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import filer_key

#: Kinds of material by suffix; for statements the earlier kind goes first.
KINDS = {"pdf": ["pdf"], "excel": ["xlsx", "xls"], "html": ["htm", "html"], "text": ["txt", "md"]}


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(suffixes), kind).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, kind, length, modified[, content] of every readable file below a folder, hidden ones left out (A2).

    Without ``content`` the bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    visible = files.where(~F.col("path").rlike(r"/\.[^/]+(/|$)")).withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull())
    columns = ["path", "kind", "length", F.col("modificationTime").alias("modified")]
    return visible.select(*columns, *(["content"] if content else []))


def statement_sources(files: DataFrame) -> DataFrame:
    """Files of the best kind that is there: PDF, then Excel, then HTML (A2)."""
    order = F.when(F.col("kind") == "pdf", 0).when(F.col("kind") == "excel", 1).when(F.col("kind") == "html", 2)
    ranked = files.withColumn("_o", order).where("_o is not null")
    best = ranked.agg(F.min("_o").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_o") == F.col("_best")).drop("_o", "_best")  # one row


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """path, text: whole files as UTF-8, bad bytes replaced (A1)."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log, a JSON object a line; lines that can't be read are kept in _corrupt_record."""
    schema = "ts string, event string, decision string, host string, purpose string, payload_bytes long, payload_sha16 string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list file; empty lines and comments left out."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


def parse_answers(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, key, value, confidence, source of ``key = value @confidence:source`` lines."""
    t = F.trim(F.col(line))
    kept = lines.where(~F.startswith(t, F.lit("#")) & F.contains(t, F.lit("=")))
    key, right = F.trim(F.split_part(t, F.lit("="), F.lit(1))), F.regexp_extract(t, r"^[^=]*=(.*)$", 1)
    blank = lambda c: F.when(c != "", c)
    value = blank(F.trim(F.regexp_replace(right, r"\s@[^@]*$", "")))
    return kept.select(*keep, key.alias("key"), value.alias("value"), blank(F.regexp_extract(right, r"\s@([^:@]*)", 1)).alias("confidence"), blank(F.trim(F.regexp_extract(right, r"\s@[^:@]*:(.*)$", 1))).alias("source"))


def parse_bars(rows: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """keys, date, close of ``date,open,close,high,low,volume`` rows; rows that can't be read are dropped."""
    f = F.split(F.col(row), ",")
    out = rows.select(*keys, F.try_to_date(F.trim(F.get(f, F.lit(0))), "yyyy-MM-dd").alias("date"), F.trim(F.get(f, F.lit(2))).try_cast("double").alias("close"))
    return out.where("date is not null and close is not null")


def parse_quote(rows: DataFrame, quote: str = "quote") -> DataFrame:
    """Adds price, market_cap and shares from a quote of ~ fields: 3 the price, 44 the value in hundred millions."""
    f = F.split(F.col(quote), "~")
    price, cap = F.get(f, F.lit(3)).try_cast("double"), F.get(f, F.lit(44)).try_cast("double") * 1e8
    return rows.withColumns({"price": price, "market_cap": cap, "shares": F.when(price > 0, cap / price)})


FACTS = "struct<cik:long, entityName:string, facts:map<string, map<string, struct<units:map<string, array<struct<start:string, end:string, val:double, form:string, fy:int, fp:string, filed:string, accn:string>>>>>>>"


def flatten_facts(documents: DataFrame, json: str = "value") -> DataFrame:
    """One row for each observation of company fact files: cik, taxonomy, tag, unit, start, end, val, form, fy, fp, filed, accn, seq.

    seq is an observation's place in its file, for rules by which the first one read wins.
    """
    d = documents.select(F.from_json(F.col(json), FACTS).alias("d"))
    by_taxonomy = d.select(filer_key(F.col("d.cik")).alias("cik"), F.explode("d.facts").alias("taxonomy", "tags"))
    by_tag = by_taxonomy.select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    by_unit = by_tag.select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows"))
    rows = by_unit.select("cik", "taxonomy", "tag", "unit", F.posexplode("rows").alias("seq", "r")).select("cik", "taxonomy", "tag", "unit", "seq", "r.*")
    dates = {c: F.try_to_date(c, "yyyy-MM-dd") for c in ("start", "end", "filed")}
    return rows.withColumns(dates)


def write_index(chunks: DataFrame, path: str) -> None:
    """The chunk index, by source (B1)."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Events appended as JSON lines."""
    events.write.mode("append").json(path)


def missing_pages(pages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that a cache doesn't have yet."""
    return pages.join(cache.select(*keys).distinct(), keys, "left_anti")
