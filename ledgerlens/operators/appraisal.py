"""A folder of materials to statements, checks, results and files of each entity.

The folder has a folder for each entity with workbooks, HTML files, texts and an ``answers.txt``. Everything is one plan over all entities; the files are written by the tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import lenient_number
from ..sources import files, materials
from . import checks, derived, labels, layout, notes
from . import valuation as v

#: Fields that statements are asked for, and figures that only answers give.
FIELDS = ["revenue", "operating_income", "depreciation_amortization", "net_income", "assets", "equity", "cash", "short_term_debt", "long_term_debt", "total_liabilities", "accounts_payable", "minority_interest", "cash_begin", "cash_end", "cfo", "cfi", "cff", "fx_effect"]
_NAMES = {"total_assets": "assets"}
ANSWERS = ["multiple_low", "multiple_mid", "multiple_high", "dlom"]
ANSWER_FILE = "answers.txt"


def entity_of(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def folder_rows(spark: SparkSession, root: str, rules: DataFrame) -> DataFrame:
    """entity, path, r, label, field, value: the labelled figures of all workbooks, HTML tables and texts, in the files' order."""
    materials.register(spark)
    cells = spark.read.format("material_cells").load(root).where("gap is null")
    grids = layout.grid_rows(cells.select("path", F.coalesce("sheet", F.col("table_no").cast("string")).alias("sheet"), F.col("row_no").alias("r"), F.col("col_no").alias("c"), F.col("text").alias("value")), ["path", "sheet"])
    texts = spark.read.format("materials").load(root).where("kind = 'text' and gap is null").where(~F.col("path").endswith(f"/{ANSWER_FILE}"))
    flow = texts.select("path", F.lit("").alias("sheet"), "page", F.posexplode_outer(notes.text_flow(F.col("text"), notes.account_names())).alias("at", "x")).where("at is not null")
    rows = grids.select("path", "sheet", F.col("r").cast("long").alias("r"), "label", "current").unionByName(flow.select("path", "sheet", (F.col("page").cast("long") * 100_000 + F.col("at")).alias("r"), "x.label", "x.current"))
    named = labels.identify(rows, rules).withColumn("field", F.coalesce(*(F.when(F.col("field") == k, n) for k, n in _NAMES.items()), F.col("field")))
    return named.select(entity_of(F.col("path")).alias("entity"), "path", "sheet", "r", "label", "field", lenient_number(F.col("current")).alias("value"))


def answers(spark: SparkSession, root: str) -> DataFrame:
    """entity, key, value, confidence, source of all answer files; of a key given twice the last line counts."""
    materials.register(spark)
    texts = spark.read.format("materials").load(root).where("kind = 'text' and gap is null").where(F.col("path").endswith(f"/{ANSWER_FILE}"))
    lines = texts.select(entity_of(F.col("path")).alias("entity"), "page", F.posexplode(F.split("text", r"\r?\n")).alias("at", "value"))
    parsed = files.parse_answers(lines, keep=("entity", "page", "at"))
    last = parsed.where("value is not null").groupBy("entity", "key").agg(F.max_by(F.struct("value", "confidence", "source"), F.struct("page", "at")).alias("a"))
    return last.select("entity", "key", "a.*")


def appraise(rows: DataFrame, given: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, the FIELDS and ANSWERS, ebitda, net_debt, low, mid, high, gap, checks, missing: one row for each entity.

    A field is the first figure of the statements; an answer of the same name stands instead of it. Without a metric or multiples there is no value, and gap says so.
    """
    placed = rows.where(F.col("field").isin(FIELDS) & F.col("value").isNotNull()).groupBy("entity", "field").agg(F.min_by("value", F.struct("path", "sheet", "r")).alias("value"))
    told = given.select("entity", F.col("key").alias("field"), F.expr("try_cast(replace(value, ',', '') as double)").alias("value")).where(F.col("field").isin([*FIELDS, *ANSWERS]) & F.col("value").isNotNull())
    every = told.withColumn("o", F.lit(0)).unionByName(placed.withColumn("o", F.lit(1)))
    wide = every.groupBy("entity").agg(*(F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("o"))).alias(f) for f in [*FIELDS, *ANSWERS]))
    wide = entities.select("entity").distinct().join(wide, "entity", "left")
    judged = checks.all_checks(wide.withColumn("liabilities", F.col("total_liabilities")), [checks.balance(), checks.cash_rollforward()], "entity")
    held = judged.groupBy("entity").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "check", "status"))).alias("checks"))
    net = derived.statement_net_debt(wide)
    three = [f"multiple_{e}" for e in ("low", "mid", "high")]
    given_all = F.coalesce(*(F.when(F.col(m).isNull(), F.lit(False)) for m in three), F.lit(True))
    rising = F.coalesce((F.col(three[0]) <= F.col(three[1])) & (F.col(three[1]) <= F.col(three[2])), F.lit(False))
    # the model refuses multiples that don't rise, so those stand as 0 in it
    net = net.withColumn("_given", F.struct(*three)).withColumns({m: F.when(rising, F.col(m)).otherwise(0.0) for m in three})
    priced = v.by_multiples(net.withColumn("metric", F.col("operating_income") + F.col("depreciation_amortization"))).withColumns({m: F.col(f"_given.{m}") for m in three})
    gap = F.when(F.col("metric").isNull(), "no EBITDA").when(~given_all, "no multiples").when(~rising, "multiples must rise").otherwise(F.col("gap"))
    priced = priced.withColumns({e: F.when(rising, F.col(e)) for e in ("low", "mid", "high")})
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in [*FIELDS[:8], *ANSWERS[:3]])), lambda x: x.isNotNull())
    out = priced.withColumn("gap", gap).withColumn("missing", missing).withColumnRenamed("metric", "ebitda").join(held, "entity", "left")
    return out.select("entity", *FIELDS, *ANSWERS, "ebitda", "net_debt", "low", "mid", "high", "gap", "checks", "missing")


def appraisal_files(found: DataFrame) -> DataFrame:
    """path, text: template.txt with the figures to fill in, config.json with those that are known, report.txt."""
    known = F.map_filter(F.create_map(*(x for f in [*FIELDS, *ANSWERS] for x in (F.lit(f), F.col(f)))), lambda _, value: value.isNotNull())
    template = F.concat(F.array_join(F.transform("missing", lambda m: F.concat(m, F.lit(" = "))), "\n"), F.lit("\n"))
    config = F.to_json(F.struct("entity", known.alias("figures")))
    figure = lambda c: F.coalesce(F.format_number(F.col(c), 2), F.lit("—"))
    lines = [F.concat(F.lit("Entity: "), "entity"), *(F.concat(F.lit("Check "), F.coalesce(F.get("checks", F.lit(k)), F.lit("—"))) for k in range(2))]
    lines += [F.concat(F.lit(f"{c}: "), figure(c)) for c in ("revenue", "ebitda", "net_debt")]
    value = F.when(F.col("gap").isNull(), F.concat(F.lit("Equity by multiples: "), figure("low"), F.lit(" – "), figure("high"), F.lit(", mid "), figure("mid"))).otherwise(F.concat(F.lit("No value: "), "gap"))
    report = F.concat(F.concat_ws("\n", *lines, value, F.concat(F.lit("Not given: "), F.array_join("missing", ", "))), F.lit("\n"))
    each = F.explode(F.array(*(F.struct(F.concat("entity", F.lit(f"/{name}")).alias("path"), text.alias("text")) for name, text in (("template.txt", template), ("config.json", config), ("report.txt", report)))))
    return found.select(each.alias("f")).select("f.*")


def appraise_folder(spark: SparkSession, root: str, out: str, rules: DataFrame | None = None) -> DataFrame:
    """Appraises every entity folder below ``root`` and writes its files below ``out``; returns what ``appraise`` gives."""
    rows = folder_rows(spark, root, rules if rules is not None else labels.default_rules(spark))
    entities = spark.read.format("materials").load(root).select(entity_of(F.col("path")).alias("entity")).unionByName(rows.select("entity"))
    found = appraise(rows, answers(spark, root), entities)
    appraisal_files(found).write.format("materials").mode("append").save(out)
    return found


def _has(number: int):
    return lambda p: p["k"] == number


def sections(text: Column, titles: list[str]) -> Column:
    """map<title, text>: what follows each title at the beginning of a line, up to the next one (F25); titles that don't occur are left out.

    A title may stand after #, * or a number, and be followed by a colon. Of a title that occurs twice the first text counts.
    """
    marked = F.coalesce(text, F.lit(""))
    for k, t in enumerate(titles):
        marked = F.regexp_replace(marked, rf"(?m)^[#*\s]*(?:[0-9]+[.、)]\s*)?[*]*{re.escape(t)}[*]*\s*[:：]?[*]*[ \t]*", f"\x1e{k}\x1f")
    parts = F.filter(F.split(marked, "\x1e"), lambda p: F.contains(p, F.lit("\x1f")))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\x1f"), F.lit(1)).cast("int").alias("k"), F.trim(F.regexp_replace(F.split_part(p, F.lit("\x1f"), F.lit(2)), r"^\s+|\s+$", "")).alias("t")))
    found = F.array(*(F.struct(F.lit(t).alias("title"), F.get(F.filter(pairs, _has(k)), F.lit(0))["t"].alias("text")) for k, t in enumerate(titles)))
    return F.map_from_entries(F.filter(found, lambda s: s["text"].isNotNull()))
