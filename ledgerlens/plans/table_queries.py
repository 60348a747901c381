"""Queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, text
from ..operators import asof, audit, facts, layout, overlap, peers, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SEARCH = "worthless thing of the station"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.%]*')"
_CJK = "一-鿿㐀-䶿"


@query(
    f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), q AS (SELECT unnest(['worthless', 'thing', 'of', 'the', 'station']) AS term),
f AS (SELECT doc_id, len(t) AS n, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), df AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(f.n, 1) / s.a))) AS score
FROM f JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT 6"""
)
def bm25_topk(spark, sf_dir):
    """Ranked search of the documents."""
    return retrieval.bm25(read(spark, sf_dir, "documents"), SEARCH, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term"""
)
def corpus_idf(spark, sf_dir):
    """Document frequency and idf of every term (G1)."""
    return retrieval.inverse_frequencies(read(spark, sf_dir, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest({_TOKENS}) AS term FROM conversations) GROUP BY doc_id, term")
def postings(spark, sf_dir):
    """Term frequencies of every conversation turn (G1)."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return retrieval.token_frequencies(turns, "doc_id")


_EDGES = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_EDGES}', '', 'g')), lambda x: x <> '') AS ps FROM documents),
s AS (SELECT doc_id, ps, list_transform(range(0, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1 : i], lambda x: length(x))), 0)) AS upto FROM p WHERE len(ps) > 0),
c AS (SELECT doc_id, 1 AS chunk_no, 0 AS f, least(len(list_filter(upto, lambda x: x < 420)), len(ps)) AS e FROM s
UNION ALL SELECT s.doc_id, chunk_no + 1, nf, least(len(list_filter(upto, lambda x: x < upto[nf + 1] + 420)), len(ps)) FROM (SELECT doc_id, chunk_no, CASE WHEN e - 1 > f THEN e - 1 ELSE e END AS nf FROM c) n JOIN s ON s.doc_id = n.doc_id WHERE nf < len(ps))
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(f + 1 AS INTEGER) AS para_start, CAST(e AS INTEGER) AS para_end, CAST(upto[e + 1] - upto[f + 1] + e - f - 1 AS INTEGER) AS n_chars FROM c JOIN s USING (doc_id)"""
)
def chunk_documents(spark, sf_dir):
    """Paragraph chunks of about 420 characters with one paragraph of overlap."""
    return retrieval.chunk_documents(read(spark, sf_dir, "documents"), "doc_id", split=r"\n").select("doc_id", "chunk_no", "para_start", "para_end", F.length("text").alias("n_chars"))


@query(
    r"""SELECT doc_id, trim(substr(text, greatest(instr(text, 'worthless') - 60, 1), 159)) AS snippet, (SELECT count(*) FROM documents WHERE contains(text, 'worthless')) AS total
FROM documents WHERE contains(text, 'worthless') ORDER BY doc_id LIMIT 20"""
)
def keyword_search(spark, sf_dir):
    """Keyword hits with snippets."""
    return retrieval.keyword_hits(read(spark, sf_dir, "documents"), "doc_id", "worthless").withColumn("snippet", F.trim("snippet"))


@query(
    r"""WITH v AS (SELECT item_id, lower(regexp_replace(text, '[\s　，。、；：？！“”‘’（）《》【】,.;:?!"''()\[\]{}<>\-—_/\\|*#]+', '', 'g')) AS t FROM benchmark),
c AS (SELECT doc_id, lower(regexp_replace(text, '[\s　，。、；：？！“”‘’（）《》【】,.;:?!"''()\[\]{}<>\-—_/\\|*#]+', '', 'g')) AS t FROM documents),
vg AS (SELECT item_id, i, substr(t, i + 1, 8) AS g FROM (SELECT item_id, t, unnest(range(0, length(t) - 7)) AS i FROM v WHERE length(t) >= 8)),
cg AS (SELECT doc_id, j, substr(t, j + 1, 8) AS g FROM (SELECT doc_id, t, unnest(range(0, length(t) - 7)) AS j FROM c WHERE length(t) >= 8)),
m AS (SELECT item_id, doc_id, i, j - i AS dg, i - row_number() OVER (PARTITION BY item_id, doc_id, j - i ORDER BY i) AS run FROM vg JOIN cg USING (g)),
r AS (SELECT item_id, doc_id, min(i) AS "at", count(*) + 7 AS "length" FROM m GROUP BY item_id, doc_id, dg, run)
SELECT item_id, doc_id, CAST("at" AS BIGINT) AS "at", CAST("length" AS BIGINT) AS "length" FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY "length" DESC, "at") AS k FROM r) WHERE k = 1"""
)
def overlap_scan(spark, sf_dir):
    """Longest runs of 8 or more characters, the least that counts, that benchmark items share with documents."""
    found = overlap.longest_overlaps(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", value="text")
    return found.select("item_id", "doc_id", F.col("at").cast("long").alias("at"), F.col("length").cast("long").alias("length"))


@query("SELECT doc_id, array_to_string(list_filter(['idiot', 'moron', 'scum'], lambda x: contains(text, x)), ',') AS blocked FROM documents WHERE contains(text, 'idiot') OR contains(text, 'moron') OR contains(text, 'scum')")
def blocklist_hits(spark, sf_dir):
    """Texts that hold a blocked term."""
    return overlap.blocked_values(read(spark, sf_dir, "documents"), ["idiot", "moron", "scum"], "text").select("doc_id", F.array_join("blocked", ",").alias("blocked"))


@query(
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(['S0', 'S1', 'S2'], x))), ',') AS unknown, CAST(len(c) AS INTEGER) AS n_cited
FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all('[S' || (conv_id % 5) || '] and [S' || (turn % 4) || ']', '\[(S[0-9]+)\]', 1)) AS c FROM conversations)"""
)
def citation_antijoin(spark, sf_dir):
    """Citations that retrieval did not give."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("[S"), F.col("conv_id") % 5, F.lit("] and [S"), F.col("turn") % 4, F.lit("]")).alias("text"))
    found = retrieval.unknown_citations(c, F.array(F.lit("S0"), F.lit("S1"), F.lit("S2")))
    return found.select("conv_id", "turn", F.array_join(F.array_sort("unknown"), ",").alias("unknown"), F.size("cited").alias("n_cited"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages"""
)
def page_text_extract(spark, sf_dir):
    """Visible text of web pages (A5)."""
    return read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    """Each customer's last order, the lowest key of equal dates."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", F.col("o_orderdate").alias("t"))
    return asof.latest_by(o, ["o_custkey"], [F.col("t"), -F.col("o_orderkey")]).drop("t")


@query(
    """WITH f AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_filed FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS latest_end FROM orders JOIN f ON o_orderkey = l_orderkey WHERE first_filed <= DATE '1997-06-30' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30' GROUP BY o_custkey"""
)
def disclosed_asof(spark, sf_dir):
    """The last period of each filer that was disclosed by a date (R3, W5, J4): orders as periods, first shipment as filing."""
    ship = facts.first_filed(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("filed")).withColumn("end", F.lit(0)), ["l_orderkey"])
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("end"))
    known = o.join(ship.select("l_orderkey", F.col("first_filed").alias("filed")), "l_orderkey")
    return facts.latest_period(known, ["o_custkey"], F.lit("1997-06-30").cast("date"))


@query(
    """SELECT c.event_id, c.user_id, CASE WHEN p.ts >= c.ts - INTERVAL 15 DAY THEN round(p.value, 6) END AS price FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON c.user_id = p.user_id AND c.ts >= p.ts"""
)
def asof_price(spark, sf_dir):
    """The last purchase value at each click, at most 15 days old."""
    e = read(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bar"), "value", F.col("event_id").alias("seq"))
    found = asof.asof_backward(clicks, buys, ["user_id"], "ts", "bar", ["value"], F.expr("INTERVAL 15 DAYS"), tie="seq", slice_of=lambda at: at.cast("date"))
    return found.select("event_id", "user_id", F.round("value", 6).alias("price"))


@query(
    """SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, p) AS tag_used, round(arg_min(value, p), 6) AS val FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 END * 1000000000000 + event_id AS p FROM events)
WHERE p IS NOT NULL GROUP BY user_id, CAST(ts AS DATE)"""
)
def tag_fallback(spark, sf_dir):
    """The value of the first tag in an order that has one."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_type", "value", "event_id")
    got = facts.first_tag(e, ["user_id", "day"], ["purchase", "signup", "view"], tag="event_type", val="value", tie="event_id")
    return got.select("user_id", "day", "tag_used", F.round("val", 6).alias("val"))


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN d BETWEEN 330 AND 400 THEN 'annual' WHEN d BETWEEN 80 AND 100 THEN 'quarter' WHEN d BETWEEN 170 AND 190 THEN 'half' WHEN d BETWEEN 260 AND 285 THEN 'ytd9' ELSE 'other' END AS kind
FROM (SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) GROUP BY kind"""
)
def duration_bucket(spark, sf_dir):
    """Spans by kind of period."""
    both = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    days = F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
    return both.groupBy(identifiers.duration_kind(days).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _yearly(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    revenue = o.join(c, "o_custkey").groupBy("nation", F.year("d").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return revenue.select("nation", "year", F.make_date("year", F.lit(12), F.lit(31)).alias("end"), (F.col("cents") / F.lit(100.0)).alias("val"))


_YEARLY = """y AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, make_date(year(o_orderdate), 12, 31) AS "end", CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS val
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(
    f"""WITH {_YEARLY}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY "end" DESC) AS k FROM y)
SELECT a.nation, b."end" AS first_end, a."end" AS last_end, round(pow(a.val / b.val, 365.25 / date_diff('day', b."end", a."end")) - 1, 6) AS cagr FROM r a JOIN r b ON a.nation = b.nation AND a.k = 1 AND b.k = 4"""
)
def cagr_by_key(spark, sf_dir):
    """Growth by actual days over three rows."""
    return facts.growth(_yearly(spark, sf_dir), ["nation"], years=3).select("nation", "first_end", "last_end", F.round("cagr", 6).alias("cagr"))


@query(
    f"""WITH {_YEARLY}, m AS (SELECT nation, max(year) AS last FROM y GROUP BY nation)
SELECT nation, CASE WHEN count(*) = 4 THEN round(pow(arg_max(val, year) / arg_min(val, year), 1.0 / 3) - 1, 6) END AS cagr, CASE WHEN count(*) <> 4 THEN 'years not consecutive' END AS gap
FROM y JOIN m USING (nation) WHERE year >= last - 3 GROUP BY nation"""
)
def cagr_consecutive(spark, sf_dir):
    """Growth by whole consecutive years, else a gap."""
    return facts.consecutive_growth(_yearly(spark, sf_dir), ["nation"], years=3).select("nation", F.round("cagr", 6).alias("cagr"), "gap")


@query(
    """SELECT s_nationkey AS nation, count(*) AS n, round(min(s_acctbal), 6) AS min, round(quantile_cont(s_acctbal, 0.25), 6) AS p25, round(quantile_cont(s_acctbal, 0.5), 6) AS median, round(quantile_cont(s_acctbal, 0.75), 6) AS p75,
round(max(s_acctbal), 6) AS max, count(*) >= 3 AS enough FROM supplier GROUP BY s_nationkey"""
)
def peer_quantiles(spark, sf_dir):
    """Distribution of peers with the rule on too few."""
    d = peers.distribution(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation"), ["nation"], "s_acctbal")
    return d.select("nation", "n", *(F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max")), "enough")


@query(
    """SELECT c_custkey, round((SELECT avg(CASE WHEN p.c_acctbal <= c.c_acctbal THEN 1.0 ELSE 0.0 END) FROM customer p WHERE p.c_mktsegment = c.c_mktsegment), 6) AS share FROM customer c"""
)
def percentile_rank(spark, sf_dir):
    """Share of a customer's segment at or below its balance."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    r = peers.percentile_rank(c, c, ["c_mktsegment"], "c_acctbal", "c_acctbal", "c_custkey")
    return r.select("c_custkey", F.round("share_at_or_below", 6).alias("share"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(v / c_acctbal, 6) END AS pe, CASE WHEN v IS NULL THEN 'no price' WHEN c_acctbal <= 0 THEN 'pe: earnings not positive' END AS gap
FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS v FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
)
def peer_multiples(spark, sf_dir):
    """Multiples with the rows that have none kept and explained."""
    v = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0)).alias("price"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("earnings")).join(v, "c_custkey", "left").withColumns({"shares": F.lit(1.0), "net_debt": F.lit(0.0)})
    m = peers.multiples(c, "price", "shares", "net_debt", {"pe": "earnings"})
    return m.select("c_custkey", F.round("pe", 6).alias("pe"), F.get("gaps", F.lit(0)).alias("gap"))


@query(
    """SELECT s_suppkey, true AS ratios, t.r_name = p.r_name AS scale, t.r_name = p.r_name AND t.n_name = p.n_name AS multiples FROM supplier JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) p ON s_nationkey = p.n_nationkey,
(SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 8) t"""
)
def scope_gate(spark, sf_dir):
    """What may be compared with a target of another market (R15, P24): nations as markets, regions as currencies."""
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows, fixed
    target = n.where("n_nationkey = 8").select(F.col("n_name").alias("tm"), F.col("r_name").alias("tc"))
    s = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(target))
    return s.select("s_suppkey", peers.comparison_scope(F.col("tm"), F.col("tc"), F.col("n_name"), F.col("r_name")).alias("s")).select("s_suppkey", "s.*")


@query(
    """SELECT o_orderkey, CASE WHEN l.v IS NULL THEN 'undecidable' WHEN abs(o_totalprice - l.v) <= greatest(abs(o_totalprice) * 1e-6, 1.0) THEN 'holds' ELSE 'fails' END AS status FROM orders
LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS v FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"""
)
def identity_check(spark, sf_dir):
    """An identity with its outcomes (V1, R12, R13): an order's total against its lines."""
    from ..operators import checks

    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)).alias("liabilities"))
    s = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("assets")).join(lines, "o_orderkey", "left").withColumns({"equity": F.lit(0.0), "minority_interest": F.lit(None).cast("double")})
    return checks.all_checks(s, [checks.balance()], "o_orderkey").select("o_orderkey", "status")


@query(
    """WITH s AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL), o AS (SELECT l.*, top FROM lineitem l JOIN s USING (l_partkey, l_suppkey))
SELECT l_partkey, arg_max(l_discount, (top, -l_orderkey, -l_linenumber)) AS chosen, CAST(count(DISTINCT l_discount) - 1 AS INTEGER) AS n_rejected FROM o GROUP BY l_partkey"""
)
def conflict_resolve(spark, sf_dir):
    """Among conflicting values the one from the source of largest scale (J23, R14): suppliers as pages of a part."""
    l = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    top = l.groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("top"))
    best = F.max_by("l_discount", F.struct("top", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("chosen")
    return l.join(top, ["l_partkey", "l_suppkey"]).groupBy("l_partkey").agg(best, (F.size(F.collect_set("l_discount")) - 1).alias("n_rejected"))


@query(
    """SELECT user_id, CAST(min(d) AS BIGINT) AS first, CAST(max(d) AS BIGINT) AS last, count(*) AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g
FROM (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM events)) GROUP BY user_id, g"""
)
def gaps_islands(spark, sf_dir):
    """Runs of active days."""
    return asof.runs(read(spark, sf_dir, "events").select("user_id", F.unix_date(F.col("ts").cast("date")).alias("d")), ["user_id"], "d")


@query(
    """WITH s AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, count(*) AS score FROM events GROUP BY ALL),
a AS (SELECT user_id, arg_max(d, (score, -d)) AS a FROM s GROUP BY user_id), p AS (SELECT s.*, a, score >= 2 OR d = a AS ok FROM s JOIN a USING (user_id)),
w AS (SELECT *, bool_and(ok) OVER (PARTITION BY user_id, d >= a ORDER BY d) AS up, bool_and(ok) OVER (PARTITION BY user_id, d <= a ORDER BY d DESC) AS down FROM p)
SELECT user_id, CAST(d AS INTEGER) AS d, score FROM w WHERE CASE WHEN d >= a THEN up ELSE down END"""
)
def anchor_expand(spark, sf_dir):
    """From the best day outwards while days are good."""
    s = read(spark, sf_dir, "events").groupBy("user_id", F.unix_date(F.col("ts").cast("date")).alias("d")).agg(F.count(F.lit(1)).alias("score"))
    return asof.expand_from_anchor(s, ["user_id"], "d", "score", F.col("score") >= 2)


@query(
    """SELECT count(*) AS events, count(*) FILTER (event_type = 'view') AS allowed, count(*) FILTER (event_type = 'purchase') AS by_consent, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS blocked,
(SELECT string_agg(event_type, ',' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events)) AS hosts FROM events"""
)
def audit_summary(spark, sf_dir):
    """Outcomes of the log three ways (A40, A41, Q9): events as log lines."""
    e = read(spark, sf_dir, "events")
    decision = F.when(F.col("event_type") == "view", "ALLOW").when(F.col("event_type") == "purchase", "ALLOW-CONSENT").otherwise("BLOCK")
    return audit.summary(e, decision, "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def audit_tail(spark, sf_dir):
    """The last log lines."""
    return audit.tail(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 100 AND 1200 ORDER BY p_partkey LIMIT 50")
def range_screen(spark, sf_dir):
    """Peers by a value in a range."""
    return peers.screen(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 100, 1200, "p_partkey", 50)


@query(
    """SELECT c_custkey, source, bar FROM (SELECT *, min(prio) OVER (PARTITION BY c_custkey) AS best FROM (SELECT DISTINCT o_custkey AS c_custkey, 0 AS prio, 'orders' AS source, CAST(o_orderdate AS DATE) AS bar FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT DISTINCT o_custkey, 1, 'open', CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'O')) WHERE prio = best"""
)
def source_priority(spark, sf_dir):
    """Rows of the first source that has any."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_orderdate").cast("date").alias("bar"))
    part = lambda s, name: o.where(F.col("o_orderstatus") == s).select("c_custkey", F.lit(name).alias("source"), "bar").distinct()
    return asof.by_source_priority([part("F", "orders"), part("O", "open")], ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def missing_pages(spark, sf_dir):
    """Keys that a cache lacks (A11, J26): customers without large orders."""
    from ..sources.files import missing_pages as missing

    return missing(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    """SELECT user_id, start_ms, n FROM (SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s)"""
)
def event_sessions(spark, sf_dir):
    """Sessions with a gap of six hours (2.10, new capability)."""
    from ..streaming.audit import sessions

    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "user_id", "ts", "6 hours").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


@query(
    """SELECT s_nationkey AS nation, round(max(s_acctbal), 6) AS best, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS s_suppkey FROM supplier GROUP BY s_nationkey"""
)
def top_per_key(spark, sf_dir):
    """The best candidate of each key."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.round("s_acctbal", 6).alias("best"), "s_acctbal")
    return asof.latest_by(s, ["nation"], [F.col("s_acctbal"), -F.col("s_suppkey")]).drop("s_acctbal")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licensed under|released under') THEN 'licensed' ELSE 'none' END AS kind, length(text) AS n FROM documents")
def text_sniff(spark, sf_dir):
    """A cheap look at each file's text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.lower("text").rlike("licensed under|released under"), "licensed").otherwise("none").alias("kind"), F.length("text").cast("long").alias("n"))


@query(
    """SELECT l_suppkey, CAST(floor(l_extendedprice / 20000) AS INTEGER) AS lane, count(*) AS n, round(avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY ALL HAVING avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END) >= 0.25"""
)
def column_share(spark, sf_dir):
    """Groups in which a quarter of the cells pass a test."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.floor(F.col("l_extendedprice") / 20000).cast("int").alias("lane"))
    share = F.avg((F.col("l_quantity") >= 25).cast("double"))
    return l.agg(F.count(F.lit(1)).alias("n"), share.alias("s")).where("s >= 0.25").select("l_suppkey", "lane", "n", F.round("s", 6).alias("share"))


@query(
    """SELECT user_id, array_to_string(list_transform(a, lambda x: CAST(x AS VARCHAR)), ',') AS anchors FROM (SELECT user_id, list_reduce(list_prepend([]::BIGINT[], list_transform(list_sort(list(DISTINCT CAST(floor(value) AS BIGINT))), lambda x: [x])),
lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[len(a)] > 10 THEN list_concat(a, x) ELSE a END) AS a FROM events GROUP BY user_id)"""
)
def column_clusters(spark, sf_dir):
    """Clusters by distance from their anchor."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.floor("value").cast("double")).alias("xs"))
    return e.select("user_id", F.array_join(F.transform(layout.column_anchors(F.col("xs"), 10.0), lambda x: x.cast("long").cast("string")), ",").alias("anchors"))
