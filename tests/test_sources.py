from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval
from ledgerlens.sources import files, html, peers
from ledgerlens.streaming import audit


def test_scan_skips_hidden_files(spark, tmp_path):
    for name in ("a.pdf", "b.html", ".c.pdf", "d.xyz", "sub/e.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    got = files.scan(spark, str(tmp_path))
    assert sorted(r.kind for r in got.collect()) == ["html", "pdf", "text"]
    assert [r.kind for r in files.statement_sources(got).collect()] == ["pdf"]
    assert files.scan(spark, str(tmp_path), content=True).columns[-1] == "content"


def test_texts_answers_and_blocklist(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path)).first().text == "one\ntwo"
    (tmp_path / "b.lst").write_text("# names\nAcme\n\nAcme\n")
    assert [r.term for r in files.read_blocklist(spark, str(tmp_path / "b.lst")).collect()] == ["Acme"]
    lines = spark.createDataFrame([("# c",), ("wacc = 8.5% @high:note 3",), ("g=2",), ("noise",)], "value string")
    got = [tuple(r) for r in files.parse_answers(lines).collect()]
    assert got == [("wacc", "8.5%", "high", "note 3"), ("g", "2", None, None)]


def test_bars_and_quotes(spark):
    rows = spark.createDataFrame([("x", "2024-01-02,1,2.5,3,0.5,9"), ("x", "bad"), ("x", "2024-13-02,1,2,3,4,5")], "code string, row string")
    assert [(str(r.date), r.close) for r in files.parse_bars(rows, ["code"]).collect()] == [("2024-01-02", 2.5)]
    q = spark.createDataFrame([("~".join(["0"] * 3 + ["20"] + ["0"] * 40 + ["5"]),), ("",)], "quote string")
    assert [r.shares for r in files.parse_quote(q).collect()] == [25_000_000.0, None]


def test_fact_files_flatten(spark):
    doc = {"cik": 320193, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-12-31", "val": 5, "form": "10-K", "fy": 2020, "fp": "FY", "filed": "2021-02-01", "accn": "1"}, {"end": "oops", "val": 1}]}}}}}
    got = files.flatten_facts(spark.createDataFrame([(json.dumps(doc),), ("not json",)], "value string")).orderBy("seq").collect()
    assert [(r.cik, r.tag, r.unit, r.seq, str(r.end), r.val) for r in got] == [("0000320193", "Revenues", "USD", 0, "2020-12-31", 5.0), ("0000320193", "Revenues", "USD", 1, "None", 1.0)]


def test_html_tables_keep_spans(spark):
    page = "<table><tr><td rowspan=2>Cash</td><td>$</td><td>(3,552</td><td>)</td></tr><tr><td colspan=2>x</td><td><a name='n' class='defref_us-gaap_Assets'>7</a></td></tr></table>"
    cells = html.extract_tables(spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "id int, html string"), "id")
    got = {(r.row_no, r.col_no): (r.text, r.tag) for r in cells.collect()}
    assert got[(1, 0)] == ("Cash", None) and got[(2, 1)] == ("x", None) and got[(2, 3)] == ("7", "us-gaap_Assets")
    row = html.statement_rows(cells, "id").where("row_no = 1").first()
    assert (row.label, list(row.cells)) == ("Cash", ["$(3,552)", "", ""])


def test_peer_sources(spark):
    spark.dataSource.register(peers.PeerJson)
    rows = json.dumps([{"code": "x", "name": "X", "market": "us", "currency": "USD", "metrics": {"pe": 10, "roe": None}}])
    got = spark.read.format("peer_json").option("rows", rows).load()
    assert {(r.metric, r.value) for r in got.collect()} == {("pe", 10.0), ("roe", None)}
    source = peers.PeerSource("t", "us", "USD", True, lambda s: s.range(1))
    peers.register(source)
    with pytest.raises(ValueError, match="already"):
        peers.register(source)
    peers.register(source, replace=True)
    assert "t" in peers.names() and peers.get("t").market == "us"


def test_audit_log_round_trip_and_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    events = spark.sql("SELECT '2024-01-01T00:01:00' AS ts, 'get' AS event, 'ALLOW' AS decision, 'h' AS host, 'p' AS purpose, 3L AS payload_bytes")
    files.append_audit(events, folder)
    assert files.read_audit(spark, folder).first().decision == "ALLOW"
    counts = audit.host_counts(audit.read_audit_stream(spark, folder))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("hosts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.host, r.n, r.bytes) for r in spark.table("hosts").collect()] == [("h", 1, 3)]


def test_index_and_cache(spark, tmp_path):
    c = spark.createDataFrame([("b", 1, "s"), ("a", 1, "s"), ("a", 2, "s")], "path string, chunk_no int, source string")
    n = retrieval.numbered(c, "path", "chunk_no")
    assert [r.chunk_id for r in n.orderBy("path", "chunk_no").collect()] == ["S1", "S2", "S3"]
    files.write_index(n, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where(F.col("source") == "s").count() == 3
    assert files.missing_pages(c, c.limit(0), ["path"]).count() == 3


def test_cut_numbers_keep_their_columns(spark):
    cases = [
        (["Loss", "(3,552", ")", "", "(1,044", ")"], ["Loss", "(3,552)", "", "", "(1,044)", ""]),
        (["$", "301,320", "$", "", "(5", ")"], ["$301,320", "", "$(5)", "", "", ""]),
        (["HK$", "(", "7", ")"], ["HK$(7)", "", "", ""]), ([")", "1"], [")", "1"]), (["$"], ["$"]), (["", ""], ["", ""]), ([], []), ([None, "2", ")"], ["", "2)", ""]),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a array<string>")
    got = {r.k: r.s for r in df.select("k", html.stitched(F.col("a")).alias("s")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, k
