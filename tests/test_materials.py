"""Landed files by Spark's own reader interface."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from ledgerlens.sources import files, materials


@pytest.fixture
def folder(tmp_path):
    for name, data in {
        "a/notes.txt": "eins\nzwei ü\n".encode() + b"bad \xff byte\n", "a/big.md": b"".join(b"line %d\n" % i for i in range(1000)), "b/page.html": b"<table><tr><td>x<td name=1>y</table>",
        "b/facts.json": b'{"cik": 1, "facts": {}}', "b/broken.json": b"{", "b/broken.pdf": b"no pdf", "b/broken.xlsx": b"no workbook", ".hidden/x.txt": b"h", "a/other.bin": b"?", "a/empty.txt": b"",
    }.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def short(rows):
    return sorted((r.path.rsplit("/", 1)[1], r.page, r.text, bool(r.gap)) for r in rows if not r.path.endswith("big.md"))


def test_pages_and_gaps(spark, folder):
    materials.register(spark)
    got = spark.read.format("materials").load(str(folder)).collect()
    rows = {r.path.rsplit("/", 1)[1]: r for r in got}
    assert set(rows) == {"notes.txt", "big.md", "page.html", "facts.json", "broken.json", "broken.pdf", "empty.txt"}
    assert rows["notes.txt"].text == "eins\nzwei ü\nbad � byte\n" and rows["empty.txt"].text == "" and rows["notes.txt"].modified is not None
    assert [bool(rows[n].gap) for n in ("notes.txt", "facts.json", "broken.json", "broken.pdf")] == [False, False, True, True] and rows["broken.json"].page is None
    facts = spark.read.format("materials").load(str(folder)).where("kind = 'facts' and gap is null")
    assert files.flatten_facts(facts, "text").count() == 0 and facts.count() == 1


@pytest.mark.parametrize("size", [1, 7, 100, 1000, 10**6])
def test_slices_hold_each_line_once(spark, folder, size):
    materials.register(spark)
    df = spark.read.format("materials").option("sliceBytes", size if size > 1 else 3).option("partitionBytes", 50 * size).load(str(folder)).where(F.col("path").endswith("big.md"))
    text = "".join(r.text for r in df.orderBy("page").collect())
    assert text == "".join(f"line {i}\n" for i in range(1000))
    if size == 1000:
        assert df.rdd.getNumPartitions() == 1 and df.where("page between 3 and 4").count() == 2


def test_cells(spark, folder):
    materials.register(spark)
    got = {(r.path.rsplit("/", 1)[1], r.row_no, r.col_no): (r.text, bool(r.gap)) for r in spark.read.format("material_cells").load(str(folder)).collect()}
    assert got == {("page.html", 1, 0): ("x", False), ("page.html", 1, 1): ("y", False), ("broken.xlsx", None, None): (None, True)}


def test_filters_decide_what_is_opened(folder):
    def reader(*filters):
        r = materials.PageReader({"path": str(folder), "sliceBytes": "1000"}, {"text", "html", "facts", "pdf"})
        left = list(r.pushFilters(list(filters)))
        return sorted((s.path.rsplit("/", 1)[1], s.page) for b in r.partitions() for s in b.slices), left

    path = EqualTo(("path",), str(folder / "a/notes.txt"))
    assert reader(path) == ([("notes.txt", 1)], [])
    assert [n for n, _ in reader(StringStartsWith(("path",), str(folder / "b")))[0]] == ["broken.json", "broken.pdf", "facts.json", "page.html"]
    page = GreaterThan(("page",), 7)
    got, left = reader(In(("kind",), ("text",)), page)
    assert got == [("big.md", 8), ("big.md", 9)] and left == [page]


def test_files_from_rows(spark, folder, tmp_path):
    materials.register(spark)
    out = tmp_path / "out"
    df = spark.createDataFrame([("x/1.txt", "ü"), ("x/2.html", None)], "path string, text string")
    for _ in range(2):
        df.write.format("materials").mode("append").save(str(out))
    got = spark.read.format("materials").load("file://" + str(out)).collect()
    assert short(got) == [("1.txt", 1, "ü", False), ("2.html", 1, "", False)] and got[0].path.startswith("file:///")
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([("../y.txt", "")], "path string, text string").write.format("materials").mode("append").save(str(out))
