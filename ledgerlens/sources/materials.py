"""Folders of landed files as Spark data sources.

``materials`` has a row for each page: a PDF's pages, a text file's slices, an HTML or fact file as a whole. ``material_cells`` has a row for each
cell of the tables of workbooks and HTML files. Files are listed by the driver, cut and bundled into partitions of about the same size, and read by the
tasks; what a query asks of path, kind and page decides which files and slices are opened. A file that can't be read is a row with its reason in ``gap``.

    materials.register(spark)
    spark.read.format("materials").load(folder).where("kind = 'html' and path like '.../2024/%'")
    rows.select("path", "text").write.format("materials").mode("append").save(folder)
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .documents import pdf_pages, workbook_cells
from .html import table_cells

PAGES = "path string, kind string, page int, text string, length long, modified timestamp, gap string"
CELLS = "path string, kind string, sheet string, table_no int, row_no int, col_no int, text string, tag string, gap string"
#: Kinds by suffix.
SUFFIXES = {"pdf": "pdf", "xlsx": "excel", "xls": "excel", "htm": "html", "html": "html", "txt": "text", "md": "text", "json": "facts"}
CELL_KINDS = {"excel", "html"}
#: Bytes that a slice of a text file has, and slices and files of one partition together.
SLICE_BYTES, PARTITION_BYTES = 4 << 20, 32 << 20


@dataclass(frozen=True)
class Slice:
    """A file, or the bytes from ``start`` to ``end`` of a text file, which is its page ``page``."""

    path: str
    kind: str
    size: int
    modified: datetime | None
    start: int = 0
    end: int = 0
    page: int = 1
    pages: tuple[int | None, int | None] = (None, None)


class Bundle(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


def filesystem(path: str):
    """(file system, path in it, what comes before that path) for a local path or a URI that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.normpath(path), ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.normpath("/" + path[5:].lstrip("/")), "file://"
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


@dataclass
class Wanted:
    """What filters ask for; what can't be said this way is left to Spark."""

    paths: set[str] | None = None
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    kinds: set[str] | None = None
    first: int | None = None
    last: int | None = None

    def take(self, f: Filter) -> bool:
        """Narrows by a filter; False where Spark must check it too."""
        column = getattr(f, "attribute", None)
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if column == ("path",) and values is not None:
            self.paths = values if self.paths is None else self.paths & values
        elif column == ("kind",) and values is not None:
            self.kinds = values if self.kinds is None else self.kinds & values
        elif column == ("path",) and isinstance(f, StringStartsWith):
            self.starts += (f.value,)
        elif column == ("path",) and isinstance(f, StringEndsWith):
            self.ends += (f.value,)
        elif column == ("page",):
            # files without pages that can be read have a row too, so Spark checks as well
            lo, hi = (min(values), max(values)) if values else (None, None)
            lo = f.value + 1 if isinstance(f, GreaterThan) else f.value if isinstance(f, GreaterThanOrEqual) else lo
            hi = f.value - 1 if isinstance(f, LessThan) else f.value if isinstance(f, LessThanOrEqual) else hi
            self.first = lo if self.first is None or (lo is not None and lo > self.first) else self.first
            self.last = hi if self.last is None or (hi is not None and hi < self.last) else self.last
            return False
        else:
            return False
        return True

    def fits(self, path: str, kind: str) -> bool:
        return (
            (self.paths is None or path in self.paths) and (self.kinds is None or kind in self.kinds)
            and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))
        )

    def has_page(self, page: int) -> bool:
        return (self.first is None or page >= self.first) and (self.last is None or page <= self.last)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kinds: set[str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.kinds = kinds
        self.slice_bytes = int(options.get("slicebytes", SLICE_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _slices(self) -> Iterator[Slice]:
        from pyarrow import fs

        store, root, scheme = filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        for info in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            inside = info.path[len(root) :].strip("/")
            kind = SUFFIXES.get(info.extension.lower())
            if kind not in self.kinds or any(p.startswith((".", "_")) for p in inside.split("/")) or not self.wanted.fits(scheme + info.path, kind):
                continue
            modified = datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc).replace(tzinfo=None) if info.mtime_ns else None
            one = Slice(scheme + info.path, kind, info.size, modified, end=info.size, pages=(self.wanted.first, self.wanted.last))
            if kind != "text":
                yield one
                continue
            for k in range(max(1, -(-info.size // self.slice_bytes))):
                if self.wanted.has_page(k + 1):
                    yield replace(one, start=k * self.slice_bytes, end=min(info.size, (k + 1) * self.slice_bytes), page=k + 1)

    def partitions(self) -> list[Bundle]:
        bundles, held, room = [], [], 0
        for s in self._slices():
            if held and room + s.end - s.start > self.partition_bytes:
                bundles.append(Bundle(held))
                held, room = [], 0
            held.append(s)
            room += s.end - s.start
        return [*bundles, Bundle(held)]

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for s in partition.slices:
            try:
                yield from self.rows(s, *_opened(s.path))
            except Exception as e:  # a broken file is a row, not the end of the job
                yield self.gap(s, f"unreadable: {type(e).__name__}")

    def rows(self, s: Slice, store, inside: str) -> Iterator[tuple]:
        raise NotImplementedError

    def gap(self, s: Slice, reason: str) -> tuple:
        raise NotImplementedError


def _opened(path: str):
    store, inside, _ = filesystem(path)
    return store, inside


def _whole(store, inside: str) -> bytes:
    with store.open_input_stream(inside, compression=None) as f:
        return f.read()


def _text_slice(store, inside: str, s: Slice, block: int = 1 << 16) -> str:
    """The lines that begin in the slice; a line goes to the slice in which it begins."""
    with store.open_input_file(inside) as f:
        start = s.start
        if start:
            f.seek(start - 1)
            while (part := f.read(block)) and b"\n" not in part:
                start += len(part)
            start = min(s.size, start + part.find(b"\n")) if part else s.size
        if start >= s.end and s.start:
            return ""
        f.seek(start)
        held = f.read(max(0, s.end - start))
        if s.end < s.size and not held.endswith(b"\n"):
            while part := f.read(block):
                at = part.find(b"\n")
                held += part if at < 0 else part[: at + 1]
                if at >= 0:
                    break
        return held.decode("utf-8", "replace")


class PageReader(_Reader):
    def rows(self, s: Slice, store, inside: str) -> Iterator[tuple]:
        told = lambda page, text, gap=None: (s.path, s.kind, page, text, s.size, s.modified, gap)
        if s.kind == "text":
            yield told(s.page, _text_slice(store, inside, s))
        elif s.kind == "pdf":
            lo, hi = s.pages
            for page, text, gap in pdf_pages(_whole(store, inside)):
                if page is None or ((lo is None or page >= lo) and (hi is None or page <= hi)):
                    yield told(page, text, gap)
        else:
            text = _whole(store, inside).decode("utf-8", "replace")
            if s.kind == "facts":
                json.loads(text)
            yield told(1, text)

    def gap(self, s: Slice, reason: str) -> tuple:
        return s.path, s.kind, None, None, s.size, s.modified, reason


class CellReader(_Reader):
    def rows(self, s: Slice, store, inside: str) -> Iterator[tuple]:
        content = _whole(store, inside)
        if s.kind == "html":
            for table_no, r, c, text, tag in table_cells(content.decode("utf-8", "replace")):
                yield s.path, s.kind, None, table_no, r, c, text, tag, None
        else:
            for sheet, r, c, value, gap in workbook_cells(inside, content):
                yield s.path, s.kind, sheet, None, r, c, value, None, gap

    def gap(self, s: Slice, reason: str) -> tuple:
        return s.path, s.kind, None, None, None, None, None, None, reason


class FileWriter(DataSourceWriter):
    """A file for each row: ``path`` below the folder, ``text`` as UTF-8. Written beside and renamed, so a task that runs again gives the same files."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.path_at, self.text_at = schema.names.index("path"), schema.names.index("text")

    def write(self, iterator) -> WriterCommitMessage:
        import os
        import uuid

        store, root, _ = filesystem(self.root)
        made: set[str] = set()
        for row in iterator:
            inside = posixpath.normpath(posixpath.join(root, row[self.path_at]))
            if not inside.startswith(root + "/"):
                raise ValueError(f"{row[self.path_at]} lies outside the folder")
            folder = posixpath.dirname(inside)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            beside = f"{folder}/.{os.getpid()}-{uuid.uuid4().hex}"
            with store.open_output_stream(beside, compression=None) as f:
                f.write((row[self.text_at] or "").encode())
            store.move(beside, inside)
        return WriterCommitMessage()


class Materials(DataSource):
    @classmethod
    def name(cls) -> str:
        return "materials"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options), set(SUFFIXES.values()) - {"excel"})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), schema, overwrite)


class MaterialCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "material_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return CellReader(dict(self.options), CELL_KINDS)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, with filters handed on to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Materials)
    spark.dataSource.register(MaterialCells)
