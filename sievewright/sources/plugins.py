"""HTML readers as plug-ins: a data source by name, and a table function for columns.

``register(spark)`` makes both known to a session::

    spark.read.format("page_items").option("reader", "cards").load("/folder/of/json/lines")
    SELECT p.url, i.* FROM pages p, LATERAL page_items(p.html, p.url, 'cards') i
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.functions import udtf

from .html import READERS

NAME = "page_items"
ITEM = "url string, title string, summary string, published_at timestamp, ord int"
SCHEMA = f"file string, page string, {ITEM}"


def _reader(name: str):
    if name not in READERS:
        raise ValueError(f"unknown reader: {name}; one of {', '.join(sorted(READERS))}")
    return READERS[name]


class File(InputPartition):
    """One file of pages."""

    def __init__(self, uri: str):
        self.uri = uri


class PageReader(DataSourceReader):
    """Reads files of JSON lines with ``url`` and ``html``: one partition a file.

    Filters ``file = '...'`` choose the partitions; ``limit`` items a file are
    read at most, and what comes after them isn't parsed.
    """

    def __init__(self, options: dict):
        self.path, self.kind = options.get("path"), options.get("reader", "listing")
        self.limit = None if options.get("limit") is None else int(options["limit"])
        self.rules = json.loads(options.get("rules", "{}"))
        if not self.path:
            raise ValueError("page_items needs a path")
        _reader(self.kind)
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f

    def partitions(self) -> list[File]:
        store, root = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == pafs.FileType.Directory else [store.get_file_info(root)]
        names = sorted(x.path for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
        files = [File(n) for n in names if self.only is None or n in self.only]
        return files or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.uri:
            return
        store, _ = _store(self.path)
        parse, left = _reader(self.kind), self.limit
        with store.open_input_stream(partition.uri) as stream:
            for line in _lines(stream):
                if left is not None and left <= 0:
                    return
                page = json.loads(line)
                base = page.get("url") or ""
                for n, row in enumerate(parse(page.get("html") or "", base, **self.rules)):
                    if left is not None:
                        if left <= 0:
                            return
                        left -= 1
                    yield (partition.uri, base, *row, n)


def _store(path: str):
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream, a block in memory at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from filter(bytes.strip, whole)
    if rest.strip():
        yield rest


class PageItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


@udtf(returnType=ITEM)
class ItemsOf:
    """The items of one page: (html, base, reader); a null page has none."""

    def eval(self, html: str, base: str, reader: str):
        for n, row in enumerate(_reader(reader)(html or "", base or "")):
            yield (*row, n)


def register(spark: SparkSession) -> None:
    """Make the data source and the table function known by their name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageItems)
    spark.udtf.register(NAME, ItemsOf)
