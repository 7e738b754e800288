"""Recorded answers of search services as a data source, for batches and streams.

``spark.read.format("recorded_answers").option("path", folder).load()`` gives the table that the connectors read: source,
query, page, status, payload. The folder, on any file system that Arrow opens, holds one file for each answer,
``<source>/<page>/<query>.json`` or, for XML, ``.xml``; an answer that did not come is recorded as ``<query>.<status>``.
A partition is a page of a service, so that services and pages are read side by side and an executor that is lost costs its
page only. A page that can not be read is a row with status 599 and the reason as its payload, and does not end the job.

As a stream each service is read page by page: an offset is the number of pages taken of each service, and pages that are
recorded later come with the next batch. Options ``sources`` (names separated by commas) and ``pages`` (the most to read).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, query int, page int, status int, payload string"
UNREADABLE = 599


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _listed(system, folder: str, kind) -> list[str]:
    from pyarrow import fs

    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == kind)


class Page(InputPartition):
    def __init__(self, source: str, page: int):
        self.source, self.page = source, page


class _Pages:
    """What batches and streams share: which pages there are, and their rows."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("recorded_answers needs the option path")
        self.path = options["path"].rstrip("/")
        self.only = {s.strip() for s in options.get("sources", "").split(",") if s.strip()}
        self.most = int(options["pages"]) if options.get("pages") else None

    def found(self) -> dict[str, list[int]]:
        from pyarrow import fs

        system, root = _opened(self.path)
        out = {}
        for source in _listed(system, root, fs.FileType.Directory):
            if not self.only or source in self.only:
                pages = sorted(int(p) for p in _listed(system, f"{root}/{source}", fs.FileType.Directory) if p.isdigit())
                out[source] = pages if self.most is None else [p for p in pages if p < self.most]
        return out

    def rows(self, part: Page) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        cells = []
        try:
            system, root = _opened(self.path)
            folder = f"{root}/{part.source}/{part.page}"
            for name in _listed(system, folder, fs.FileType.File):
                query, _, kind = name.partition(".")
                if not query.isdigit():
                    continue
                if kind in ("json", "xml"):
                    try:
                        with system.open_input_stream(f"{folder}/{name}") as f:
                            cells.append((part.source, int(query), part.page, 200, f.read().decode()))
                    except (OSError, UnicodeDecodeError) as e:
                        cells.append((part.source, int(query), part.page, UNREADABLE, f"{type(e).__name__}: {e}"))
                elif kind.isdigit():
                    cells.append((part.source, int(query), part.page, int(kind), None))
        except OSError as e:
            cells.append((part.source, 0, part.page, UNREADABLE, f"{type(e).__name__}: {e}"))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = ["source", "query", "page", "status", "payload"]
        cells.sort(key=lambda c: c[1])
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], k) for i, k in enumerate(kinds)], names=names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self):
        return [Page(s, p) for s, pages in self.pages.found().items() for p in pages]

    def read(self, partition):
        if isinstance(partition, Page):  # none is given where there are no pages
            yield from self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each service the number of pages that are there without a gap."""
        out = {}
        for source, pages in self.pages.found().items():
            n = 0
            while n < len(pages) and pages[n] == n:
                n += 1
            out[source] = n
        return out

    def partitions(self, start: dict, end: dict):
        return [Page(s, p) for s in sorted(end) for p in range(start.get(s, 0), end[s])]

    def read(self, partition):
        yield from self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(RecordedAnswers)
