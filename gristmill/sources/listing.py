"""A paged listing as a Spark data source, in batches and as a stream: pages follow a cursor until nothing new comes.

The service is a callable from (since, page) to rows, given by import path, so that tests and offline runs use a file.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib import import_module
from itertools import pairwise

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gristmill.sources import shared
from gristmill.storage import scratch_path

PAGE_ROWS, PAGES, WINDOWS = 250, 20, 50


def walk(fetch: Callable[[str, int], list[dict]], since: str = "", page_rows: int = PAGE_ROWS, pages: int = PAGES) -> Iterator[dict]:
    """All rows in order of ``modified``: pages up to the service's cap, then again from the last time seen; rows come once."""
    seen: set[str] = set()
    while True:
        last = since
        fresh = 0
        for page in range(1, pages + 1):
            rows = fetch(since, page)
            for r in rows:
                last = max(last, r["modified"])
                if r["id"] not in seen:
                    seen.add(r["id"])
                    fresh += 1
                    yield r
            if len(rows) < page_rows:
                return
        if last == since or not fresh:
            return
        since = last


def from_file(path: str, page_rows: int = PAGE_ROWS) -> Callable[[str, int], list[dict]]:
    """A stand-in for a service: JSON lines with id and modified."""
    rows = sorted((json.loads(x) for x in open(path)), key=lambda r: (r["modified"], r["id"]))

    def fetch(since: str, page: int) -> list[dict]:
        return [r for r in rows if r["modified"] >= since][(page - 1) * page_rows : page * page_rows]

    return fetch


def in_order(rows: DataFrame, name: str) -> str:
    """Store a table as ``from_table`` serves it, by modified and id in small row groups; its path."""
    path = scratch_path(rows.sparkSession, name)
    rows.orderBy("modified", "id").write.option("parquet.block.size", 1 << 20).parquet(path)
    return path


def from_table(path: str, page_rows: int = PAGE_ROWS) -> Callable[[str, int], list[dict]]:
    """A stand-in for a service: a table that ``in_order`` stored, in pages by modified and id.

    Of the table, footers are read at first and then the row groups in which a page lies; two are kept.
    """
    import pyarrow.parquet as pq

    where, at = shared.located(path)
    groups, tops, ends = [], [], []  # file and number of a row group, its last time, rows up to its end
    for f in sorted(x.path for x in where.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")):
        with where.open_input_file(f) as opened:
            meta = pq.read_metadata(opened)
        column = meta.schema.names.index("modified")
        for i in range(meta.num_row_groups):
            times = meta.row_group(i).column(column).statistics
            if tops and times.min < tops[-1]:
                raise ValueError(f"{path} isn't stored in order of modified")
            groups.append((f, i))
            tops.append(times.max)
            ends.append((ends[-1] if ends else 0) + meta.row_group(i).num_rows)

    @lru_cache(2)
    def group(k: int):
        with where.open_input_file(groups[k][0]) as opened:
            rows = pq.ParquetFile(opened).read_row_group(groups[k][1])
        return rows, rows.column("modified").to_pylist(), ends[k] - rows.num_rows

    def fetch(since: str, page: int) -> list[dict]:
        k = bisect_left(tops, since)
        if k == len(tops):
            return []
        at = group(k)[2] + bisect_left(group(k)[1], since) + (page - 1) * page_rows
        out: list[dict] = []
        while len(out) < page_rows and at + len(out) < ends[-1]:
            rows, _, before = group(bisect_right(ends, at + len(out)))
            out += rows.slice(at + len(out) - before, page_rows - len(out)).to_pylist()
        return out

    return fetch


class Stalled(RuntimeError):
    """More rows share one time than the service lists: no cursor gets past them."""


def window(fetch: Callable[[str, int], list[dict]], start: dict, page_rows: int = PAGE_ROWS, pages: int = PAGES) -> tuple[list[dict], dict]:
    """The rows behind a cursor, as far as the service lists them at once, and the cursor behind those.

    A cursor is the last time seen and the ids seen at that time, as the service lists that time again.
    """
    known, out, full = set(start["seen"]), {}, True
    for page in range(1, pages + 1):
        rows = fetch(start["since"], page)
        out |= {r["id"]: r for r in rows if not (r["modified"] == start["since"] and r["id"] in known)}
        if len(rows) < page_rows:
            full = False
            break
    last = max((r["modified"] for r in out.values()), default=start["since"])
    if full and last == start["since"]:
        raise Stalled(f"{pages * page_rows} rows or more were modified at {last!r}")
    seen = {i for i, r in out.items() if r["modified"] == last} | (known if last == start["since"] else set())
    return list(out.values()), {"since": last, "seen": sorted(seen)}


def behind(fetch: Callable[[str, int], list[dict]], start: dict, page_rows: int = PAGE_ROWS, pages: int = PAGES) -> dict:
    """The cursor that ``window`` ends with, from the last page alone where the service lists so many (and one time doesn't fill it)."""
    rows = fetch(start["since"], pages)
    if len(rows) < page_rows:
        return window(fetch, start, page_rows, pages)[1]
    last = max(r["modified"] for r in rows)
    if last == start["since"]:
        raise Stalled(f"{pages * page_rows} rows or more were modified at {last!r}")
    seen, page = {r["id"] for r in rows if r["modified"] == last}, pages
    while page > 1 and all(r["modified"] == last for r in rows):
        page -= 1
        rows = fetch(start["since"], page)
        seen |= {r["id"] for r in rows if r["modified"] == last}
    return {"since": last, "seen": sorted(seen)}


def between(fetch: Callable[[str, int], list[dict]], start: dict, end: dict, page_rows: int = PAGE_ROWS, pages: int = PAGES) -> Iterator[dict]:
    """The rows between two cursors, as they are listed now: a batch that is done again."""
    ends = set(end["seen"])
    while True:
        rows, after = window(fetch, start, page_rows, pages)
        yield from (r for r in rows if r["modified"] < end["since"] or r["modified"] == end["since"] and r["id"] in ends)
        if after["since"] >= end["since"] or not rows:
            return
        start = after


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "id string, modified string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Service:
    """What the options name: how the service is asked, and how much it lists at once."""

    def __init__(self, options):
        self.options = options
        self.limits = int(options.get("pagerows", PAGE_ROWS)), int(options.get("pages", PAGES))

    def fetch(self) -> Callable[[str, int], list[dict]]:
        module, _, name = self.options.get("service", "gristmill.sources.listing:from_file").partition(":")
        return getattr(import_module(module), name)(self.options["path"], self.limits[0])

    @staticmethod
    def row(r: dict) -> tuple[str, str, str]:
        return r["id"], r["modified"], json.dumps({k: v for k, v in r.items() if k not in ("id", "modified")}, sort_keys=True)


class _Reader(_Service, DataSourceReader):
    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from map(self.row, walk(self.fetch(), self.options.get("since", ""), *self.limits))


class _Span(InputPartition):
    """The rows between two cursors."""

    def __init__(self, start: dict, end: dict):
        self.start, self.end = start, end


class _StreamReader(_Service, DataSourceStreamReader):
    """A batch is some windows, each of which is what the service lists at once; its offset is the cursor behind them.

    The driver asks for cursors, tasks for rows, one for each window.
    """

    def __init__(self, options):
        super().__init__(options)
        self.windows = int(options.get("windows", WINDOWS))
        self.at: dict | None = None
        self.planned: list[dict] = []

    def initialOffset(self) -> dict:
        return {"since": self.options.get("since", ""), "seen": []}

    def latestOffset(self) -> dict:
        if not hasattr(self, "asked"):
            self.asked = self.fetch()
        self.planned = [self.at or self.initialOffset()]
        for _ in range(self.windows):
            try:
                end = behind(self.asked, self.planned[-1], *self.limits)
            except Exception:
                if len(self.planned) == 1:
                    raise
                break  # what came before is a batch, and the next one is asked for this again
            if end == self.planned[-1]:
                break
            self.planned.append(end)
        self.at = self.planned[-1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A batch of an earlier run, which Spark asks for first when it goes on, is one task."""
        self.at = self.at or end
        cuts = self.planned if self.planned and (self.planned[0], self.planned[-1]) == (start, end) else [start, end]
        return [_Span(a, b) for a, b in pairwise(cuts) if a != b]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return map(self.row, between(self.fetch(), partition.start, partition.end, *self.limits))

    def commit(self, end: dict) -> None:
        self.at = self.at or end


def _options(path: str, since: str, page_rows: int, pages: int, service: str) -> dict[str, str]:
    return {"path": path, "since": since, "pagerows": str(page_rows), "pages": str(pages), "service": service}


FILE = "gristmill.sources.listing:from_file"


def read_listing(spark: SparkSession, path: str, since: str = "", page_rows: int = PAGE_ROWS, pages: int = PAGES, service: str = FILE) -> DataFrame:
    """One task: each page is asked for with what the one before told."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").options(**_options(path, since, page_rows, pages, service)).load()


def stream_listing(spark: SparkSession, path: str, since: str = "", page_rows: int = PAGE_ROWS, pages: int = PAGES, service: str = FILE, windows: int = WINDOWS) -> DataFrame:
    """The listing as a stream, up to ``windows`` times ``pages`` pages a batch; its place survives in the checkpoint of the query that reads it."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").options(windows=str(windows), **_options(path, since, page_rows, pages, service)).load()
