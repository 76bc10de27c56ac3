"""TIFF pages as a Spark data source: ``spark.read.format("tiff_pages").load(folder)``, and the same as a stream.

A row is a band of rows of a page.  Small files are dealt to tasks whole; of files above ``partition_bytes`` the
directories are read when the plan is made, and their pages and bands are dealt to tasks.  Tasks read ranges: a page's
directory and the chunks of the bands asked for.  Filters on ``page`` are taken over, so other pages aren't read.

Options: ``partition_bytes`` (pixels of one task), ``band_bytes`` (pixels of one row).  Paths are those that Arrow's
file systems open (local ones, S3, GCS, HDFS).  A file or page that can't be read gives a row with its error.

The stream has the count of files as its offset; files are taken in the order of their paths, so that new files have
to sort behind those there (times, running numbers).
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from lumenframe.functions import tiff

PAGE_SCHEMA = "path string, page int, first_row int, height int, width int, planes int, dtype string, shape array<int>, data binary, bytes_read long, error string"
PARTITION_BYTES, BAND_BYTES = 64 << 20, 16 << 20
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda page, pages: page in pages}


@dataclass
class Work(InputPartition):
    """Files taken whole, or (page, first, stop) bands of one large file."""

    files: list[str]
    bands: list[tuple[int, int, int]] | None = None


@dataclass
class Counted:
    """Range reads of a file, counted."""

    path: str
    total: int = 0
    handle: pa.NativeFile = field(init=False)

    def __post_init__(self) -> None:
        system, path = located(self.path)
        self.handle = system.open_input_file(path)

    def __call__(self, offset: int, size: int) -> bytes:
        self.handle.seek(offset)
        out = self.handle.read(size)
        self.total += len(out)
        return out


def located(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the TIFF files at or below a path, in the order of paths."""
    system, inner = located(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


def band_row(path: str, number: int, page: tiff.Page, read: Counted, first: int, stop: int) -> tuple:
    before = read.total
    try:
        x = page.pixels(read, first, stop)
        return path, number, first * page.chunk[0], page.height, page.width, page.planes, str(x.dtype), list(x.shape), x.tobytes(), read.total - before, None
    except Exception as e:
        return path, number, first * page.chunk[0], page.height, page.width, page.planes, None, None, None, read.total - before, str(e)


def file_rows(path: str, band_bytes: int, wanted: Callable[[int], bool], bands: list[tuple[int, int, int]] | None = None) -> Iterator[tuple]:
    try:
        read = Counted(path)
        found, _ = tiff.pages(read)
    except Exception as e:
        yield path, None, None, None, None, None, None, None, None, None, str(e)
        return
    if bands is None:
        bands = [(k, *band) for k, page in enumerate(found) if wanted(k) for band in page.bands(band_bytes)]
    for number, first, stop in bands:
        yield band_row(path, number, found[number], read, first, stop)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.band_bytes = min(self.partition_bytes, int(options.get("band_bytes", BAND_BYTES)))
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and f.attribute == ("page",) and getattr(f, "value", None) is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def wanted(self, page: int) -> bool:
        return all(COMPARED[kind](page, value) for kind, value in self.tests)

    def partitions(self) -> list[Work]:
        return dealt(listed(self.path), self)

    def read(self, partition: Work) -> Iterator[tuple]:
        for path in partition.files:
            for row in file_rows(path, self.band_bytes, self.wanted, partition.bands):
                if row[1] is not None or not self.tests:  # the error of a file has no page, so no filter on pages keeps it
                    yield row


def dealt(files: list[tuple[str, int]], reader: PageReader) -> list[Work]:
    """Work of about ``partition_bytes``: small files together, bands of large files."""
    out, held, size = [], [], 0
    for path, n in files:
        if n > reader.partition_bytes:
            out += _large(path, reader)
            continue
        if held and size + n > reader.partition_bytes:
            out.append(Work(held))
            held, size = [], 0
        held, size = [*held, path], size + n
    return out + ([Work(held)] if held else [])


def _large(path: str, reader: PageReader) -> list[Work]:
    try:
        found, _ = tiff.pages(Counted(path))
    except Exception:
        return [Work([path])]  # its task tells the error
    out, held, size = [], [], 0
    for k, page in enumerate(found):
        if not reader.wanted(k):
            continue
        for first, stop in page.bands(reader.band_bytes):
            n = (stop - first) * page.chunk[0] * page.width * page.planes * page.dtype.itemsize
            if held and size + n > reader.partition_bytes:
                out.append(Work([path], held))
                held, size = [], 0
            held, size = [*held, (k, first, stop)], size + n
    return out + ([Work([path], held)] if held else [])


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reader = PageReader(options)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(listed(self.reader.path))}

    def partitions(self, start: dict, end: dict) -> list[Work]:
        return dealt(listed(self.reader.path)[start["files"] : end["files"]], self.reader)

    def read(self, partition: Work) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class TiffPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make ``tiff_pages`` known to a session, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffPages)
    return spark
