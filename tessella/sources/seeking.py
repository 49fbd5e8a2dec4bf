"""Row ranges of matrices in archives, read by seeking: only the headers and the bytes of the rows asked for.

An index has a line an entry, 'key path:offset', with a range such as [2:9] or [2:9,0:3] behind it where only those rows and
columns are meant; ends are inclusive. Splits are pieces of the index, so one archive of any size is read by many tasks; without an
index each archive is one stream, of which one entry is held at a time.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(seeking.MatrixRows)
    spark.read.format("matrix-rows").option("index", True).load(path).where("row BETWEEN 10 AND 19")
"""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .archives import FLOATS, piecewise

ROWS = "key string, row int, feat array<double>"
#: Bytes that are read at once around headers; of an index in a split, and values in an Arrow batch, at most.
BUFFER = 4096
SPLIT = 1 << 20
BATCH_VALUES = 1 << 20


@dataclass(frozen=True)
class Span:
    """Rows or columns from first to last, both inside; None is the end there is."""

    first: int = 0
    last: int | None = None

    def of(self, size: int) -> tuple[int, int]:
        return min(self.first, size), size if self.last is None else max(min(self.first, size), min(self.last + 1, size))

    def inside(self, other: Span) -> Span:
        """This span of what the other spans."""
        last = None if self.last is None else other.first + self.last
        ends = [x for x in (last, other.last) if x is not None]
        return Span(other.first + self.first, min(ends) if ends else None)


@dataclass(frozen=True)
class Address:
    """Where an entry lies: a file, the byte behind its key, and what is wanted of it."""

    path: str
    offset: int | None = None
    rows: Span = Span()
    cols: Span = Span()

    @classmethod
    def parse(cls, text: str) -> Address:
        """An address such as 'ark:a.ark:12[0:9,3:4]'; shell pipes, and offsets into compressed files, are refused."""
        text = re.sub(r"^(?:ark|scp)(?:,\w+)*:", "", text.strip())
        if text.endswith("|") or text.startswith("|"):
            raise ValueError(f"a shell pipe is not read: {text}")
        m = re.fullmatch(r"(.*?)(?::(\d+))?(?:\[(?:(\d+):(\d+))?(?:,(\d+):(\d+))?\])?", text)
        number = [None if m[i] is None else int(m[i]) for i in range(2, 7)]
        spans = [Span() if a is None else Span(a, b) for a, b in (number[1:3], number[3:5])]
        if number[0] and m[1].endswith(".gz"):
            raise ValueError(f"a compressed file has no offsets: {text}")
        return cls(m[1], number[0], *spans)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def opened(path: str) -> BinaryIO:
    """A file to read and seek in; compressed ones are read as streams, where seeking forward reads on."""
    store, base = store_of(path)
    found = store.open_input_file(base)
    return gzip.GzipFile(fileobj=found) if base.endswith(".gz") else io.BufferedReader(found, BUFFER)


def exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise EOFError(f"{n} bytes expected, {len(data)} found")
    return data


def read_key(f: BinaryIO) -> str | None:
    """The key at the file's place, and the blank behind it; None at the end."""
    out = bytearray()
    while (c := f.read(1)) not in (b"", b" "):
        out += c
    return out.decode().strip() or None


def header(f: BinaryIO) -> tuple[bytes, int, int, int, tuple[float, float]]:
    """(token, rows, columns, bytes of the values, range of packed values) of the binary entry at the file's place; the token is empty for text."""
    if (mark := exactly(f, 2)) != b"\0B":
        f.seek(-len(mark), 1)
        return b"", 0, 0, 0, (0.0, 0.0)
    token = exactly(f, 3)
    if token == b"CM ":
        low, span, rows, cols = struct.unpack("<ffii", exactly(f, 16))
        return token, rows, cols, cols * (8 + rows), (low, span)
    if token not in FLOATS:
        raise ValueError(f"unknown type of entry: {token!r}")
    rows = struct.unpack("<xi", exactly(f, 5))[0]
    cols = struct.unpack("<xi", exactly(f, 5))[0] if token.endswith(b"M ") else 0
    if not cols and token.endswith(b"V "):
        rows, cols = 1, rows
    return token, rows, cols, rows * cols * int(FLOATS[token][-1]), (0.0, 0.0)


def text_lines(f: BinaryIO) -> Iterator[list[float]]:
    """The rows of a text entry, up to its closing bracket; bytes are read one line at a time."""
    while line := f.readline():
        end = b"]" in line
        values = line.split(b"]")[0].replace(b"[", b" ").split()
        if values:
            yield [float(v) for v in values]
        if end:
            return


def read_entry(f: BinaryIO, rows: Span = Span(), cols: Span = Span()) -> tuple[int, np.ndarray]:
    """(first row, values of those rows and columns) of the entry at the file's place, which then is behind the entry. A vector is a matrix of one row.

    Of a matrix stored by rows the bytes of these rows are read; of a packed one, which is stored by columns, the marks and these rows of each column.
    """
    token, n, width, size, (low, span) = header(f)
    if not token:
        kept = [line for i, line in enumerate(text_lines(f)) if i >= rows.first and (rows.last is None or i <= rows.last)]
        values = np.array(kept, np.float64) if kept else np.zeros((0, 0))
        a, b = cols.of(values.shape[1])
        return rows.first, values[:, a:b]
    begin = f.tell()
    (a, b), (c, d) = rows.of(n), cols.of(width)
    if token == b"CM ":
        f.seek(begin + 8 * c)
        marks = np.frombuffer(exactly(f, 8 * (d - c)), "<u2").reshape(d - c, 4) * (span / 65535.0) + low
        codes = np.zeros((d - c, b - a))
        for k in range(c, d):
            f.seek(begin + 8 * width + k * n + a)
            codes[k - c] = np.frombuffer(exactly(f, b - a), np.uint8)
        values = piecewise(codes, marks).T if d > c else np.zeros((b - a, 0))
    else:
        kind = np.dtype(FLOATS[token])
        f.seek(begin + a * width * kind.itemsize)
        values = np.frombuffer(exactly(f, (b - a) * width * kind.itemsize), kind).reshape(b - a, width)[:, c:d].astype(np.float64)
    f.seek(begin + size)
    return a, values


def skim(f: BinaryIO) -> Iterator[tuple[str, int, int, int]]:
    """(key, offset, rows, columns) of every binary entry; values are passed over, not read. Of text entries rows and columns are 0."""
    while (key := read_key(f)) is not None:
        offset = f.tell()
        token, rows, cols, size, _ = header(f)
        yield key, offset, rows, cols
        if token:
            f.seek(size, 1)
        else:
            for _ in text_lines(f):
                pass


def files_below(path: str) -> list[tuple[str, int]]:
    """(uri, size) of a file or of all files in a folder."""
    store, base = store_of(path)
    scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """key, address ('path:offset'), rows and cols of every entry of the archives below a path: what an index holds, made from headers only."""
    paths = [(p,) for p, _ in files_below(path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with opened(p) as f:
                    part = []
                    for key, offset, rows, cols in skim(f):
                        part.append((key, f"{p}:{offset}", rows, cols))
                        if len(part) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["key", "address", "rows", "cols"])
                            part = []
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["key", "address", "rows", "cols"])

    listed = spark.createDataFrame(paths, "path string").repartition(max(1, min(len(paths), 10_000)))
    return listed.mapInArrow(run, "key string, address string, rows int, cols int")


@dataclass
class IndexPart(InputPartition):
    """Lines of an index file that begin from start up to end."""

    path: str
    start: int
    end: int


@dataclass
class Archive(InputPartition):
    path: str


@dataclass(frozen=True)
class Wanted:
    """What filters leave: rows, and keys (None: all)."""

    rows: Span = Span()
    keys: frozenset | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With a filter as well, or None if it can't be used."""
        at = getattr(f, "attribute", None)
        first, last = self.rows.first, self.rows.last
        upto = lambda x: x if last is None else min(last, x)
        if at == ("key",) and isinstance(f, (EqualTo, In)):
            own = frozenset(f.value if isinstance(f, In) else [f.value])
            return replace(self, keys=own if self.keys is None else self.keys & own)
        if at == ("row",) and isinstance(f, EqualTo):
            return replace(self, rows=Span(max(first, f.value), upto(f.value)))
        if at == ("row",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return replace(self, rows=Span(max(first, f.value + isinstance(f, GreaterThan)), last))
        if at == ("row",) and isinstance(f, (LessThan, LessThanOrEqual)):
            return replace(self, rows=Span(first, upto(f.value - isinstance(f, LessThan))))
        return None


class MatrixRows(DataSource):
    """spark.read.format('matrix-rows').load(path): key, row and feat of the matrices of archives, or with option('index', True) of the entries of index files."""

    @classmethod
    def name(cls) -> str:
        return "matrix-rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], str(self.options.get("index", "")).lower() == "true", int(self.options.get("split", SPLIT)))


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, index: bool, split: int):
        self.path, self.index, self.split, self.wanted = path, index, split, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self) -> list[InputPartition]:
        files = files_below(self.path)
        if not self.index:
            return [Archive(p) for p, _ in files]
        return [IndexPart(p, s, min(s + self.split, size)) for p, size in files for s in range(0, size, self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        keys, feats, rows, held = [], [], [], 0
        for key, first, values in by_index(partition, self.wanted) if isinstance(partition, IndexPart) else in_order(partition.path, self.wanted):
            keys += [key] * len(values)
            rows.append(np.arange(first, first + len(values), dtype=np.int32))
            feats.append(values)
            held += values.size
            if held >= BATCH_VALUES:
                yield as_batch(keys, rows, feats)
                keys, feats, rows, held = [], [], [], 0
        if keys:
            yield as_batch(keys, rows, feats)


def as_batch(keys: list[str], rows: list[np.ndarray], feats: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.concatenate([np.full(len(v), v.shape[1]) for v in feats])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([v.ravel() for v in feats])))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(rows)), lists], names=["key", "row", "feat"])


def index_lines(part: IndexPart) -> Iterator[tuple[str, Address]]:
    """The entries of a piece of an index; a line belongs to the piece in which it begins."""
    with opened(part.path) as f:
        if part.start:
            f.seek(part.start - 1)
            f.readline()
        while f.tell() < part.end and (line := f.readline()):
            found = line.decode().split(maxsplit=1)
            if len(found) == 2:
                yield found[0], Address.parse(found[1])


def by_index(part: IndexPart, wanted: Wanted) -> Iterator[tuple[str, int, np.ndarray]]:
    """(key, first row, values) of the entries of a piece of an index. Rows are numbered from the first of the entry's own range, as this is what the entry is."""
    f, at = None, None
    try:
        for key, address in index_lines(part):
            if wanted.keys is not None and key not in wanted.keys:
                continue
            if f is None or at != address.path:
                if f is not None:
                    f.close()
                f, at = opened(address.path), address.path
            f.seek(address.offset or 0)
            if address.offset is None:
                read_key(f)
            _, values = read_entry(f, wanted.rows.inside(address.rows), address.cols)
            if len(values):
                yield key, wanted.rows.first, values
    finally:
        if f is not None:
            f.close()


def in_order(path: str, wanted: Wanted) -> Iterator[tuple[str, int, np.ndarray]]:
    """(key, first row, values) of the entries of an archive, one after the other."""
    with opened(path) as f:
        while (key := read_key(f)) is not None:
            if wanted.keys is not None and key not in wanted.keys:
                read_entry(f, Span(0, -1))
                continue
            first, values = read_entry(f, wanted.rows)
            if len(values):
                yield key, first, values
