"""Keyed binary archives of vectors and matrices, read and written as (key, rows, columns, values).

An entry is a key, a blank, the bytes 0 and B, a type token and, behind the byte 4 each, the sizes as 32-bit
integers; then little-endian values by rows. Text entries are 'key [ v v v ]'.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type tokens of the format, with numpy types.
FLOATS = {b"FV ": "<f4", b"DV ": "<f8", b"FM ": "<f4", b"DM ": "<f8"}
SCHEMA = "key string, rows int, cols int, values array<double>"


def entries(data: bytes) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """The entries of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b" ", at)
        key, at = data[at:end].decode().strip(), end + 1
        if data[at : at + 2] == b"\0B":
            token, at = data[at + 2 : at + 5], at + 5
            if token == b"CM ":
                low, span, rows, cols = struct.unpack_from("<ffii", data, at)
                at += 16
                marks = np.frombuffer(data, "<u2", 4 * cols, at).reshape(cols, 4) * (span / 65535.0) + low
                at += 8 * cols
                codes = np.frombuffer(data, np.uint8, rows * cols, at).reshape(cols, rows).astype(float)
                at += rows * cols
                yield key, rows, cols, piecewise(codes, marks).T
                continue
            matrix = token.endswith(b"M ")
            rows, at = struct.unpack_from("<i", data, at + 1)[0], at + 5
            cols = 1
            if matrix:
                cols, at = struct.unpack_from("<i", data, at + 1)[0], at + 5
            kind = np.dtype(FLOATS[token])
            values = np.frombuffer(data, kind, rows * cols, at).astype(float)
            at += rows * cols * kind.itemsize
            yield key, (rows if matrix else 1), (cols if matrix else rows), values.reshape(rows, cols) if matrix else values
        else:
            end = data.index(b"]", at)
            lines = [x.split() for x in data[at:end].decode().replace("[", "").strip().splitlines()]
            values = np.array([[float(v) for v in x] for x in lines if x])
            at = data.find(b"\n", end) + 1 or len(data)
            yield key, values.shape[0], values.shape[1] if values.ndim > 1 else 0, values


def piecewise(codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Eight-bit codes to values, linear between the 0, 25, 75 and 100 % marks of each column, which stand at 0, 64, 192 and 255."""
    stops = np.array([0.0, 64.0, 192.0, 255.0])
    return np.stack([np.interp(c, stops, m) for c, m in zip(codes, marks)])


def read_archives(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Entries of archives below a path; with first and last only these rows of each matrix."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for key, n, cols, values in entries(bytes(content)):
                    values = np.atleast_2d(values)[first : None if last is None else last + 1]
                    rows.append((key, len(values), cols, values.ravel()))
                yield pd.DataFrame(rows, columns=["key", "rows", "cols", "values"])

    return files.mapInPandas(run, SCHEMA)


def frames_of(archives: DataFrame) -> DataFrame:
    """key, frame, feat: matrices by rows."""
    rows = archives.where("cols > 0").withColumn("frame", F.explode(F.expr("sequence(0, rows - 1)")))
    return rows.select("key", "frame", F.expr("slice(values, frame * cols + 1, cols)").alias("feat"))


def write_vectors(rows: DataFrame, path: str, key: str, vector: str) -> None:
    """Vectors as text entries (S9); the binary form of a table is Parquet."""
    values = F.array_join(F.col(vector).cast("array<string>"), " ")
    rows.select(F.concat(F.col(key).cast("string"), F.lit("  [ "), values, F.lit(" ]"))).write.text(path)


class ArchiveSource(DataSource):
    """spark.read.format('keyed-archive').load(path): the entries of one archive file a partition."""

    @classmethod
    def name(cls) -> str:
        return "keyed-archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(base)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(base))
        return [InputPartition(f.path) for f in files if f.is_file]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.value) as f:
            for key, rows, cols, values in entries(f.read()):
                yield key, rows, cols, np.asarray(values).ravel().tolist()
