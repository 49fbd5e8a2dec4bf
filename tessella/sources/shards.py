"""Examples in tar shards: written in bounded pieces, read as streams, and examples that cannot be parsed listed instead of lost.

A shard holds the parts of its examples one after the other, each as a member 'key.part'. A reader takes members as they come and
never holds more than one example and one batch of results.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import placed
from .seeking import files_below, store_of

#: Bytes of parts in an Arrow batch, at most, if an example is not larger.
BATCH_BYTES = 8 << 20
MANIFEST = "path string, examples bigint, bytes bigint"


def write_shards(rows: DataFrame, folder: str, key: str, parts: dict[str, str], each: int, seed: int = 1024) -> DataFrame:
    """Shards of `each` examples in an order that the seed shuffles, and their table: path, examples, bytes.

    parts: column of bytes or text by name of the part; a null part is left out. A shard is written under a name of its task attempt
    and then renamed, so an attempt that is lost or repeated leaves no half shard. folder is a path that all executors share. The table has a row a shard and is kept
    beside the shards, so that nothing is written twice; an empty table gives no shard.
    """
    spark = rows.sparkSession
    chosen = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("binary").alias(f"p{i}") for i, c in enumerate(parts.values())])
    order = [F.xxhash64(F.lit(seed), "key"), F.col("key"), F.xxhash64(*[f"p{i}" for i in range(len(parts))])]
    numbered = placed(chosen, order).withColumn("shard", F.floor(F.col("__place") / each))
    dealt = numbered.repartition("shard").sortWithinPartitions("shard", "__place").drop("__place")
    names = list(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        now, out = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if out:
                        yield out.done()
                    now = row["shard"]
                    out = Shard(store, base, folder, now)
                out.add(row["key"], {n: row[f"p{i}"] for i, n in enumerate(names) if row[f"p{i}"] is not None})
        if out:
            yield out.done()

    table = f"{folder.rstrip('/')}/_shards"
    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


class Shard:
    """One shard being written."""

    def __init__(self, store: fs.FileSystem, base: str, folder: str, number: int):
        self.store, self.examples, self.bytes = store, 0, 0
        self.name = f"shard-{number:06d}.tar"
        self.final, self.own, self.path = f"{base}/{self.name}", f"{base}/.{self.name}.{uuid.uuid4().hex}", f"{folder.rstrip('/')}/{self.name}"
        self.sink = store.open_output_stream(self.own)
        self.tar = tarfile.open(fileobj=self.sink, mode="w|")

    def add(self, key: str, parts: dict[str, bytes]) -> None:
        for name, data in parts.items():
            info = tarfile.TarInfo(f"{key}.{name}")
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))
            self.bytes += len(data)
        self.examples += 1

    def done(self) -> pa.RecordBatch:
        self.tar.close()
        self.sink.close()
        self.store.move(self.own, self.final)
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.examples], pa.int64()), pa.array([self.bytes], pa.int64())], names=["path", "examples", "bytes"])


def grouped(stream: BinaryIO) -> Iterator[tuple[str | None, dict[str, bytes], str | None]]:
    """(key, parts, error) of the runs of members of a tar stream that share a name up to its last dot.

    A stream that breaks off gives what was whole, then an error with the key it was at. A member without a dot is an error of its own.
    """
    key, parts = None, {}
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for member in tar:
                if not member.isfile():
                    continue
                name, dot, part = member.name.rpartition(".")
                if not dot or not name:
                    yield member.name, {}, "the member has no part in its name"
                    continue
                if name != key:
                    if key is not None:
                        yield key, parts, None
                    key, parts = name, {}
                data = tar.extractfile(member).read()
                if len(data) != member.size:
                    raise EOFError("the member is cut off")
                parts[part] = data
    except (tarfile.TarError, EOFError, OSError) as e:
        yield key, {}, f"the shard is broken: {e}"
        return
    if key is not None:
        yield key, parts, None


def examples(spark: SparkSession, shards: DataFrame | str, parsers: dict[str, tuple[str, Callable[[bytes], object]]]) -> DataFrame:
    """shard, key, error and a column for each part of every example of the shards (a table with path, or a folder).

    parsers: part -> (Spark type, function of its bytes). A part that is missing is null. Where a function raises, or a shard
    cannot be opened or breaks off, the row has the reason in error and nulls for the parts; the other examples stay. A shard is a task's stream.
    """
    if isinstance(shards, str):
        shards = spark.createDataFrame([(p,) for p, _ in files_below(shards) if ".tar" in p.rsplit("/", 1)[-1] and not p.rsplit("/", 1)[-1].startswith(".")], "path string")
    schema = ", ".join(["shard string", "key string", "error string", *[f"`{n}` {kind}" for n, (kind, _) in parsers.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(spark_types, list(parsers))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    store, base = store_of(path)
                    stream = store.open_input_stream(base)
                except OSError as e:
                    out.add(path, None, f"the shard does not open: {e}", {}, 0)
                    continue
                with stream:
                    for key, parts, error in grouped(stream):
                        values = {}
                        if error is None:
                            try:
                                values = {n: parse(parts[n]) for n, (_, parse) in parsers.items() if n in parts}
                            except Exception as e:  # whatever a parser finds wrong is the example's error
                                error, values = f"{type(e).__name__}: {e}", {}
                        out.add(path, key, error, values, sum(map(len, parts.values())))
                        if out.bytes >= BATCH_BYTES:
                            yield out.batch()
        if out.rows:
            yield out.batch()

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_types = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return shards.select("path").repartition("path").mapInArrow(run, schema)


class Rows:
    """Rows that are gathered until they fill a batch."""

    def __init__(self, schema: pa.Schema, parts: list[str]):
        self.schema, self.parts, self.rows, self.bytes = schema, parts, [], 0

    def add(self, shard: str, key: str | None, error: str | None, values: dict, size: int) -> None:
        self.rows.append({"shard": shard, "key": key, "error": error, **{n: values.get(n) for n in self.parts}})
        self.bytes += size + 64

    def batch(self) -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.bytes = [], 0
        return found


def parted(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, failed rows, counts of both) of rows with a column error, written once to a folder: counted while they are written, and parted by failure, so that either is read alone."""
    counts = Observation("parted")
    seen = rows.observe(counts, F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    seen.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(folder)
    back = rows.sparkSession.read.schema(seen.withColumn("failed", F.lit(True)).schema).parquet(folder)
    return back.where("NOT failed").drop("failed", "error"), back.where("failed").select("shard", "key", "error"), counts.get
