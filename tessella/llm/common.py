"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that part words, and the ASCII letters.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table for A-Z to a-z.
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """The URI of a folder of our own inside the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def set_apart(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str], Callable[..., DataFrame]]:
    """docs under the names c0, c1, ..., so that no name of its own meets one of ours; the new names of some columns; and the way
    back, which keeps the columns of docs and, under the names given, some results; these take the place of columns of docs of the same name."""
    names = docs.columns
    new = [f"c{i}" for i in range(len(names))]

    def back(df: DataFrame, **results: str) -> DataFrame:
        own = [(n, c) for n, c in zip(names, new) if n not in results]
        return df.select(*[c for _, c in own], *results.values()).toDF(*[n for n, _ in own], *results)

    return docs.toDF(*new), [new[names.index(c)] for c in columns], back


def texts(batch, column: str):
    """The column's values of an Arrow batch as str, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batches, rows: int = 1000):
    """The Arrow batches in slices of so many rows, so that what is made of them stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def numbered(df: DataFrame) -> DataFrame:
    """df with a column __row, an id of each row that stays the same: the rows are written to the shared folder and read again."""
    path = new_dir(df.sparkSession, "numbered")
    df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def first_rows(rows: DataFrame, groups: DataFrame, ident: str) -> DataFrame:
    """Of each group (__row, group) of numbered rows that with the smallest id, nulls last, then the smallest __row; without __row."""
    ids = rows.select("__row", rows[f"`{ident}`"].alias("__ident"))
    least = F.min(F.struct(F.col("__ident").isNull(), "__ident", "__row"))
    stay = groups.join(ids, "__row").groupBy("group").agg(least.alias("least")).select(F.col("least.__row").alias("__row"))
    # The rows that go are fewer than those that stay, and often few enough to leave the texts where they are.
    gone = pinned(groups.select("__row").join(stay, "__row", "left_anti"))
    return rows.join(if_small(gone, gone.count(), 1_000_000), "__row", "left_anti").drop("__row")
