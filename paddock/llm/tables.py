"""Small helpers that every module of this folder uses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo `parts`; null for a null value."""
    return F.crc32(F.col(column).cast("string")) % parts


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for folders in _NOTED:
        folders.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: lineage ends here, and
    the rows survive the loss of any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_NOTED: list[list[str]] = []


@contextmanager
def noted(folders: list[str]) -> Iterator[None]:
    """While open, the folders that `new_folder` gives are listed, so that they can be deleted."""
    _NOTED.append(folders)
    try:
        yield
    finally:
        _NOTED[:] = [f for f in _NOTED if f is not folders]  # an equal list may be another's


def filed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`df` if it is a table read from files, else (its `columns`) written and read again: a row of the
    result is told from all others by `_metadata.file_path` and `_metadata.row_index`."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return df
    return stored(df if columns is None else df.select(*columns), "rows")


def identified(docs: DataFrame) -> DataFrame:
    """(__row, __doc): every row as one struct, with a number of its own that all reads agree on.

    The number comes from the row's file and its place in it, so a table read from files needs no
    copy; anything else is written first. No column of the table can clash with the two.
    """
    spark, rows = docs.sparkSession, filed(docs)
    place = rows.select(F.struct("*").alias("__doc"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    paths = sorted(r[0] for r in place.select("__file").distinct().collect())  # a row a file
    files = spark.createDataFrame(list(enumerate(paths)), "__number long, __file string")
    return place.join(F.broadcast(files), "__file").select((F.shiftleft("__number", 33) + F.col("__at")).alias("__row"), "__doc")


def times_of_rows(rows: DataFrame, marks: DataFrame, most: int = 1, packs: int = 16_384) -> DataFrame:
    """`rows` with `__times`: how often, at most `most`, the stored narrow table `marks`
    (__row, times) says; 0 for rows it does not name.

    Marks are packed, one bit a row and level, into maps of 32,768 rows (4 KB). Up to `packs`
    maps are broadcast, which is half a billion rows in large files; wide rows are shuffled only beyond.
    """
    if marks.select(F.bitmap_bucket_number("__row")).distinct().count() * most > packs:
        found = rows.join(marks, "__row", "left")
        return found.withColumn("__times", F.least(F.coalesce("times", F.lit(0)), F.lit(most))).drop("times")
    at = F.bitmap_bit_position("__row")
    maps = marks.groupBy(F.bitmap_bucket_number("__row").alias("__pack")).agg(
        *[F.bitmap_construct_agg(F.when(F.col("times") >= k, at)).alias(f"__map{k}") for k in range(1, most + 1)]
    )
    met = rows.withColumn("__pack", F.bitmap_bucket_number("__row")).join(F.broadcast(maps), "__pack", "left")
    byte = lambda k: F.conv(F.hex(F.substr(f"__map{k}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = lambda k: F.coalesce((byte(k).bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).cast("int"), F.lit(0))
    total = bit(1)
    for k in range(2, most + 1):
        total = total + bit(k)
    return met.withColumn("__times", total).drop("__pack", *[f"__map{k}" for k in range(1, most + 1)])


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def join_small(many: DataFrame, few: DataFrame, on: str | Column, how: str, limit: int = 2_000_000) -> DataFrame:
    """Join a stored narrow table to a wide one: broadcast while it has at most `limit` rows
    (some tens of bytes each), shuffled beyond, so that wide rows move only when they must."""
    return many.join(F.broadcast(few) if few.count() <= limit else few, on, how)
