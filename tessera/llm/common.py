"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: A table may be broadcast if it has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

#: ASCII white space as the contracts name it: the space and 0x09 to 0x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back, so that
    a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches in which texts go to Python workers and back: both sides hold
    several copies of a batch, and ten thousand texts (the default) can be any size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if it is within ``limit`` rows and its files within
    ``max_bytes``, so wide rows (long host names) count, too; otherwise the join that uses it shuffles,
    and adaptive execution splits what is skewed."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= max_bytes and df.count() <= limit else df


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def held_out(c: Column) -> Column:
    """The contract's held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Packs an iterator of row tuples into batches of bounded size."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
