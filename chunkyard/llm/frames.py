"""What the operators of this subpackage share: lean inputs, stable tables, Arrow maps."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frames import stable

ROOT = str(Path(__file__).resolve().parents[2])
BLOCK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared Parquet tables."""
    reach(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch: both ends of a worker's pipe hold a few of them.
BATCH_BYTES = 2 << 20


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed, and bounds what they are sent at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def lean(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns that are read, so that extra ones cannot clash."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in names.items()))


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows are stored in the folder that `spark.checkpoint.dir` names (in local tests, in one of our own)."""
    return stable(df)


def unsized(df: DataFrame) -> DataFrame:
    """A stored table of which Spark does not know an estimated size.

    Stored tables keep the estimate of the plan that made them, and a join's is the product of its sides'. In a
    loop with a join the number has several times the digits after each round, until planning takes minutes.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), session)


def free(name: str, *taken: str) -> str:
    """name, or a longer one that no taken column has in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(spark: SparkSession, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of bounded size, and at least as many as the session has shuffle partitions."""
    return max(partitions(spark), math.ceil(n_bytes / block_bytes), 1)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def pieces(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `size` bytes, so that what Python makes of them stays small."""
    rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, size: int = 1 << 20) -> DataFrame:
    """f over every row, in batches of about `size` bytes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(f, pieces(batch, size))

    return df.mapInArrow(over, schema)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.cast(pa.binary()).fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def remainder(column: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids count as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % of
