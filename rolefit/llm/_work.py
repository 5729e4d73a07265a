"""Shared plumbing: the shared work folder, staged tables and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of an Arrow batch that a Python worker gets, and of the texts it works on in one go.
BATCH_BYTES, CHUNK_BYTES = 4 << 20, 1 << 19


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where it is unset, a local session (tests) gets one of its own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, pandas: bool = False) -> DataFrame:
    """`df.mapInArrow` (or `mapInPandas`), with the session's `spark.sql.execution.arrow.maxBytesPerBatch` set to `BATCH_BYTES`: rows differ in length by orders of
    magnitude, so that a number of rows bounds nothing.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInPandas(function, schema) if pandas else df.mapInArrow(function, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two named columns, as `doc_id` and `text` (null text: empty): other columns may clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, bytes, offsets). Rows are joined by one newline byte: row i is `bytes[offsets[i]:offsets[i+1]-1]`.

    A run holds about `max_bytes`, or one row that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1)
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        part = column.slice(first, end - first)
        rows = pa.LargeListArray.from_arrays(pa.array([0, end - first], pa.int64()), part)
        joined = pc.binary_join(rows, pa.scalar(b"\n", pa.large_binary()))[0].as_buffer()
        data = np.frombuffer(joined, np.uint8)
        yield first, end, data, np.concatenate([[0], ends[first:end] - base])
        first = end
