"""Small helpers the operators share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailscope.session import checkpoint_dir, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_bytes(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and ``text`` as UTF-8 bytes; a null text stays null."""
    return docs.select(*[F.col(k) for k in keys], F.col("text").cast("binary").alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """One dict of columns per Arrow batch, typed by ``schema``."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = step(batch)
            if columns is not None:
                yield to_batch(columns, target)

    return df.mapInArrow(run, fields)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        values = columns[field.name]
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            array = values if values.type == field.type else values.cast(field.type)
        else:
            array = pa.array(values, type=field.type)
        arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
