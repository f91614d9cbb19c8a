"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

LOWEST = -(2 ** 63)
SPACE = " \t\n\x0b\x0c\r"  # the white space of the contracts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: done once, whatever is lost later."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_id(ident: str = "doc_id") -> Column:
    """The identifier as a long that sorts null first."""
    return F.coalesce(F.col(ident).cast("long"), F.lit(LOWEST))


def text_key(text: str = "text") -> Column:
    """64 bits of the text, which tell rows apart that share an identifier."""
    return F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit("")))


def wide_hash(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with independent seeds: 128 bits, where 64 would collide in a corpus of 10^12 pieces."""
    return [F.xxhash64(F.lit(7), *cols), F.xxhash64(F.lit(1000003), *cols)]


BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Let at most ``BATCH_ROWS`` rows at a time cross to Python in this session.

    The default of 10,000 rows is meant for narrow rows; of long texts it is a
    gigabyte, once in the JVM's direct memory and once in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, fn: Callable[[Iterator[dict[str, pa.Array]]], Iterable[dict]], schema: str | StructType,
              rows: int = 512, megabytes: int = 8) -> DataFrame:
    """Run ``fn`` over Arrow columns, in slices of bounded rows and bytes.

    ``fn`` takes an iterator of column dictionaries and yields dictionaries of
    lists or arrays. The slices keep a task's memory flat when texts are long.
    """
    short_batches(df.sparkSession)
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    names = kind.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            step = max(1, min(rows, int(rows * megabytes * 2 ** 20 / max(1, batch.nbytes) * batch.num_rows / rows)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield {n: part.column(i) for i, n in enumerate(part.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) if not isinstance(out[n], pa.Array)
                                              else out[n].cast(arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, kind)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without making Python strings."""
    return [v or b"" for v in texts.cast(pa.binary()).to_pylist()]


def as_strings(texts: pa.Array) -> list[str]:
    return [v or "" for v in texts.to_pylist()]
