"""Numeric rows packed into blocks, and sums over blocks that don't depend on how Spark deals them.

Iterative fits read the same rows once per step. ``pack`` writes them once as
matrices of bounded size; ``total`` runs a function over every matrix and adds
its results up. A block always holds the same rows in the same order, and its
result is added as integers, so a fit gives the same numbers, bit for bit, on
one partition and on a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored

BLOCK_ROWS = 512
CHUNK = 1 << 16  # numbers of a partial sum that travel as one row
BATCH_BYTES = 4 << 20  # of blocks that cross to Python at once
DIRECT = 1 << 22  # partial sums of fewer numbers in all go straight to the driver
TASK_BYTES = 64 << 20  # of blocks that a task reads in a pass


class Blocks(NamedTuple):
    """Packed rows: ``frame`` (block long, n int, data binary) of matrices with the columns ``names`` and how often each row stands."""

    frame: DataFrame
    names: list[str]
    rows: int
    count: int

    def cache(self) -> "Blocks":
        return self._replace(frame=self.frame.persist())

    def close(self) -> None:
        self.frame.unpersist()


def matrix(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    """Rows of a block; the last column says how often a row stands."""
    return np.frombuffer(data, "<f8").reshape(-1, width + 1)


def _short_batches(spark: SparkSession) -> None:
    """Let few blocks at a time cross to Python in this session: a batch is else as large as a task's share of the table, up to 256 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def pack(df: DataFrame, columns: Mapping[str, Column], block_rows: int = BLOCK_ROWS, name: str = "blocks") -> Blocks:
    """The rows as blocks of about ``block_rows`` different rows, dealt by a hash of their values.

    Rows with a null or not-a-number in any column are left out. Equal rows are
    kept once, with their number, so that no value can fill a block. The blocks are
    dealt in turn to as many tasks as the cluster runs at once, or a multiple of it.
    """
    spark = df.sparkSession
    _short_batches(spark)
    wide = F.array(*[c.cast("double") for c in columns.values()])
    values = df.select(wide.alias("v")).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    distinct = stored(values.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("m")), name + "-rows")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows")).first()
    count = max(1, -(-size["n"] // block_rows))
    grouped = distinct.groupBy(F.pmod(F.xxhash64("v"), F.lit(count)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("v", "m"))).alias("r"))
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes = [], []
            for listed in batch.column("r"):
                own = listed.values
                v = own.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                data.append(np.column_stack([v, own.field("m").to_numpy(zero_copy_only=False)]).astype("<f8").tobytes())
                sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["block", "n", "data"])

    slots = max(1, spark.sparkContext.defaultParallelism)
    waves = -(-size["n"] * (width + 1) * 8 // (slots * TASK_BYTES))
    dealt = grouped.mapInArrow(run, "block long, n int, data binary").repartition(min(count, slots * max(1, waves)))
    frame = stored(dealt, name)
    return Blocks(frame, list(columns), int(size["rows"] or 0), count)


COARSE, FINE, SINGLE = 2.0 ** 20, 2.0 ** 60, 2.0 ** 40


def _add(out: np.ndarray, values: np.ndarray, rows: int, size: int, fine: bool) -> None:
    """Add ``values / rows`` in units of 2^-20 and of what is left units of 2^-60 behind them; or units of 2^-40 alone. A chunk at a time stays in the cache."""
    for at in range(0, len(values), CHUNK):
        if not values[at:at + CHUNK].any():
            continue  # a curvature that wasn't asked of this block
        part = values[at:at + CHUNK].astype(np.float64) / rows
        if not np.abs(part).max(initial=0) < (2.0 ** 42 if fine else 2.0 ** 22):
            raise OverflowError("a block's sum per row of the table is not finite or too large: scale the columns")
        if not fine:
            out[at:at + len(part)] += np.rint(part * SINGLE).astype(np.int64)
            continue
        high = np.rint(part * COARSE)
        out[at:at + len(part)] += high.astype(np.int64)
        out[size + at:size + at + len(part)] += np.rint((part - high / COARSE) * FINE).astype(np.int64)


def total(blocks: Blocks, fn: Callable[[np.ndarray, int], np.ndarray], size: int, where: Column | None = None, fine: bool = True) -> np.ndarray:
    """Sum of ``fn(matrix, block)``, ``size`` numbers (zeros behind the last one it returns), over all blocks.

    Exact in units of 2^-60 of the number of rows (2^-40 unless ``fine``),
    whatever the order. Partial
    sums of a task are cut into chunks; where they are many, Spark adds up
    chunks before the driver gets one sum.
    """
    width, rows, numbers = len(blocks.names), max(blocks.rows, 1), size * (1 + fine)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(numbers, np.int64)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                _add(out, np.asarray(fn(matrix(data.as_buffer(), width), block)), rows, size, fine)
        if out.any():
            yield chunks(out)

    def chunks(values: np.ndarray) -> pa.RecordBatch:
        starts = range(0, len(values), CHUNK)
        return pa.RecordBatch.from_arrays([pa.array([s // CHUNK for s in starts], pa.int32()),
                                           pa.array([values[s:s + CHUNK].astype("<i8").tobytes() for s in starts], pa.binary())], names=["chunk", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist()):
                part = np.frombuffer(data, "<i8")
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
                                         names=["chunk", "data"])

    chosen = blocks.frame if where is None else blocks.frame.filter(where)
    parts = chosen.select("block", "data").mapInArrow(partial, "chunk int, data binary")
    if numbers * min(blocks.count, chosen.rdd.getNumPartitions()) > DIRECT:
        parts = parts.repartition("chunk").mapInArrow(added, "chunk int, data binary")
    out = np.zeros(numbers, np.int64)
    for row in parts.collect():  # chunks of one sum, or of few
        at = row["chunk"] * CHUNK
        out[at:at + len(row["data"]) // 8] += np.frombuffer(row["data"], "<i8")
    return (out[:size] / COARSE + out[size:] / FINE if fine else out / SINGLE) * rows
