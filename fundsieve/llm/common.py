"""Shared helpers of the corpus operators: tables, durable intermediate results, sized broadcasts."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundsieve.operators.ranks import durable, shared_dir  # noqa: F401

#: Largest side that is broadcast, in rows; larger sides go through a shuffled join.
BROADCAST_ROWS = 100_000


#: Bytes of text that a task works on at a time.
SLICE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast only if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def settled(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column that is computed once a row.

    The optimizer moves filters below projections and copies what they use; inside a lambda the copy would run once an
    element. It does not look through a generator, so the value comes out of one that makes one row of each row.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def in_slices(batch: pa.RecordBatch, text: int, limit: int = SLICE):
    """Slices of an Arrow batch of about `limit` bytes in the column of texts, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def tidy(run, forget=lambda: None):
    """A function for mapInArrow after whose tasks the worker keeps no memory: workers live on from stage to stage."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
