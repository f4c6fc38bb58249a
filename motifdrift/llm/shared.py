"""Tables in the folder that driver and executors share, and small helpers of all operators here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifdrift.sources.scratch import deleted, new_path, shared_dir, written

__all__ = ["SPACE", "deleted", "held_out", "new_path", "partitions", "shared_dir", "table", "text_or_empty", "thrifty", "written"]

#: White space of every contract here: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id", of: int = 5, rest: int = 0) -> Column:
    """crc32 of the id as text leaves this rest. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == rest


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Memory that this process has freed goes back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):  # glibc
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step for mapInArrow in a worker that gives back freed memory before and after it: workers are used again, and what an earlier task has freed would count beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from step(batches)
        give_back()

    return run
