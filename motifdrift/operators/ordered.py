"""Numbers, running totals and predecessors along an order, at any size.

Rows are exchanged once, by Spark's own range partitions (splitters from a sample, found by bisection), and sorted in them. Places and sums
within a partition are taken while it is written; partitions then start where the ones before them end, which takes a row for each partition.
Rows of equal keys are told apart by a hash of the row, so a hot key is dealt to several partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from motifdrift.sources.scratch import written

BEFORE = Window.unboundedPreceding, -1


def ranged(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """df in sorted range partitions that follow one another, with the partition's number. Spark chooses how many, unless told."""
    order = [*order, F.xxhash64(*df.columns)]
    parts = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return parts.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """left with right's other columns where the names are equal; nulls equal each other."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(renamed, on).drop(*[f"_r_{n}" for n in names])


def numbered(df: DataFrame, groups: list[str], key: str, number: str, total: str, ranges: int | None = None) -> DataFrame:
    """Adds number (0.. by key in each group; null keys first) and total (rows of the group)."""
    placed = written(ranged(df, [F.col(c) for c in (*groups, key)], ranges).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    of_group = Window.partitionBy(*groups)
    counts = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))  # as many rows as groups and partitions
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    starts = counts.select(*groups, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias(total))
    return same(placed, starts, [*groups, "_part"]).withColumn(number, F.col("_place") + F.col("_shift")).select(*df.columns, number, total)


def in_order(df: DataFrame, added: T.StructType, step: Callable[[pa.RecordBatch, object], tuple[list[pa.Array], object]]) -> DataFrame:
    """df with columns that step makes of a batch and of what it returned for the batch before in the partition (None at first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                arrays, state = step(batch, state)
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def falling_totals(df: DataFrame, key: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """Adds for each value its sum over rows of this key or a higher one (name_upto), and over all (name_all). Keys are distinct; a null key is the lowest. A null value counts as 0."""
    whole = df.withColumns({f"_v_{v}": F.coalesce(F.col(v), F.lit(0)).cast("long" if dict(df.dtypes)[v] in ("int", "bigint", "smallint", "tinyint") else "double") for v in values})
    parts = ranged(whole, [F.desc_nulls_last(key)], ranges)
    own = T.StructType([T.StructField(f"_own_{v}", whole.schema[f"_v_{v}"].dataType) for v in values])
    at = [parts.columns.index(f"_v_{v}") for v in values]

    def add(batch: pa.RecordBatch, last: list | None) -> tuple[list[pa.Array], list]:
        sums = [np.cumsum(batch.column(i).to_numpy(zero_copy_only=False)) + (last[j] if last else 0) for j, i in enumerate(at)]
        return [pa.array(s) for s in sums], [s[-1] for s in sums]

    summed = written(in_order(parts, own, add), "running")
    sums = summed.groupBy("_part").agg(*[F.sum(f"_v_{v}").alias(v) for v in values])  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(*BEFORE)
    starts = sums.select(
        "_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values], *[F.sum(v).over(Window.partitionBy()).alias(f"{v}_all") for v in values]
    )
    return summed.join(starts, "_part").select(*df.columns, *[(F.col(f"_before_{v}") + F.col(f"_own_{v}")).alias(f"{v}_upto") for v in values], *[f"{v}_all" for v in values])


def with_previous(df: DataFrame, key: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Adds before: a struct of the columns in the row before, by key and then the columns; null in the first row. Null keys come first."""
    parts = ranged(df.withColumn("_row", F.struct(*columns)), [F.col(c) for c in (key, *columns)], ranges).withColumn("_place", F.monotonically_increasing_id())
    at, kind = parts.columns.index("_row"), parts.schema["_row"].dataType

    def shift(batch: pa.RecordBatch, last: pa.Array | None) -> tuple[list[pa.Array], pa.Array]:
        rows = batch.column(at)
        first = pa.nulls(1, rows.type) if last is None else last
        return [pa.concat_arrays([first, rows.slice(0, len(rows) - 1)])], rows.slice(len(rows) - 1)

    moved = written(in_order(parts, T.StructType([T.StructField("_before", kind)]), shift), "previous")
    last = moved.groupBy("_part").agg(F.max_by("_row", "_place").alias("_last"), F.min("_place").alias("_place"))  # a row for each partition
    ends = last.select("_place", F.lag("_last").over(Window.orderBy("_part")).alias("_end"))
    return moved.join(ends, "_place", "left").withColumn("before", F.coalesce("_end", "_before")).select(*df.columns, "before")
