"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Row p, column s of the matrix says how many rows partition p sends to shard s. Given the partitions' row counts
and the shards' sizes, a uniform shuffle has these counts multivariate hypergeometric, so the driver draws them from
that law (partitions x shards numbers, drawn one after another). Each partition's rows are ordered at random, by a window over the partition's number, and dealt
out by its row of the matrix; each shard permutes what it received. Sizes are exact by construction and no row looks at
another partition's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift.llm.shared import text_or_empty, written

SEED = 20260117
BUCKET_ROWS = 50_000
#: A matrix of so many partitions at most is broadcast (8 shards: under 8 MB); beyond, it is joined by partition.
BROADCAST_PARTS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, total: int, drawn: int) -> int:
    """How many of `good` are among `drawn` of `total`: inversion over the mass within 12 standard deviations and 40 of the mean, for counts of
    any size. What lies outside has a probability below 1e-30, far less than a double's rounding."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    if low == high:
        return low
    mean = drawn * good / total
    spread = 12 * np.sqrt(max(mean * (1 - good / total), 1.0)) + 40
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[:-1] + 1) - np.log(total - good - drawn + k[:-1] + 1)
    mass = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.exp(mass - mass.max()).cumsum()
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """For each partition how many rows go to each shard; rows sum to counts, columns to sizes."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for count in counts:
        row, to_draw, pool = [], count, sum(left)
        for size in left:
            x = hypergeometric(rng, size, pool, to_draw) if to_draw else 0
            row.append(x)
            to_draw, pool = to_draw - x, pool - size
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def uniform_shards(rows: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most.

    Rows are told apart by their place in the input, so repeated rows, null ids and ties are dealt like any others. An empty
    table gives no rows. Columns named like the helper columns (part, place, _shard_...) don't clash: all
    helpers carry the prefix _shard_. Rows should be narrow (ids and sizes); they are written once to fix their places.
    """
    spark = rows.sparkSession
    placed = written(
        rows.withColumns({"_shard_part": F.spark_partition_id(), "_shard_place": F.monotonically_increasing_id()}), "shard-rows"
    )
    counted = sorted((r[0], r[1]) for r in placed.groupBy("_shard_part").count().collect())  # a row for each partition
    total = sum(n for _, n in counted)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counted], sizes, seed)
    ends = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counted, matrix, strict=True)], "_shard_part int, _shard_ends array<long>"
    )
    ends = F.broadcast(ends) if len(counted) <= BROADCAST_PARTS else ends
    mixed = lambda k: F.xxhash64(F.lit(seed * 2 + k), F.col("_shard_place"))
    local = Window.partitionBy("_shard_part").orderBy("_shard_first", "_shard_place")
    dealt = (
        placed.withColumn("_shard_first", mixed(0))
        .withColumn("_shard_rank", F.row_number().over(local))
        .join(ends, "_shard_part")
        .withColumn("shard", F.size(F.filter("_shard_ends", lambda e: e < F.col("_shard_rank"))))
        .drop("_shard_ends", "_shard_rank", "_shard_first", "_shard_part")
    )
    # The second permutation: a shard is cut at random into buckets of bounded size, each of which is sorted by itself.
    n_buckets = max(1, -(-total // (n_shards * bucket_rows)))
    dealt = written(dealt.withColumn("_shard_second", mixed(1)).withColumn("_shard_bucket", F.pmod(F.xxhash64("_shard_second"), F.lit(n_buckets)).cast("int")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_shard_bucket").agg(F.count("*").alias("_shard_n")).select(
        "shard", "_shard_bucket", F.coalesce(F.sum("_shard_n").over(before), F.lit(0)).alias("_shard_start")
    )
    inside = Window.partitionBy("shard", "_shard_bucket").orderBy("_shard_second", "_shard_place")
    return (
        dealt.withColumn("_shard_rank", F.row_number().over(inside))
        .join(starts, ["shard", "_shard_bucket"])
        .withColumn("slot", (F.col("_shard_start") + F.col("_shard_rank") - 1).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; a null text has none) and unsigned crc32 of the UTF-8 text (null: of no bytes)."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def sharded_documents(docs: DataFrame, n_shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law)."""
    return uniform_shards(document_sizes(docs), n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
