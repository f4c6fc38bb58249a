"""Period tables, trigram vectors, centroids, vectors and datasets: readers with explicit schemas, and writers that commit a version (see snapshots)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifdrift import settings
from motifdrift.functions.columns import joined_links, natural_key, parsed_links
from motifdrift.sources.fasta import with_record_idx
from motifdrift.sources.scratch import written
from motifdrift.sources.snapshots import read_table, write_table

ISOLATES = "isolate_name string, timestamp date, sequence string, period string"


def vector_columns(width: int = settings.VECTOR_WIDTH) -> list[str]:
    return [f"d{i}" for i in range(1, width + 1)]


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_periods(spark: SparkSession, root: str, schema: str = ISOLATES) -> DataFrame:
    """All periods; filter on period to read only its folders. Also of plain folders that something else has written."""
    return read_table(spark, root, schema)


def write_periods(df: DataFrame, root: str, mode: str = "append") -> None:
    """Commits a version with a folder for each period that has rows. mode 'overwrite' replaces only the periods that df has, 'replace' all."""
    write_table(df, root, "period", mode)


def periods_in_order(df: DataFrame) -> DataFrame:
    return df.select("period").distinct().orderBy(natural_key(F.col("period")))


def read_trigram_vectors(spark: SparkSession, path: str, width: int = settings.VECTOR_WIDTH) -> DataFrame:
    """CSV words, d1.. with a header; idx is the row's place in the file. The vocabulary has at most a few ten thousand rows."""
    schema = T.StructType([T.StructField("words", T.StringType()), *[T.StructField(d, T.DoubleType()) for d in vector_columns(width)]])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return with_record_idx(written(placed, "trigram-vectors"), ["file", "block"], "place").withColumn("idx", F.col("record_idx").cast("int")).select("idx", "words", *vector_columns(width))


def read_centroids(spark: SparkSession, path: str, width: int = settings.VECTOR_WIDTH) -> DataFrame:
    """CSV period, cluster, next_cluster (text), d1..; next_cluster becomes array<int>, whatever its values look like."""
    fields = [("period", T.StringType()), ("cluster", T.IntegerType()), ("next_cluster", T.StringType()), *[(d, T.DoubleType()) for d in vector_columns(width)]]
    rows = read_table(spark, path, ", ".join(f"{name} {kind.simpleString()}" for name, kind in fields), source="csv", header=True)
    return rows.select(*[name for name, _ in fields]).withColumn("next_cluster", parsed_links(F.col("next_cluster")))


def write_centroids(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each period, so centroids of single periods are replaced: only the periods that df has. mode 'replace' drops all others."""
    rows = df.withColumn("next_cluster", joined_links(F.col("next_cluster"))).withColumn("of_period", F.col("period"))
    write_table(rows, path, "of_period", mode, "csv", header=True, emptyValue="")


def write_vectors(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Sequence vectors (a key, d1.., period): one folder for each period; 'overwrite' replaces only the periods that df has."""
    write_table(df, root, "period", mode)


def read_vectors(spark: SparkSession, root: str, key: str = "record_idx", width: int = settings.VECTOR_WIDTH) -> DataFrame:
    """All vectors; filter on period to read only its folder."""
    return read_table(spark, root, f"{key} long, " + ", ".join(f"{d} double" for d in vector_columns(width)) + ", period string")


def write_cluster_labels(isolates: DataFrame, labels: DataFrame, root: str, key: str = "seq_id") -> None:
    """Writes isolates (with period) with the cluster of labels (key, cluster); replaces only the periods that isolates has. isolates may be read from root."""
    write_periods(with_cluster_labels(isolates, labels, key), root, "overwrite")


def with_cluster_labels(isolates: DataFrame, labels: DataFrame, key: str = "seq_id") -> DataFrame:
    """Replaces the column cluster by that of labels (key, cluster)."""
    return isolates.drop("cluster").join(labels.select(key, "cluster"), key)


def write_dataset(df: DataFrame, path: str, shard: int | None = None, steps: int | None = None) -> None:
    """y and x (array of int arrays) as CSV: y, then one printed list for each step. A shard replaces only itself; without one, all.

    steps: how many each row has, if that is known; rows are held to it while they are written. Without it, a pass over df tells. Files are compressed, as ids repeat.
    """
    if steps is None:
        found = df.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
        if found.low != found.high:
            raise ValueError(f"rows have {found.low} to {found.high} steps")
        held, steps = F.col("x"), found.high or 0
    else:
        told = F.concat(F.lit("a row has "), F.size("x").cast("string"), F.lit(f" steps, not {steps}"))
        held = F.when(F.size("x") == steps, F.col("x")).otherwise(F.raise_error(told).cast("array<array<int>>"))
    printed = [F.to_json(F.get(held, F.lit(i))).alias(str(i)) for i in range(steps)]
    options = {"header": True, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    if shard is None:
        write_table(df.select("y", *printed), path, mode="replace", source="csv", **options)
    else:
        write_table(df.select("y", *printed, F.lit(shard).alias("shard")), path, "shard", "overwrite", "csv", **options)


def parsed_list(text: Column) -> Column:
    """A printed list of whole numbers; anything but plain ones goes through the JSON reader."""
    plain = text.rlike(r"^\[ ?\d{1,9}(, ?\d{1,9})*\]$")
    return F.when(plain, F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",").cast("array<int>")).otherwise(F.from_json(text, "array<int>"))


def read_dataset(spark: SparkSession, path: str, steps: int) -> DataFrame:
    """y, x from CSV; printed lists are parsed."""
    rows = read_table(spark, path, ", ".join(["y int", *[f"`{i}` string" for i in range(steps)]]), source="csv", header=True)
    return rows.select("y", F.array(*[parsed_list(F.col(f"`{i}`")) for i in range(steps)]).alias("x"))


def site_ranges_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(settings.SITE_RANGES, "start int, end int")


def site_table(spark: SparkSession) -> DataFrame:
    """ordinal, position (0-based): a few hundred rows, fixed."""
    return spark.createDataFrame(list(enumerate(settings.site_positions())), "ordinal int, position int")


def period_k_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(settings.PERIOD_CLUSTERS.items()), "period string, k int")
