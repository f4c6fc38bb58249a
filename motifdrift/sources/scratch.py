"""Tables in the folder that the driver and all executors share: what cuts a plan and survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_motifdrift_dir", None) or tempfile.mkdtemp(prefix="spark-motifdrift-")
    spark._motifdrift_dir = made
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark._motifdrift_paths = [*getattr(spark, "_motifdrift_paths", []), path]
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads files, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table or file wherever it is stored; a path that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that new_path() has named in this session so far, once no result that reads them is needed any more; how many there were."""
    paths, spark._motifdrift_paths = getattr(spark, "_motifdrift_paths", []), []
    for p in paths:
        deleted(spark, p)
    return len(paths)
