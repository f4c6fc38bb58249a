"""Incremental ingest: new FASTA files are cleaned and appended to their periods once, with the periods of every isolate as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifdrift.functions.columns import PERIODS, parsed_date
from motifdrift.operators.clean import apply_day_policy, split_description, valid_sequences
from motifdrift.sources.fasta import RECORD_SEPARATOR

STORED = "isolate_name string, timestamp date, sequence string, period string, file string, block long, place long"
#: What takes a row to its place: files in order of arrival, then the split of the file, then the record in it.
ORDER = ["arrived", "file", "block", "place"]
FILES = 1_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored(spark: SparkSession, root: str) -> DataFrame:
    """What has been ingested; nothing before the first batch."""
    try:
        return spark.read.schema(STORED).parquet(root)
    except Exception as e:  # the folder comes with the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORED)


def ingest_stream(spark: SparkSession, directory: str, root: str, checkpoint: str, technique: str = "month", files: int = FILES):
    """A running query that takes all new files of directory, up to `files` of them in a micro-batch, and stops when all are read.

    A file counts as a batch: of an isolate's rows in it the first is taken, before dates are looked at. It is kept if it has a date and the isolate
    isn't in that period yet; files count in order of arrival, however they are dealt to micro-batches. The periods of each isolate are state in RocksDB under
    checkpoint, so a batch reads neither what is stored nor its folders. Rows are appended through the sink's log, so a replayed batch adds nothing.
    """
    raw = spark.readStream.option("lineSep", RECORD_SEPARATOR).option("maxFilesPerTrigger", files).format("text").load(directory)
    named = apply_day_policy(split_description(valid_sequences(parsed_stream(raw))))
    dated = named.withColumn("timestamp", parsed_date(F.col("timestamp")))
    rows = dated.withColumn("period", PERIODS[technique](F.col("timestamp"))).filter("isolate_name is not null")
    new = first_of_files(rows).groupBy("isolate_name").applyInPandasWithState(unseen, STORED, "periods array<string>", "append", "NoTimeout")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the settings that it starts with
    try:
        out = new.writeStream.format("parquet").partitionBy("period").option("path", root).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def parsed_stream(raw: DataFrame) -> DataFrame:
    """description, sequence and ORDER but for the place, of a stream of raw records."""
    text = F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", "")
    cut = raw.select(
        text.alias("t"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    rows = cut.select(
        *ORDER[:-1], F.concat(F.lit(">"), F.substring_index("t", "\n", 1)).alias("description"),
        F.when(F.instr("t", "\n") > 0, F.regexp_replace(F.expr("substring(t, instr(t, '\n') + 1)"), "\n", "")).otherwise("").alias("sequence"),
    )
    return rows.filter("sequence <> ''")


def first_of_files(rows: DataFrame) -> DataFrame:
    """rows with their place in the split, without what follows an isolate's first row of the same file in an Arrow batch: an isolate of very many rows is few before the shuffle."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:  # in order of the split
            place = pa.array(range(read, read + batch.num_rows), pa.int64())
            read += batch.num_rows
            batch = pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])
            keys = pa.Table.from_batches([batch.select(["file", "block", "isolate_name"])]).append_column("i", pa.array(range(batch.num_rows)))
            first = keys.group_by(["file", "block", "isolate_name"], use_threads=False).aggregate([("i", "min")])
            yield batch.take(first.column("i_min").combine_chunks())

    return rows.mapInArrow(thin, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())]))


def unseen(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """An isolate's rows of new files: the first of each file, if its period is new to the isolate."""
    best = None
    for part in parts:
        part = part if best is None else pd.concat([best, part])
        best = part.sort_values(ORDER).drop_duplicates(["arrived", "file"])
    seen = list(state.get[0]) if state.exists else []
    rows = best[best["period"].notna() & ~best["period"].isin(seen)].drop_duplicates("period")
    if len(rows):
        state.update((seen + rows["period"].tolist(),))
        yield rows.assign(isolate_name=key[0])[["isolate_name", "timestamp", "sequence", "period", "file", "block", "place"]]
