"""Sequence files: FASTA text in, records in file order out; and a sparse offset index, by which a slice reads only its own bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift import settings
from motifdrift.sources.scratch import written

RECORD_SEPARATOR = "\n>"
#: Starts of file splits that go to every task at most (some 200 bytes each); of more, records are shuffled to them.
BROADCAST_SPLITS = 100_000
#: An entry of the offset index covers so many records at most, and about so many bytes.
INDEXED, INDEXED_BYTES = 10_000, 16 << 20
INDEX = "file string, first_record long, first_byte long, end_byte long, n_records long"


def parsed_records(raw: DataFrame) -> DataFrame:
    """value (one record of text) to description, sequence and the keys of its place. Wrapped sequences are joined; a record without any is dropped.

    place rises by one from record to record of a file split, which one task reads.
    """
    text = F.regexp_replace("value", r"^\s*>", "")
    cut = F.regexp_replace(text, "\r", "")
    return (
        raw.select(cut.alias("t"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .select("file", "block", F.concat(F.lit(">"), F.substring_index("t", "\n", 1)).alias("description"),
                F.when(F.instr("t", "\n") > 0, F.regexp_replace(F.expr("substring(t, instr(t, '\n') + 1)"), "\n", "")).otherwise("").alias("sequence"))
        .filter("sequence <> ''")
        .withColumn("place", F.monotonically_increasing_id())
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_idx (from 0, in order of file name and place), description, sequence.

    Parsed records are written once and numbered from there, so numbers don't depend on how two jobs split the files.
    """
    parsed = written(parsed_records(spark.read.option("lineSep", RECORD_SEPARATOR).text(path)), "fasta-records")
    return with_record_idx(parsed, ["file", "block"], "place").select("record_idx", "description", "sequence")


def index_fasta(spark: SparkSession, path: str, root: str, records: int = INDEXED, most_bytes: int = INDEXED_BYTES) -> None:
    """Writes INDEX of the files under path: which bytes hold which records. One scan, in which no text leaves the JVM.

    Records are numbered as read_fasta() does. Files must be plain UTF-8 (not compressed): entries that don't add up to a file's size are an error.
    """
    raw = spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
    told = F.regexp_replace("value", r"^\s*>", "").alias("t")
    kept = F.expr(r"instr(t, '\n') > 0 and substring(t, instr(t, '\n') + 1) rlike '[^\r\n]'")
    of = [F.col(f"_metadata.{m}").alias(m) for m in ("file_path", "file_size", "file_block_start")]
    lengths = raw.select(*of, F.octet_length("value").cast("long").alias("n"), told).select("file_path", "file_size", "file_block_start", "n", kept.alias("kept"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            block, n, own = batch.column(2).to_numpy(), batch.column(3).to_numpy() + len(RECORD_SEPARATOR), batch.column(4).to_numpy(zero_copy_only=False)
            names = batch.column(0).dictionary_encode().indices.to_numpy()
            key = np.stack([names, block, np.arange(len(n)) // records, np.cumsum(n) // most_bytes])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(n) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else first
            yield pa.record_batch({
                "file": batch.column(0).take(pa.array(first)), "size": batch.column(1).take(pa.array(first)), "block": pa.array(block[first]),
                "no": pa.array(number * (1 << 20) + np.arange(len(first))), "n_bytes": pa.array(add(n)), "n_records": pa.array(add(own)),
            })

    found = written(lengths.mapInArrow(entries, "file string, size long, block long, no long, n_bytes long, n_records long"), "fasta-entries")
    in_file = Window.partitionBy("file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, -1)  # over entries of a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over files
    files = found.groupBy("file").agg(F.sum("n_bytes").alias("bytes"), F.sum("n_records").alias("n"), F.max("size").alias("size"))
    # The last record of a file has no separator behind it, unless the file ends in one.
    wrong = files.filter(~(F.col("bytes") - F.col("size")).isin(0, len(RECORD_SEPARATOR))).select("file").first()
    if wrong:
        raise ValueError(f"{wrong.file} is compressed or not UTF-8: records can't be found by their offsets")
    starts = files.select("file", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    at = lambda c: F.coalesce(F.sum(c).over(in_file), F.lit(0))
    placed = found.withColumns({"first_byte": at("n_bytes"), "_in": at("n_records")}).drop("size").join(starts, "file")
    out = placed.select(
        "file", (F.col("_before") + F.col("_in")).alias("first_record"), "first_byte", F.least(F.col("first_byte") + F.col("n_bytes"), "size").alias("end_byte"), "n_records"
    )
    out.repartitionByRange("first_record").sortWithinPartitions("first_record").write.mode("overwrite").parquet(root)


def opened(uri: str):
    """A file of any store that Arrow knows, for reading at offsets."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_indexed(spark: SparkSession, root: str, start: int = 0, count: int | None = None, open_file: Callable = opened) -> DataFrame:
    """record_idx, description, sequence of `count` records from start on (all without it), by the index at root.

    The index is pruned by pushed filters, its entries are dealt out, and each task reads the bytes of its entries alone. open_file is for stores that Arrow lacks.
    """
    entries = spark.read.schema(INDEX).parquet(root).filter((F.col("n_records") > 0) & (F.col("first_record") + F.col("n_records") > start))
    end = None if count is None else start + count
    entries = entries if end is None else entries.filter(F.col("first_record") < end)
    separator = RECORD_SEPARATOR.encode()
    tasks = max(1, min(entries.count(), 8 * spark.sparkContext.defaultParallelism))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in batch.to_pylist():
                with open_file(e["file"]) as f:
                    f.seek(e["first_byte"])
                    data = f.read(e["end_byte"] - e["first_byte"])
                parts = (re.sub(rb"^\s*>", b"", p).replace(b"\r", b"").split(b"\n") for p in data.removesuffix(separator).split(separator))
                rows = [(b">" + head, sequence) for head, sequence in ((head, b"".join(rest)) for head, *rest in parts) if sequence]
                a, b = max(0, start - e["first_record"]), len(rows) if end is None else min(len(rows), end - e["first_record"])
                text = [pa.array([r[k] for r in rows[a:b]], pa.binary()).cast(pa.string()) for k in (0, 1)]
                yield pa.record_batch([pa.array(np.arange(a, max(a, b)) + e["first_record"]), *text], ["record_idx", "description", "sequence"])

    return entries.repartition(tasks).mapInArrow(parse, "record_idx long, description string, sequence string")


def with_record_idx(df: DataFrame, blocks: list[str], place: str) -> DataFrame:
    """Numbers rows by blocks and place, which rises by one in a block: blocks start where the ones before end, and no row is shuffled for its number."""
    counts = df.groupBy(*blocks).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))  # a row for each file split
    before = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*blocks, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    few = df.sparkSession.createDataFrame(starts.limit(BROADCAST_SPLITS + 1).collect(), starts.schema)  # small rows, once for each split
    many = few.count() > BROADCAST_SPLITS
    return df.join(starts if many else F.broadcast(few), blocks).withColumn("record_idx", F.col(place) + F.col("_shift")).drop("_shift")


def slice_records(df: DataFrame, start: int = settings.START_RECORD, batch: int = settings.BATCH_RECORDS, most: int = settings.MOST_BATCHES) -> DataFrame:
    """Records from start on, at most `most` batches of `batch` of them; adds batch_no. A filter on record_idx, so it reaches the scan."""
    idx = F.col("record_idx")
    return df.filter((idx >= start) & (idx < start + batch * most)).withColumn("batch_no", F.floor((idx - start) / batch).cast("int"))


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_records"))


def fasta_lines(df: DataFrame) -> Column:
    return F.concat_ws("\n", "description", "sequence")


def write_fasta(df: DataFrame, path: str) -> None:
    """description (with its >) and sequence on a line each."""
    df.select(fasta_lines(df).alias("value")).write.text(path)
