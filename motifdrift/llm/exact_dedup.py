"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition makes one run: a row for each distinct text in it, with the smallest identifier and the
count. Inputs of few partitions are cut into more runs, at least two for each one of a merge, so that they are merged like any other. Runs then meet in binomial rounds: in a round, FAN_IN neighbouring runs are exchanged, cut by digest
range, and merged into one sorted run: equal digests are neighbours in its order, the first of them has the smallest identifier
and stays with the sum of their counts. A digest has at most FAN_IN rows in any merge, however many copies it
has. A digest is verified at every level by a second hash and the byte length, which are part of the
order: texts that shared a SHA-256 alone would stay apart. Every level's runs are written, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift.llm.shared import SPACE, partitions, text_or_empty, written

FAN_IN = 8
KEY = ["digest", "proof", "n_bytes"]


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE + "+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, digest of the normalised text, its proof (second hash, bytes), its run (partition) and its place there."""
    return docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("proof"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("place"),
    )


def merge_round(runs: DataFrame, span: int, n: int) -> DataFrame:
    """One binomial round: runs whose numbers agree up to span go to the lowest of them and are merged there, by one sort order.

    An identifier of null comes last among equals, as it is never the smallest.
    """
    order = [F.asc_nulls_last("keep_id"), F.col("from_run")]
    equal = Window.partitionBy("run", "range", *KEY).orderBy(*order)
    return (
        runs.withColumnRenamed("run", "from_run")
        .withColumn("run", (F.col("from_run") - F.col("from_run") % span).cast("int"))
        .withColumn("range", F.substring("digest", 1, 2))
        .repartition(n, "run", "range")
        .sortWithinPartitions("run", "range", *KEY, *order)
        .withColumn("nth", F.row_number().over(equal))
        .withColumn("group_size", F.sum("group_size").over(equal.rowsBetween(0, Window.unboundedFollowing)))
        .filter("nth = 1")
        .select("run", *KEY, "keep_id", "group_size")
    )


def first_runs(rows: DataFrame) -> DataFrame:
    """A row for each distinct text of each input partition; copies are counted before anything is exchanged."""
    return rows.groupBy("run", *KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The root of the tree: one sorted run, a row for each distinct text. rows: a written table of digests()."""
    n = partitions(rows.sparkSession)
    n_parts = (rows.agg(F.max("run")).first()[0] or 0) + 1
    cuts = max(1, -(-2 * fan_in // n_parts))
    n_runs = n_parts * cuts
    runs, span = first_runs(rows.withColumn("run", (F.col("run") * cuts + F.pmod("place", F.lit(cuts))).cast("int"))), 1
    while span < n_runs:
        span *= fan_in
        runs = written(merge_round(runs, span, n), "exact-runs")
    return runs.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Null texts count as empty; all empty texts are one group. Rows that repeat with one id and one text all count in
    group_size and are all kept, as no id tells them apart. A null id is never
    the smallest unless the whole group has none; such a row is kept only then. An empty table gives no rows. Other
    columns of docs are not read, so their names can't clash.
    """
    rows = written(digests(docs, id_col, text_col), "exact-digests")
    root = merged_runs(rows, fan_in)
    # The one side has a row for each distinct text; a hot digest is on the other side only, where Spark splits it.
    return rows.join(root.hint("merge"), KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their equal texts, with all their columns. Of rows with one id, each text is judged by itself."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.sha2(normalised(text_col), 256) == kept["_kept_text"]), "left_semi")
