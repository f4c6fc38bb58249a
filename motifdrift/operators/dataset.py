"""Labelled rows from walks; de-duplication, shards, shuffling and splitting of datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifdrift import settings
from motifdrift.functions.columns import drawn
from motifdrift.operators import walks
from motifdrift.operators.clean import first_of, value_key
from motifdrift.operators.ngrams import SiteIds, around_sites, places_around
from motifdrift.sources.scratch import written

#: Walks whose rows a task makes at once.
WALKS = 64


def label_mutation(last: Column, y: Column, exact: bool = False) -> Column:
    """0 if the two id triples share three distinct ids, else 1. exact: 0 only if they are the same triple."""
    return F.when(last == y if exact else F.size(F.array_intersect(last, y)) == 3, 0).otherwise(1)


def labels(last: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """label_mutation() of cells of three ids each (-1: none, at the end)."""
    if exact:
        return (last != y).any(-1).astype(np.int32)
    shared = np.zeros(last.shape[:-1], np.int32)
    for i in range(3):
        one = last[..., i]
        shared += (one >= 0) & (one[..., None] == y).any(-1) & ~(last[..., :i] == one[..., None]).any(-1)
    return (shared != 3).astype(np.int32)


def nested(x: np.ndarray) -> pa.Array:
    """rows x steps x 3 as arrays of arrays; -1 is left out."""
    n, steps, _ = x.shape
    there = x >= 0
    inner = np.concatenate([[0], np.cumsum(there.sum(-1).reshape(-1))]).astype(np.int32)
    cells = pa.ListArray.from_arrays(pa.array(inner), pa.array(x[there]))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * steps + 1, steps, dtype=np.int32) if steps else np.zeros(n + 1, np.int32)), cells)


def coded(x: np.ndarray, kind: str) -> pa.Array:
    """rows x steps x 3 as bytes, which are equal where the rows are."""
    data = np.ascontiguousarray(x.astype(kind))
    width = data.itemsize * x.shape[1] * 3
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)), pa.py_buffer(data)])


ROW_COLUMNS = {"y": "y int", "x": "x array<array<int>>", "code": "code binary"}


def build_rows(
    walks: DataFrame, sites: DataFrame, vocab: DataFrame, strict: bool = True, exact: bool = False, take: tuple[str, ...] = ("y", "x"), cut: bool = False
) -> DataFrame:
    """sample_id, ordinal, y, x (array of id triples) for each walk (sample_id, seqs) and site entry. All rows of a walk are made of its own row, without an exchange.

    take: which columns to make besides the first two; code is x as bytes, by which rows are compared or exchanged (decoded() makes x of it).
    cut: seqs are around_sites() of the sequences.
    """
    entries = sorted((r.ordinal, r.position) for r in sites.collect())  # fixed, a few hundred
    if not take:
        return walks.filter(F.size("seqs") > 0).select("sample_id", F.explode(F.array(*[F.lit(o) for o, _ in entries])).alias("ordinal"))
    words = vocab.groupBy("words").agg(F.min("idx").alias("idx")).collect()  # bounded by the alphabet
    places = [p for _, p in entries]
    lookup = SiteIds([r.words for r in words], [r.idx for r in words], places_around(places) if cut else places)
    ordinals, kind = np.array([o for o, _ in entries], np.int32), code_kind(max((r.idx for r in words), default=0))
    key = walks.schema["sample_id"].dataType.simpleString()

    def rows(keys: pa.Array, texts: list[str], steps: int) -> pa.RecordBatch:
        if steps < 2:
            raise ValueError("a walk needs two steps")
        cells = lookup.of(texts, strict).reshape(len(keys), steps, len(entries), 3).transpose(0, 2, 1, 3).reshape(-1, steps, 3)
        if (cells < 0).any():
            cells = np.take_along_axis(cells, np.argsort(cells < 0, axis=-1, kind="stable"), -1)
        made = {"y": lambda: pa.array(labels(cells[:, -2], cells[:, -1], exact)), "x": lambda: nested(cells[:, :-1]), "code": lambda: coded(cells[:, :-1], kind)}
        first = [keys.take(pa.array(np.repeat(np.arange(len(keys)), len(entries)))), pa.array(np.tile(ordinals, len(keys)))]
        return pa.RecordBatch.from_arrays([*first, *[made[c]() for c in take]], ["sample_id", "ordinal", *take])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, WALKS):
                part = batch.slice(low, WALKS)
                lengths = np.array([len(w or ()) for w in part.column(1).to_pylist()])
                for steps in np.unique(lengths[lengths > 0]):
                    at = pa.array(np.flatnonzero(lengths == steps))
                    yield rows(part.column(0).take(at), [t or "" for t in part.column(1).take(at).flatten().to_pylist()], int(steps))

    return walks.select("sample_id", "seqs").mapInArrow(run, ", ".join([f"sample_id {key}", "ordinal int", *[ROW_COLUMNS[c] for c in take]]))


def code_kind(top: int) -> str:
    """How ids up to top are written in a code: so that none of them is all ones, which stands for no id."""
    return ">u2" if top < 0xFFFF else ">u4"


def code_ids(codes: pa.Array, steps: int, top: int) -> np.ndarray:
    """rows x steps x 3 of codes; -1 is no id. top: the highest id of the vocabulary."""
    kind = np.dtype(code_kind(top))
    ids = np.frombuffer(b"".join(codes.to_pylist()), kind).reshape(len(codes), steps, 3)
    return np.where(ids == np.iinfo(kind).max, -1, ids.astype(np.int64)).astype(np.int32)


def decoded(df: DataFrame, steps: int, top: int) -> DataFrame:
    """df with x in the place of code. top: the highest id of the vocabulary."""
    columns = df.columns
    names = ["x" if c == "code" else c for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = nested(code_ids(batch.column("code"), steps, top))
            yield pa.RecordBatch.from_arrays([x if c == "code" else batch.column(c) for c in columns], names)

    return df.mapInArrow(run, ", ".join(ROW_COLUMNS["x"] if c == "code" else f"{c} {df.schema[c].dataType.simpleString()}" for c in columns))


def dedupe_dataset(df: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The first row of each x; y doesn't count. keep: the columns of the result; without x among them, only its digest travels. Rows with a code instead of x are told apart by it."""
    return first_of(df, ["code"], order, (), keep) if "code" in df.columns else first_of(df, [], order, ("x",), keep)


def merge_shards(shards: list[DataFrame], order: str = "row_id", keep: list[str] | None = None) -> DataFrame:
    """Union of shards in the given order, with shard; the first row of each x stays."""
    out = None
    for i, s in enumerate(shards):
        one = s.withColumn("shard", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return dedupe_dataset(out, ["shard", order], keep)


def unique_ratio(df: DataFrame, target: int | None = None) -> DataFrame:
    """n_rows, n_unique, percent of target (all rows without one). By the code, where there is one instead of x."""
    counts = df.groupBy("code" if "code" in df.columns else value_key("x")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_unique"))
    base = F.lit(target) if target else F.nullif(F.col("n_rows"), F.lit(0))
    return counts.withColumn("percent", F.col("n_unique") * 100.0 / base)


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A reproducible permutation: by shuffle_key(), which is added. Keys are even, so their first digits tell the partition: no sample is taken, and the key doesn't travel."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long")
    parts = df.repartitionById(n, F.floor(first * n / F.lit(1 << 32)).cast("int"))
    return parts.sortWithinPartitions(shuffle_key(key, seed), key).withColumn("shuffle_key", shuffle_key(key, seed))


def train_test_split(df: DataFrame, key: str, seed: int, test_percent: int = 20, size: int = 1) -> DataFrame:
    """Adds is_test, drawn by key; by key // size with a size, so that rows of one walk (its sites, numbered in a row) are in the same part."""
    unit = F.col(key) if size == 1 else F.floor(F.col(key) / size)
    return df.withColumn("is_test", drawn(seed, "split", unit) % 100 < test_percent)


def refill_dataset(generate: Callable[[int, int], DataFrame], target: int, ratio: float = settings.UNIQUE_RATIO, most: int = 10) -> DataFrame:
    """Rows (turn, row_id, y, x) without repeats: generate(n, turn) makes about n rows; what repeats is made anew, until duplicates are below ratio.

    turn goes into the seed. Both numbers are shares of target. A turn handles its own rows: they are told apart by themselves, and then meet the digests of
    what is there already, of which a key of some 30 bytes is stored for each row; earlier rows aren't read again. Rows with a code instead of x are told apart by it.
    """
    parts, keys, missing = [], [], target
    for turn in range(most):
        rows = generate(missing, turn).withColumn("turn", F.lit(turn))
        made = dedupe_dataset(rows, ["row_id"]).withColumn("_key", F.col("code") if "code" in rows.columns else value_key("x"))
        if keys:
            known = reduce(lambda a, b: a.unionByName(b), keys)
            made = made.join(known.withColumnRenamed("_key", "_known"), F.col("_key").eqNullSafe(F.col("_known")), "left_anti")
        made = written(made, "refill")
        parts.append(made.drop("_key"))
        keys.append(made.select("_key"))  # of the stored rows only this column is read
        missing -= made.count()
        if missing <= target * ratio:
            break
    return reduce(lambda a, b: a.unionByName(b), parts)


def create_dataset(
    members: DataFrame, links: DataFrame, vocab: DataFrame, sites: DataFrame, rows: int = settings.DATASET_ROWS, size: int = settings.WINDOW_SIZE, seed: int = 1,
    take: tuple[str, ...] = ("y", "x"), in_order: bool = True,
) -> DataFrame:
    """row_id, y, x of about `rows` rows, shuffled: windows of periods, walks shared out over them, a row for each walk and site.

    members: numbered_members() with sequences, or dataset_members() of them; links: period_idx, cluster, next_cluster. Periods may be missing.
    take: other columns, as build_rows() makes them. in_order: without it, rows stay where they are made, for results that have no order.
    """
    links = written(links, "dataset-links")
    periods = links.select("period_idx", F.col("period_idx").alias("period")).distinct()
    windows = walks.period_windows(periods, size)  # a row for each period at most
    first = windows.select("window_id", F.get("x", F.lit(0)).alias("period_idx"), F.size("x").alias("steps"))
    starts = walks.sample_table(windows, walks.allocate_samples(windows, rows)).join(F.broadcast(first), "window_id")
    starts = written(starts, "dataset-samples")
    steps = windows.select(F.size("x")).first()
    if steps is None:
        raise ValueError("a dataset needs two periods")
    members = members if "letters" in members.columns else dataset_members(members, sites)
    made = walks.sample_walks(starts.select("sample_id", "period_idx"), links, members, steps[0], seed)
    coded = in_order and "x" in take  # rows are exchanged with a code
    built = build_rows(made, sites, vocab, take=tuple("code" if c == "x" and coded else c for c in take), cut=True)
    built = built.withColumn("row_id", F.col("sample_id").cast("long") * len(settings.site_positions()) + F.col("ordinal")).drop("sample_id", "ordinal")
    out = shuffled(built, "row_id", seed).drop("shuffle_key") if in_order else built
    return (decoded(out, steps[0], vocab.agg(F.max("idx")).first()[0] or 0) if coded else out).select("row_id", *take)


def dataset_members(members: DataFrame, sites: DataFrame) -> DataFrame:
    """walks.walk_members() that carry only what is around sites."""
    return walks.walk_members(members, around_sites(F.col("sequence"), [r.position for r in sites.orderBy("ordinal").collect()]))


def create_shards(generate: Callable[[int], DataFrame], n: int = 20) -> list[DataFrame]:
    """n independent generations; the shard's number is part of its seed."""
    return [generate(i) for i in range(n)]
