"""Variable-capacity best-fit packing: several permitted sequence lengths, optimised jointly.

Documents are cut into pieces of the largest permitted length at most. Pieces are dealt at random into groups of bounded
size; in a group, pieces go by falling length to the bin that they fill best. Where none has room, a bin is opened. Its
size is the one of least cost for each token that the bin can get: for every permitted size, what of the remaining pieces
would fill it best is looked up, less what the bins that are open will take. A group is packed so, and with each permitted size
as the usual one; the cheapest of these packings is taken. At the end every bin shrinks to the least
permitted length that holds its contents. A piece's group is told by its id, length and number, not by the partition
that it is in, and only ids and lengths travel.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import partitions, written
from motifdrift.llm.words import slices

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: A bin costs OVERHEAD + size + QUADRATIC * size ** 2: its own start, its tokens, and the pairs that attention looks at.
OVERHEAD, QUADRATIC = 64.0, 1 / 16384
GROUP_PIECES = 16_384
#: Equal rows that one task makes from a count at most.
COPIES = 100_000

PACKED = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, capacity long"


def cost(size: int) -> float:
    return OVERHEAD + size + QUADRATIC * size * size


class Remaining:
    """Counts of the pieces that are still to be packed, by length; falling lengths are taken."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.counts, self.total = values.tolist(), counts.tolist(), int(lengths.sum())

    def take(self, n: int) -> None:
        """One piece of the largest remaining length n goes."""
        self.counts[-1] -= 1
        self.total -= n
        if not self.counts[-1]:
            self.values.pop()
            self.counts.pop()

    def fill(self, room: int) -> int:
        """Tokens that largest-first filling puts into an empty room."""
        left, top = room, len(self.values)
        while left and (top := bisect_right(self.values, left, 0, top)):
            top -= 1
            left -= self.values[top] * min(self.counts[top], left // self.values[top])
        return room - left


def opened(n: int, sizes: tuple[int, ...], rest: Remaining, room: int) -> int:
    """The size of least cost a token for a bin that begins with a piece of n tokens. room: what open bins have left, which the rest fills first."""
    free = max(0, rest.total - room)
    return min((s for s in sizes if s >= n), key=lambda s: (cost(s) / (n + min(free, rest.fill(s - n))), s))


def packed_with(lengths: np.ndarray, order: list[int], sizes: tuple[int, ...], usual: int | None) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """Bin and offset of each piece, each bin's final size, and what all bins cost. usual: the size to open where a piece fits it; None: opened()."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    room, rest = 0, Remaining(lengths)
    for i in order:
        n = int(lengths[i])
        rest.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
            room -= n
        else:
            free = opened(n, sizes, rest, room) if usual is None else next(s for s in sizes if s >= max(n, usual))
            b = len(used)
            used.append(0)
            room += free - n
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(rooms, (free - n, b))
    final = [next(s for s in sizes if s >= u) for u in used]
    return bins, offsets, final, sum(map(cost, final))


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and the bin's final size for each length (each at most the largest size). Equal lengths go in the given order."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable").tolist()
    bins, offsets, final, _ = min((packed_with(lengths, order, sizes, usual) for usual in (None, *sizes)), key=lambda x: x[3])
    return bins, offsets, np.array(final, np.int64)[bins] if len(bins) else np.zeros(0, np.int64)


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens: words between [\\x20\\x09-\\x0D], and one end mark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            n = pc.list_value_length(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))).to_numpy(zero_copy_only=False).astype(np.int64)
            n[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(text)), 0).to_numpy(zero_copy_only=False)] = 0
            yield pa.record_batch({"doc_id": batch.column(0), "tokens": pa.array(n + 1)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, tokens long")


def packed(lengths: DataFrame, sizes: tuple[int, ...] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece of lengths (doc_id, tokens): where it starts in its document, its bin, its offset there, the bin's final capacity.

    A document without tokens (null, 0 or less) has no piece. Repeated rows and ids are packed like others, null ids too: rows
    of equal id and tokens are counted before they are dealt, so a hot one is a row for each task. Ties in length go
    by id, tokens and number. An empty table gives no rows. bin_id is unique over all groups. The result doesn't depend on how
    lengths is partitioned.
    """
    most = max(sizes)
    # A written table: its few columns are read again, and a count of copies stands for rows that are the same.
    placed = written(lengths.filter("tokens > 0").groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")), "lengths")
    n_pieces = F.floor((F.col("tokens") - 1) / most) + 1
    total = placed.agg(F.sum(F.col("copies") * n_pieces)).first()[0] or 0
    n_groups = max(1, -(-int(total) // group_pieces))
    # Many copies are dealt out in two steps, so that none of them are made in one task.
    several = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))))
    many = several.filter(F.col("copies") > COPIES).repartition(partitions(lengths.sparkSession), "doc_id", "tokens", "_part")
    several = several.filter(F.col("copies") <= COPIES).unionByName(many)
    last = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("_part") * F.lit(COPIES)) - 1
    rows = several.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("copy", F.col("_part").cast("long") * COPIES + F.col("_copy"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int")))).select(
        "doc_id", "tokens", "copy", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece").cast("long") * most).alias("length")
    )
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(11), "doc_id", "tokens", "copy", "piece"), F.lit(n_groups)).cast("long"))

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("tokens", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = pack(part.column("length").to_numpy(), sizes)
        ids = part.column("group").to_numpy() * (1 << 32) + bins
        return pa.table({
            **{c: part.column(c) for c in ("doc_id", "piece", "start", "length")},
            "bin_id": pa.array(ids), "bin_offset": pa.array(offsets), "capacity": pa.array(capacity),
        })

    return grouped.groupBy("group").applyInArrow(fill, PACKED)


def packed_documents(docs: DataFrame, sizes: tuple[int, ...] = LENGTHS) -> DataFrame:
    return packed(word_lengths(docs), sizes)
