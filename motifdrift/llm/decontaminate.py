"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are far shorter than the documents that may hold them, so their similarity is tiny and only containment -
the share of an item's shingles that a document has - tells. Items are partitioned by size, in powers of two. Every
item keeps the k least of its hashed shingles as its sketch, k by the size partition. Documents are searched partition by
partition for sketch values alone. A document that holds at least THRESHOLD of an item lacks at most m = n - ceil(THRESHOLD n) of
its shingles, so at least k - m sketch values are hit: pairs with as many are candidates, and none is missed. Only
candidates are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift.llm.shared import written
from motifdrift.llm.words import distinct_in_text, list_array, shingles, slices

WIDTH = 5
THRESHOLD_PERCENT = 80
#: Item shingles that are sent to every task at most (16 bytes each: 64 MB); beyond, documents meet the sketches by shuffle.
BROADCAST_SHINGLES = 4_000_000

FOUND = "doc_id long, item_id long, n_item long, n_shared long"


def missing(n: int) -> int:
    """How many of n shingles a containing document may lack."""
    return n - -(-THRESHOLD_PERCENT * n // 100)


def size_class(n: int) -> int:
    """The size partition of an item of n shingles."""
    return n.bit_length()


def sketch_size(n: int) -> int:
    """k for an item of n shingles: two more than the largest item of its partition may lack, so that a match hits two values or more."""
    return min(n, missing((1 << size_class(n)) - 1) + 2)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, shingle. Items without words have no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            values, at = distinct_in_text(*shingles(text, WIDTH))
            yield pa.record_batch({"item_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(text)), np.diff(at)))), "shingle": pa.array(values.view(np.int64))})

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null").mapInArrow(cut, "item_id long, shingle long")


class SizePartition:
    """Sketches of the items of one size class: sorted values, and the items of each."""

    def __init__(self, values: np.ndarray, items: np.ndarray, least: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, starts = np.unique(values[order], return_index=True)
        self.starts, self.items, self.least = np.append(starts, len(order)), items[order], least

    def candidates(self, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs owner * items + item that hit enough sketch values. values: those of texts that any sketch has."""
        spot = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = np.flatnonzero(self.values[spot] == values)
        spot, n = spot[hit], (self.starts[1:] - self.starts[:-1])[spot[hit]]
        row = np.repeat(self.starts[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, hits = np.unique(np.repeat(owner[hit], n) * len(self.least) + self.items[row], return_counts=True)
        return pairs[hits >= self.least[pairs % len(self.least)]]


class ItemIndex:
    """Sketches by size partition, and the full sets, which only candidates meet."""

    def __init__(self, rows: pa.Table):
        shingle, place, k = (rows.column(c).to_numpy() for c in ("shingle", "place", "k"))
        self.items, of = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        order = np.lexsort((shingle.view(np.uint64), of))
        self.full, self.at = shingle.view(np.uint64)[order], np.searchsorted(of[order], np.arange(len(self.items) + 1))
        self.n = np.diff(self.at)
        least = np.zeros(len(self.items), np.int64)
        least[of] = k
        least = np.maximum(1, least - np.array([missing(int(x)) for x in self.n], np.int64))
        sketched = place < k
        classes = np.array([size_class(int(x)) for x in self.n], np.int64)[of] if len(of) else of
        self.partitions = [SizePartition(shingle[m], of[m], least) for c in np.unique(classes) if (m := sketched & (classes == c)).any()]
        self.sketch = np.unique(shingle[sketched].view(np.uint64))
        #: Pairs that were candidates so far, and those whose full sets agreed.
        self.compared, self.verified = 0, 0

    def search(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item number and shared shingles of all verified pairs, for sorted distinct shingles of texts."""
        if not len(self.sketch):
            return (np.zeros(0, np.int64),) * 3
        hit = np.flatnonzero(self.sketch[np.minimum(np.searchsorted(self.sketch, values), len(self.sketch) - 1)] == values)
        owner = np.searchsorted(at, hit, side="right") - 1
        pairs = np.concatenate([p.candidates(values[hit].view(np.int64), owner) for p in self.partitions])
        text, item = np.divmod(np.sort(pairs), len(self.items))
        shared = np.zeros(len(text), np.int64)
        for j, (t, i) in enumerate(zip(text.tolist(), item.tolist(), strict=True)):
            own, wanted = values[at[t] : at[t + 1]], self.full[self.at[i] : self.at[i + 1]]
            shared[j] = (own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted).sum()
        good = 100 * shared >= THRESHOLD_PERCENT * self.n[item]
        self.compared += len(text)
        self.verified += int(good.sum())
        return text[good], item[good], shared[good]


def found_by_broadcast(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """One pass over the documents without a shuffle."""
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(parts.toArrow()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch, text in slices(batches):
            values, at = distinct_in_text(*shingles(text, WIDTH))
            owner, item, shared = own.search(values, at)
            yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(owner)), "item_id": pa.array(own.items[item]), "n_item": pa.array(own.n[item]), "n_shared": pa.array(shared)})

    return docs.mapInArrow(search, FOUND)


def found_by_shuffle(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The same for item sets of any size."""
    # Rows are told apart by their place, so documents that repeat an id don't add up.
    return found_at_places(docs.withColumn("place", F.monotonically_increasing_id()), parts).drop("place")


def found_at_places(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, place, item_id, n_item, n_shared for docs (doc_id, text, place): sketches meet the documents' shingles by join, and candidate pairs their sets.

    Items of equal sets are searched as one. A sketch value of many documents is on one side of the join only,
    where Spark splits it; the other side has it once for each different item that it stands in.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            values, at = distinct_in_text(*shingles(text, WIDTH))
            yield pa.record_batch({"doc_id": batch.column(0), "place": batch.column(2), "shingles": list_array(values.view(np.int64), at, pa.int64())})

    sets = written(placed.mapInArrow(cut, "doc_id long, place long, shingles array<long>"), "doc-shingles")
    whole = parts.groupBy("item_id", "n", "k").agg(F.array_sort(F.collect_list("shingle")).alias("wanted"))  # a bounded array: one item
    whole = written(whole, "item-sets")
    same = written(whole.groupBy("wanted", "n", "k").agg(F.min("item_id").alias("one")), "item-classes")
    members = whole.join(same.select("wanted", "one"), "wanted").select("one", "item_id")
    lack = F.col("n") - F.ceil(F.lit(THRESHOLD_PERCENT) * F.col("n") / 100)
    sketches = parts.filter("place < k").join(same.select(F.col("one").alias("item_id")), "item_id", "left_semi").select("item_id", "n", "k", "shingle")
    probes = sets.select("place", F.explode("shingles").alias("shingle"))
    candidates = (
        probes.join(written(sketches, "item-sketches").hint("merge"), "shingle").groupBy("place", "item_id", "n", "k").agg(F.count("*").alias("hits"))
        .filter(F.col("hits") >= F.greatest(F.lit(1), F.col("k") - lack)).select("place", F.col("item_id").alias("one"))
    )
    pairs = written(candidates, "item-candidates").join(same.select("one", "wanted", "n"), "one")
    both = sets.join(pairs.hint("merge"), "place")
    good = both.select("doc_id", "place", "one", F.col("n").alias("n_item"), F.size(F.array_intersect("shingles", "wanted")).cast("long").alias("n_shared"))
    return good.filter(100 * F.col("n_shared") >= THRESHOLD_PERCENT * F.col("n_item")).join(members, "one").select("doc_id", "place", "item_id", "n_item", "n_shared")


def indexed_items(items: DataFrame) -> DataFrame:
    """A written table: item_id, n (size), k (sketch_size), place (0: least hash), shingle. Items that repeat an id are one item with all their shingles."""
    parts, again = item_shingles(items).distinct(), Window.partitionBy("item_id")
    most = F.expr("shiftleft(1L, length(bin(n))) - 1L")  # the largest item of the size partition
    return written(
        parts.withColumn("n", F.count("*").over(again))
        .withColumn("place", (F.row_number().over(again.orderBy(F.xxhash64("shingle"), "shingle")) - 1).cast("long"))
        .withColumn("k", F.least("n", most - F.ceil(F.lit(THRESHOLD_PERCENT) * most / 100) + 2))
        .select("item_id", "n", "k", "place", "shingle"),
        "item-shingles",
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every document and item of which it holds 80 % of the shingles or more.

    Null and empty texts and items match nothing. A text of fewer than five words is one shingle, its whole sequence, so a short
    item only matches a text that is the same. Rows that repeat an id are documents of their own, and one row each. Items
    without an id are left out; items that repeat an id with another text count as one item with all their shingles. Rows
    without a doc_id are reported with a null id. Only ids and texts are read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = indexed_items(items)
    search = found_by_broadcast if parts.count() <= most_shingles else found_by_shuffle
    return search(docs, parts).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame, most_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of docs (doc_id, text, any others) that hold no item, with all their columns."""
    parts = indexed_items(items)
    if parts.count() > most_shingles:
        # Rows go by their place: others with the same id, or without one, stay. The table keeps places as they are.
        placed = written(docs.withColumn("_place", F.monotonically_increasing_id()), "placed-docs")
        bad = found_at_places(placed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_place").alias("place")), parts)
        return placed.join(bad.select(F.col("place").alias("_place")).distinct(), "_place", "left_anti").select(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(parts.toArrow()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            clean = np.ones(len(text), bool)
            clean[index.value.search(*distinct_in_text(*shingles(text, WIDTH)))[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
