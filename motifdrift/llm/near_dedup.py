"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification on full shingle sets.

Circulant MinHash: sigma scatters a set over D places; coordinate k of the signature comes from the least value of one
permutation pi, shifted k places around, over the set. So two permutations give all coordinates, and the K values that a
shingle contributes lie side by side in memory. A coordinate is the least shingle in the place that has that value, so sets far
larger than D agree no more often than their Jaccard says.

1. Documents with equal shingle sets are one class; its smallest id is its node. An id with several sets links their nodes.
2. Signatures are cut into bands; nodes that agree in a band share a bucket.
3. In each bucket all nodes are verified against a pivot (a link is linear work in the size of the bucket). Verified links
   give components.
4. What is left are pairs of a bucket that are in different components and include no pivot. They are verified exactly too,
   in blocks of bounded size; a pair counts only in the first band that it shares. Only buckets that still hold
   several components come here, and pairs inside the largest component of a bucket never do.
No bucket, partner or candidate is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.components import components
from motifdrift.llm.shared import written
from motifdrift.llm.words import binary_rows, distinct_in_text, list_array, mixed, shingles, slices

WIDTH = 5
#: At a Jaccard of 0.85, (1 - 0.85 ** ROWS) ** BANDS = 7e-8 of the pairs share no bucket. Other thresholds have as many bands as MISSED asks for.
ROWS, BANDS = 5, 28
MISSED = 1e-7
LEAST_PERCENT = 85
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS
SEED = 5
#: Buckets choose their pivot by one of so many orders.
PIVOTS = 3
#: A bucket's nodes are dealt over keys of about so many where they meet what is known of the bucket.
SALTED = 128
#: A block of step 4 has about so many nodes and so many shingles (8 bytes each) at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Bytes of text whose shingles are held at once.
SIGNED_BYTES = 8 << 20
#: Node ids that are broadcast at most (16 MB); beyond, texts are joined by shuffle.
BROADCAST_NODES = 2_000_000


def bands_for(least_percent: int) -> int:
    """The fewest bands with which at most MISSED of the pairs at the threshold share no bucket: 28 at 85, 41 at 80."""
    return math.ceil(math.log(MISSED) / math.log1p(-((least_percent / 100) ** ROWS)))


@lru_cache(maxsize=2)
def permutations(n: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sigma; pi followed by its first n values, as overlapping rows of n; and the inverses of both."""
    rng = np.random.default_rng(SEED)
    sigma = rng.permutation(PLACES).astype(np.int32)
    pi = rng.permutation(PLACES).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:n]]), n), np.argsort(sigma).astype(np.int32), np.argsort(pi).astype(np.int32)


def signatures(values: np.ndarray, offsets: np.ndarray, step: int = 1 << 15, bands: int = BANDS) -> np.ndarray:
    """A row of ROWS * bands coordinates for each text (values: sorted in each); texts without shingles have the largest value everywhere."""
    n = ROWS * bands
    sigma, pi, sigma_back, pi_back = permutations(n)
    least = np.full((len(offsets) - 1, n), np.iinfo(np.int32).max, np.int32)
    out = np.full((len(offsets) - 1, n), np.iinfo(np.uint64).max, np.uint64)
    if not len(values):
        return out
    # A text's shingles are in order of their raw places, so the first of each place is the least there.
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    spot = (owner << PLACE_BITS) | (values >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    at, owner = sigma[spot[lead] & (PLACES - 1)], owner[lead]
    for a in range(0, len(at), step):
        own = owner[a : a + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        lower = np.minimum.reduceat(pi[at[a : a + step]], first, axis=0)
        np.minimum(least[own[first[0]]], lower[0], out=lower[0])  # a text may have begun in the step before
        least[own[first]] = lower
    some = np.flatnonzero(np.diff(offsets))
    place = (pi_back[least[some]] - np.arange(n, dtype=np.int32)) & np.int32(PLACES - 1)
    wanted = (some[:, None] << PLACE_BITS) | sigma_back[place]
    out[some] = values[lead[np.searchsorted(spot[lead], wanted.ravel())]].reshape(wanted.shape)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.shape[1] // ROWS
    cut = signature.reshape(len(signature), bands, ROWS)
    odd = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(ROWS)], np.uint64)
    return mixed((cut * odd).sum(2) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, n (set size), digest of the set, keys of the bands, for docs (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=SIGNED_BYTES):
            values, at = distinct_in_text(*shingles(text, WIDTH))
            keys = band_keys(signatures(values, at, bands=bands))
            view = memoryview(values).cast("B")
            digest = [hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": batch.column(0), "n": pa.array(np.diff(at)), "digest": pa.array(digest, pa.binary()),
                "keys": list_array(keys.ravel(), np.arange(len(keys) + 1) * bands, pa.int64()),
            })

    return docs.mapInArrow(sign, "doc_id long, n long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, shingles: sorted distinct hashes as bytes, for docs (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=SIGNED_BYTES):
            values, at = distinct_in_text(*shingles(text, WIDTH))
            yield pa.record_batch({"node": batch.column(0), "shingles": binary_rows(values, at)})

    return docs.mapInArrow(sets, "node long, shingles binary")


def near_enough(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least_percent: int = LEAST_PERCENT) -> np.ndarray:
    return 100 * both >= least_percent * (n_a + n_b - both)


def verified(pairs: DataFrame, sets: DataFrame, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are near enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum()) if len(x) else 0
                hit.append(100 * both >= least_percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(test, "a long, b long")


def block_links(part: pa.Table, least_percent: int = LEAST_PERCENT) -> pa.Table:
    """Links between the two sides of one block pair that join different components, as few as keep them joined."""
    node, comp = part.column("node").to_numpy(), part.column("comp").to_numpy()
    side, key = part.column("side").to_numpy(), part.column("key")[0].as_py()
    keys = np.stack(part.column("keys").to_numpy()) if part.num_rows else np.zeros((0, 0), np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    left, right = np.flatnonzero(side < 2), np.flatnonzero((side == 2) | (side == 0))
    out_a, out_b = [], []
    if len(left) and len(right):
        same = keys[left][:, None, :] == keys[right][None, :, :]
        first = keys[left][np.arange(len(left))[:, None], same.argmax(2)]
        open_ = same.any(2) & (first == key) & (comp[left][:, None] != comp[right][None, :])
        lo, hi = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        open_ &= 100 * lo >= least_percent * hi
        if open_.any():
            both = np.zeros(open_.shape, np.float32)
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), n)
            for a in range(0, len(values), 1 << 14):
                inside = (codes >= a) & (codes < a + (1 << 14))
                dense = np.zeros((len(sets), min(1 << 14, len(values) - a)), np.float32)
                dense[owner[inside], codes[inside] - a] = 1
                both += dense[left] @ dense[right].T
            link = open_ & near_enough(both.astype(np.int64), n[left][:, None], n[right][None, :], least_percent)
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    c = up
                return c

            for i, j in zip(*np.nonzero(link), strict=True):
                x, y = left[i], right[j]
                if (p := root(int(comp[x]))) != (q := root(int(comp[y]))):
                    joined[max(p, q)] = min(p, q)
                    out_a.append(node[x])
                    out_b.append(node[y])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def rest_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Step 4: links of the pairs that no pivot has settled. members: key, node, n, size of buckets of three or more."""
    inside = members.join(labels, "node", "left").select("key", "node", "n", "size", F.coalesce("comp", "node").alias("comp"))
    by_comp = inside.groupBy("key", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    bucket = by_comp.groupBy("key").agg(
        F.sum("count").alias("count"), F.sum("n").alias("n"), F.max(F.struct("count", "comp", "n")).alias("top")
    ).filter(F.col("top.count") < F.col("count"))  # several components
    salts = lambda count: F.ceil(F.col(count) / SALTED).cast("int")
    n_blocks = lambda count, n: F.ceil(F.greatest(count / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    bucket = bucket.select(
        "key", salts("count").alias("n_salts"), F.col("top.comp").alias("top"), n_blocks(F.col("top.count"), F.col("top.n")).alias("n_top"),
        n_blocks(F.col("count") - F.col("top.count"), F.col("n") - F.col("top.n")).alias("n_rest"),
    )
    # A row for each bucket that still holds several components; a large one's is repeated, and its nodes are dealt over the salts.
    salted = written(bucket, "near-open").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))).drop("n_salts")
    here = inside.withColumn("salt", F.pmod(F.xxhash64("node"), salts("size")).cast("int")).drop("n", "size").join(salted.hint("merge"), ["key", "salt"]).drop("salt")
    here = here.withColumn("is_top", F.col("comp") == F.col("top"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    here = here.withColumn("own", own)
    # Sides: 1 left, 2 right, 0 both (a block with itself). Blocks of the largest component only meet the others.
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meets = F.when(
        F.col("is_top"), F.transform(upto("n_rest"), lambda i: F.struct(i.alias("x"), F.col("own").alias("y"), F.lit(True).alias("t"), F.lit(2).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(upto("n_top"), lambda i: F.struct(F.col("own").alias("x"), i.alias("y"), F.lit(True).alias("t"), F.lit(1).alias("side"))),
            F.transform(
                upto("n_rest"),
                lambda i: F.struct(
                    F.least(i, "own").alias("x"), F.greatest(i, "own").alias("y"), F.lit(False).alias("t"),
                    F.when(i == F.col("own"), 0).when(F.col("own") < i, 1).otherwise(2).alias("side"),
                ),
            ),
        )
    )
    placed = here.select("key", "node", "comp", F.explode(meets).alias("m")).select("key", "node", "comp", "m.*")
    full = placed.join(classes.select("node", "keys"), "node").join(sets, "node")

    def links_of(part: pa.Table) -> pa.Table:
        return block_links(part, least_percent)

    return full.groupBy("key", "x", "y", "t").applyInArrow(links_of, "a long, b long")


def same_id_links(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the nodes of an id's several sets; None if every id has one row. rows: doc_id, n, digest."""
    full = rows.filter("n > 0 and doc_id is not null").select("doc_id", "digest")
    again = written(full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "near-repeated")
    if again.isEmpty():
        return None
    sets = full.join(again.hint("merge"), "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest")
    # The id itself is a node where it is the smallest of a class; it stands for all its classes.
    return sets.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Texts whose Jaccard is least_percent or more are linked.

    Null texts and texts without words have an empty set, are linked with nothing and are kept. Texts of fewer than five words
    have their whole sequence as their one shingle. Rows that repeat an id are one node, also with different texts, which so link what
    is near to either; all of them are kept with it, and n_shingles is each row's own. Rows
    without an id join no component, have a null component_id and are kept. An empty table gives no rows. Only the
    two columns are read. A shingle is known by a 64-bit hash.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(signed(docs, bands_for(least_percent)), "near-signed")
    classes = written(
        rows.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-classes"
    )
    joined_ids = same_id_links(rows, classes)
    dealt = classes.select("node", "n", F.explode("keys").alias("key"))
    rank = F.xxhash64("node", F.pmod(F.col("key"), F.lit(PIVOTS)))
    buckets = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(rank.alias("rank"), "node", "n")).alias("p")).filter("size > 1")
    members = written(
        dealt.join(buckets.select("key", "size", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "key"), "near-members"
    )
    close = 100 * F.least("n", "pivot_n") >= least_percent * F.greatest("n", "pivot_n")
    pairs = written(
        members.filter((F.col("node") != F.col("pivot")) & close).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "near-pairs"
    )
    nodes = written(members.select(F.col("node").alias("doc_id")).distinct(), "near-nodes")
    few = nodes.count() <= BROADCAST_NODES
    texts = docs.join(F.broadcast(nodes) if few else nodes.hint("merge"), "doc_id", "left_semi")
    sets = written(shingle_sets(texts), "near-sets")
    links = verified(pairs, sets, least_percent)
    links = written(links if joined_ids is None else links.unionByName(joined_ids), "near-links")
    labels = components(links)
    more = written(rest_links(members.filter("size > 2").select("key", "node", "n", "size"), labels, classes, sets, least_percent), "near-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # An id's component is that of any of its classes; its nodes are linked.
    of_class = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    # A hot class has many rows on the left only, which Spark splits.
    out = (
        rows.select("doc_id", "n", "digest")
        .join(of_class.hint("merge"), "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    )
    if joined_ids is not None:  # a row without words goes with the other rows of its id
        ids = rows.join(classes.select("digest", "node"), "digest").filter("doc_id is not null").join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "node")).alias("_comp"))
        out = out.join(ids.hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("_comp", "component_id")).drop("_comp")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = LEAST_PERCENT) -> DataFrame:
    """The rows of docs with the smallest id of their group, and rows without an id; all columns stay."""
    kept = near_groups(docs, id_col, text_col, least_percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
