"""Centroid clustering by Lloyd's rounds in whole numbers, with ns-bounds (norms of sums).

Every vector keeps its distance to each centroid as of the round in which it was last evaluated, and all centroids of all rounds are
kept. A stored distance is loosened by how far the centroid is now from where it was in that round: the norm of the total displacement, which is
at most the sum of the drifts of the rounds between, and mostly far less. Only centroids whose loosened bound doesn't
rule them out are evaluated again, exactly. A round is one pass over the vectors and one of partial sums; nothing is shuffled but k rows of sums a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import deleted, new_path
from motifdrift.llm.words import list_array

K, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Components beyond this count as it, so that squared distances fit into a long: with SCALE 256 that is 524,288.
MOST = 1 << 27
#: Up to here products are exact in doubles.
EXACT = 1 << 21
#: Stored distances are floats; bounds give way by so much, so that rounding never rules a centroid out.
SLACK = 1e-6
#: Pairs of vector and centroid evaluated at once.
PAIRS = 1 << 14
STATE = "vec_id long, v array<int>, cluster int, far array<float>, seen array<tinyint>, n_evaluated int"


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers floor(scale * x)) of the rows with exactly dim components, none null, infinite or no number."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
            ids, lists = batch.column(0).filter(fit), batch.column(1).filter(fit)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is no number here
            good = np.isfinite(x).all(1)
            v = np.floor(scale * np.clip(x[good], -MOST, MOST)).clip(-MOST, MOST).astype(np.int32)
            yield pa.record_batch({"vec_id": ids.filter(pa.array(good)), "v": rows_of(v, pa.int32())})

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(whole, "vec_id long, v array<int>")


def rows_of(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return list_array(np.ascontiguousarray(x).ravel(), np.arange(len(x) + 1) * x.shape[1], kind)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of salt and vec_id, in that order; ties by components, null ids last. All vectors, if there are fewer."""
    rows = vectors.select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """vectors x centroids: exact squared distances."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([pair_squared(v, np.full(len(v), j), centroids) for j in range(len(centroids))], 1)


def pair_squared(v: np.ndarray, j: np.ndarray, centroids: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Exact squared distances of v[of[i]] (v[i] without of) and centroid j[i]."""
    out = np.empty(len(j), np.int64)
    for a in range(0, len(j), PAIRS):
        at = slice(a, a + PAIRS)
        d = (v[at] if of is None else v[of[at]]).astype(np.int64) - centroids[j[at]]
        out[at] = np.einsum("ij,ij->i", d, d)
    return out


def displacements(history: np.ndarray) -> np.ndarray:
    """rounds x k: how far each centroid is now from where it was in each round."""
    return np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)


def evaluated(v: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, far and seen of new vectors: every centroid is evaluated."""
    d = squared(v, history[-1])
    return d.argmin(1).astype(np.int32), np.sqrt(d.astype(np.float64)).astype(np.float32), np.full(d.shape, len(history) - 1, np.int8)


def rescanned(v: np.ndarray, history: np.ndarray, cluster: np.ndarray, far: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Brings cluster, far and seen up to the last centroids of history, in place. How many centroids were evaluated for each vector.

    Afterwards cluster is the nearest centroid; of equally near ones, the first.
    """
    now, moved, k = history[-1], displacements(history), history.shape[1]
    last, each, columns = len(history) - 1, np.arange(len(v)), np.arange(k)
    least = far * (1 - SLACK) - moved[seen, columns]
    upper = far[each, cluster] * (1 + SLACK) + moved[seen[each, cluster], cluster]
    least[each, cluster] = np.inf
    n = np.zeros(len(v), np.int64)
    at = np.flatnonzero((least <= upper[:, None]).any(1))
    own = pair_squared(v, cluster[at], now, at)
    far[at, cluster[at]], seen[at, cluster[at]] = np.sqrt(own.astype(np.float64)), last
    i, j = np.nonzero(least[at] <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK))[:, None])
    d = pair_squared(v, j, now, at[i])
    far[at[i], j], seen[at[i], j] = np.sqrt(d.astype(np.float64)), last
    near = np.full((len(at), k), np.iinfo(np.int64).max)
    near[i, j], near[np.arange(len(at)), cluster[at]] = d, own
    n[at] = 1 + np.bincount(i, minlength=len(at))
    cluster[at] = near.argmin(1)
    return n


def assigned(state: DataFrame, history: np.ndarray) -> DataFrame:
    """STATE after one more round. state: vec_id, v before the first, STATE from then on."""
    sent = state.sparkSession.sparkContext.broadcast(history)  # (rounds so far) x k x dim numbers

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k, dim = own.shape[1:]
        for batch in batches:
            v = matrix(batch.column(1), dim)
            if len(batch.schema) == 2:
                cluster, far, seen = evaluated(v, own)
                n = np.full(len(v), k)
            else:
                cluster, far, seen = batch.column(2).to_numpy().copy(), matrix(batch.column(3), k).copy(), matrix(batch.column(4), k).copy()
                n = batch.column(5).to_numpy() + rescanned(v, own, cluster, far, seen)
            yield pa.record_batch({
                "vec_id": batch.column(0), "v": batch.column(1), "cluster": pa.array(cluster, pa.int32()), "far": rows_of(far, pa.float32()),
                "seen": rows_of(seen, pa.int8()), "n_evaluated": pa.array(n, pa.int32()),
            })

    return state.mapInArrow(assign, STATE)


def with_distance(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared, exact), n_evaluated of STATE."""
    sent = state.sparkSession.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pair_squared(matrix(batch.column(1), sent.value.shape[1]), batch.column(2).to_numpy(), sent.value)
            yield pa.record_batch({"vec_id": batch.column(0), "cluster": batch.column(2), "distance": pa.array(d), "n_evaluated": batch.column(5)})

    return state.mapInArrow(measure, "vec_id long, cluster int, distance long, n_evaluated int")


def moved_centroids(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floor of each component's mean over a cluster; clusters without vectors stay. Tasks send one row of sums for each cluster."""
    k, dim = before.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            some, first = np.unique(cluster[order], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(matrix(batch.column(0), dim)[order].astype(np.int64), first, axis=0)
                n += np.bincount(cluster, minlength=k)
        at = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(at, pa.int32()), "n": pa.array(n[at]), "total": rows_of(total[at], pa.int64())})

    parts = state.select("v", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dim)])
    out = before.copy()
    for r in added.collect():  # k rows
        out[r["cluster"]] = np.array(r[2:], np.int64) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, n_evaluated), and the centroids of all rounds (rounds + 1 x k x dim). vectors: whole_vectors().

    Each round's state is a table in the shared folder, which goes once the next is there. Rows that repeat an id are vectors of their own, null
    ids stay and begin no cluster unless there are too few others. An empty table gives no rows, and no centroids.
    """
    spark = vectors.sparkSession
    history = first_centroids(vectors, k, salt)[None]
    if not history.shape[1]:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, n_evaluated int"), np.zeros((rounds + 1, 0, 0), np.int64)
    state, path = vectors, None
    for _ in range(rounds):
        new = new_path(spark, "centroid-state")
        assigned(state, history).write.parquet(new)
        if path:
            deleted(spark, path)
        path, state = new, spark.read.schema(STATE).parquet(new)
        history = np.concatenate([history, moved_centroids(state, history[-1])[None]])
    new = new_path(spark, "centroid-clusters")
    out = with_distance(assigned(state, history), history[-1])
    out.write.parquet(new)
    if path:
        deleted(spark, path)
    return spark.read.schema(out.schema).parquet(new), history


def cluster_report(df: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that whole_vectors() keeps."""
    found, history = clustered(whole_vectors(df), k, rounds)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    rows = [(c, s, sum(sums.values()), names[c]) for c, s in sums.items()]
    told = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
