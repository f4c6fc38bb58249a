"""k-means with many restarts, numbers of clusters and groups at once.

A fit is a group of points, a k and a restart. All fits of a wave go through the same passes over the points: a pass measures each point against the
centres of all fits of its group by one matrix product, and tasks return sums, one row for each centre. Seeds are drawn like k-means++, for all fits in the same pass:
of exponential times with rate squared distance the first wins, which is a draw in proportion to it. Draws are hashes of seed, fit, step and the point's
key, so they don't depend on partitions. Fits that stand still leave the wave. A wave's centres have a bounded size, so any number of fits is a number of waves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.sources.scratch import written

#: Numbers in the centres of a wave, which go to all tasks and come back from them; cells of a product that a task holds at once.
WAVE_NUMBERS, CELLS = 2_000_000, 2_000_000
TOLERANCE = 1e-4
FOUND = "period_idx int, k int, restart int, iterations int, cost double, centers array<array<double>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers above 0 and up to 1 for keys x parts (arrays of one length, or whole numbers)."""
    salt = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            salt = mixed(salt * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p, np.int64).astype(np.uint64) + np.uint64(1))
        x = mixed(keys.astype(np.int64).astype(np.uint64)[:, None] ^ salt[None, :])
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


class Wave:
    """Fits (group, k, restart) with centres so far: fits x most k x width; a fit of fewer uses its first ones."""

    def __init__(self, fits: list[tuple[int, int, int]], centers: np.ndarray, filled: np.ndarray):
        self.fits, self.centers, self.filled = fits, centers, filled
        self.group = np.array([f[0] for f in fits])

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Fits of a group, its points, their keys, and points x fits x centres: squared distances, infinite where a centre isn't filled."""
        group, x = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, self.centers.shape[2])
        for g in np.unique(group):
            mine = np.flatnonzero(self.group == g)
            if not len(mine):
                continue
            c = self.centers[mine]
            off = np.arange(c.shape[1])[None, :] >= self.filled[mine][:, None]
            norm, rows = (c * c).sum(2), np.flatnonzero(group == g)
            size = max(1, CELLS // max(1, norm.size))
            for a in range(0, len(rows), size):
                at = rows[a : a + size]
                d = (x[at] ** 2).sum(1)[:, None, None] - 2 * (x[at] @ c.reshape(-1, c.shape[2]).T).reshape(len(at), *norm.shape) + norm[None]
                yield mine, x[at], batch.column(1).to_numpy()[at], np.where(off[None], np.inf, np.maximum(d, 0))


def next_seeds(points: DataFrame, wave: Wave, seed: int) -> None:
    """Draws one more centre for the fits that lack one: the first uniformly, others in proportion to the squared distance from the nearest so far."""
    sent = points.sparkSession.sparkContext.broadcast(wave)

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        salts = [np.array([f[i] for f in own.fits]) for i in (1, 2)]
        best: dict[int, tuple[float, int, list]] = {}
        for batch in batches:
            for mine, x, keys, d in own.parts(batch):
                weight = np.where(own.filled[mine][None, :] > 0, d.min(2), 1.0)
                weight = np.where(np.isfinite(weight), weight, 0.0)
                with np.errstate(divide="ignore"):
                    time = -np.log(uniform(keys, seed, salts[0][mine], salts[1][mine], own.filled[mine])) / weight
                order = np.lexsort((keys,))
                first = order[time[order].argmin(0)]
                for j, f in enumerate(mine.tolist()):
                    found = (float(time[first[j], j]), int(keys[first[j]]), x[first[j]].tolist())
                    best[f] = min(best.get(f, found), found)
        yield pa.record_batch({
            "fit": pa.array(list(best), pa.int32()), "time": pa.array([b[0] for b in best.values()], pa.float64()), "key": pa.array([b[1] for b in best.values()], pa.int64()),
            "x": pa.array([b[2] for b in best.values()], pa.list_(pa.float64())),
        })

    drawn = points.mapInArrow(race, "fit int, time double, key long, x array<double>").groupBy("fit").agg(F.min_by("x", F.struct("time", "key")).alias("x"))
    for r in drawn.collect():  # a row for each fit of the wave
        wave.centers[r.fit, wave.filled[r.fit]] = r.x
    wave.filled = np.minimum(wave.filled + 1, [f[1] for f in wave.fits])


def means(points: DataFrame, wave: Wave) -> tuple[np.ndarray, np.ndarray]:
    """The means of the points that are nearest to each centre (the first of equally near ones), and each fit's cost. Centres without points stay."""
    sent = points.sparkSession.sparkContext.broadcast(wave)
    n_fits, k, width = wave.centers.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n, total, cost = np.zeros((n_fits, k)), np.zeros((n_fits, k, width)), np.zeros(n_fits)
        for batch in batches:
            for mine, x, _, d in own.parts(batch):
                chosen = d.argmin(2)[:, :, None] == np.arange(k)
                n[mine] += chosen.sum(0)
                total[mine] += (chosen.reshape(len(x), -1).astype(np.float64).T @ x).reshape(len(mine), k, width)
                cost[mine] += d.min(2).sum(0)
        at = np.flatnonzero(n.sum(1) > 0)
        yield pa.record_batch({
            "fit": pa.array(at, pa.int32()), "n": pa.array(n[at].tolist(), pa.list_(pa.float64())), "total": pa.array(total[at].reshape(len(at), k * width).tolist(), pa.list_(pa.float64())), "cost": pa.array(cost[at]),
        })

    def merge(part: pa.Table) -> pa.Table:
        flat = lambda name: np.array(part.column(name).to_pylist()).sum(0)  # noqa: E731  # a row for each task
        return pa.table({"fit": part.column("fit").slice(0, 1), "n": pa.array([flat("n")]), "total": pa.array([flat("total")]), "cost": pa.array([float(flat("cost"))])})

    kind = "fit int, n array<double>, total array<double>, cost double"
    out, cost = wave.centers.copy(), np.zeros(n_fits)
    for r in points.mapInArrow(add, kind).groupBy("fit").applyInArrow(merge, kind).collect():  # a row for each fit of the wave
        n, total = np.array(r.n), np.array(r.total).reshape(k, width)
        some = n > 0
        out[r.fit][some] = total[some] / n[some][:, None]
        cost[r.fit] = r.cost
    return out, cost


def restarted_fits(
    points: DataFrame, fits: list[tuple[int, int, int]], key: str, seed: int = 1, max_iter: int = 500, tolerance: float = TOLERANCE,
    starts: dict[tuple[int, int, int], list[list[float]]] | None = None, group: str = "period_idx", wave_numbers: int = WAVE_NUMBERS,
) -> DataFrame:
    """FOUND of every fit (group, k, restart). points: group, key and features (array<double>, all of one width).

    starts: centres that fits begin with, instead of drawn ones. A fit ends when no centre moves by more than tolerance, or after max_iter rounds. Of a group of
    fewer than k different points, centres repeat. Groups without points have no fits.
    """
    spark = points.sparkSession
    stored = written(points.select(F.col(group).cast("int").alias("g"), F.xxhash64(key).alias("key"), F.col("features").cast("array<double>").alias("x")), "restart-points")
    width = (stored.select(F.size("x").alias("n")).first() or [0])[0]
    there = {r.g for r in stored.select("g").distinct().collect()}  # a row for each group
    fits, rows = [f for f in fits if f[0] in there], []
    per_wave = max(1, wave_numbers // max(1, max((f[1] for f in fits), default=1) * width))
    for a in range(0, len(fits), per_wave):
        part = fits[a : a + per_wave]
        wave = Wave(part, np.zeros((len(part), max(f[1] for f in part), width)), np.zeros(len(part), np.int64))
        for i, f in enumerate(part):
            if starts and f in starts:
                wave.centers[i, : f[1]], wave.filled[i] = starts[f], f[1]
        while (wave.filled < [f[1] for f in part]).any():
            left = np.flatnonzero(wave.filled < [f[1] for f in part])
            some = Wave([part[i] for i in left], wave.centers[left], wave.filled[left])
            next_seeds(stored, some, seed)
            wave.centers[left], wave.filled[left] = some.centers, some.filled
        rounds, active = np.zeros(len(part), np.int64), np.arange(len(part))
        for _ in range(max_iter):
            now = Wave([part[i] for i in active], wave.centers[active], wave.filled[active])
            new, _cost = means(stored, now)
            still = np.sqrt(((new - now.centers) ** 2).sum(2)).max(1) <= tolerance
            wave.centers[active] = new
            rounds[active] += 1
            active = active[~still]
            if not len(active):
                break
        _new, cost = means(stored, wave)
        rows += [(*f, int(rounds[i]), float(cost[i]), wave.centers[i, : f[1]].tolist()) for i, f in enumerate(part)]
    return spark.createDataFrame(rows, FOUND)


def best_fits(found: DataFrame) -> DataFrame:
    """Of each group and k the fit of least cost; of equal ones, the first restart."""
    best = F.min_by(F.struct("restart", "iterations", "cost", "centers"), F.struct("cost", "restart"))
    return found.groupBy("period_idx", "k").agg(best.alias("_b")).select("period_idx", "k", "_b.*")


def centroids_of(fits: DataFrame) -> DataFrame:
    """period_idx, cluster, features: a row for each centre of fits of one k for each group."""
    return fits.select("period_idx", F.posexplode("centers").alias("cluster", "features"))
