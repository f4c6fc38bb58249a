"""Centroid clustering against a plain Lloyd's iteration in numpy, hard rows, and what the bounds save."""

import hashlib

import numpy as np
import pytest

from motifdrift.llm import centroids
from motifdrift.llm.centroids import cluster_report, clustered, displacements, rescanned, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, label int"


def plain(rows, k, rounds):
    """vec_id, cluster, distance and the centroids, evaluating everything; Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    now = [v for _, v in first]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now] for _, v in kept]
        own = [min(range(len(now)), key=lambda j: (d[j], j)) for d in far]
        if turn < rounds:
            for j in range(len(now)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
                if mine:
                    now[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, o, d[o]) for (i, _), o, d in zip(kept, own, far, strict=True)], now


def vectors(n, seed=1, spots=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(spots, 64))
    return [(i, (middle[i % spots] + 0.3 * rng.normal(size=64)).round(3).tolist()) for i in range(n)]


def made(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], SCHEMA).repartition(4)


def told(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=str)


def test_equals_evaluating_everything_and_saves_most_of_it(spark):
    rows = vectors(400)
    want, centres = plain(rows, 12, 5)
    found, history = clustered(whole_vectors(made(spark, rows)), 12, 5)
    assert told(found) == sorted(want, key=str)
    assert history[-1].tolist() == centres
    assert found.agg({"n_evaluated": "sum"}).first()[0] < 0.5 * 400 * 12 * 6


def test_report_sums_and_names(spark):
    rows = vectors(150, seed=4)
    want, centres = plain(rows, 40, 5)
    got = cluster_report(made(spark, rows)).collect()
    by = {}
    for _, c, d in want:
        by[c] = by.get(c, 0) + d
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (by[r["cluster"]], sum(by.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_hard_rows(spark):
    base = vectors(30, seed=2)
    v = base[0][1]
    odd = [(100, None), (101, []), (102, v[:63]), (103, [*v, 1.0]), (104, [None, *v[1:]]), (105, [float("nan"), *v[1:]]), (106, [float("inf"), *v[1:]])]
    kept = [(1, base[1][1]), (1, base[2][1]), (None, v), (None, v), (107, v), (108, [0.0] * 64), (109, [-0.001] * 64)]
    rows = base + odd + kept
    want, _ = plain(rows, 8, 3)
    assert told(clustered(whole_vectors(made(spark, rows)), 8, 3)[0]) == sorted(want, key=str)


def test_equal_vectors_share_the_first_centroid(spark):
    rows = [(i, [1.0] * 64) for i in range(20)] + [(50, [2.0] * 64)]
    want, _ = plain(rows, 5, 5)
    assert told(clustered(whole_vectors(made(spark, rows)), 5, 5)[0]) == sorted(want, key=str)


def test_far_components_are_exact_and_bounded(spark):
    rows = [(i, [(-1) ** i * 30_000.5 + i] * 64) for i in range(12)]
    want, _ = plain(rows, 3, 2)
    assert told(clustered(whole_vectors(made(spark, rows)), 3, 2)[0]) == sorted(want, key=str)
    huge = [r["v"] for r in whole_vectors(made(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)])).orderBy("vec_id").collect()]
    assert huge == [[centroids.MOST] * 64, [-centroids.MOST] * 64]
    assert cluster_report(made(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)])).count() == 2


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [1.0])]])
def test_without_vectors(spark, rows):
    assert cluster_report(made(spark, rows)).collect() == []


def test_displacement_is_the_norm_of_the_sum():
    history = np.array([[[0, 0]], [[3, 4]], [[0, 0]]])
    assert displacements(history)[:, 0] == pytest.approx([0, 5, 0], abs=1e-4)  # drifts of 5 and 5 cancel out


def test_bounds_that_hold_evaluate_nothing():
    v = np.array([[0, 0], [10, 0]])
    history = np.array([[[0, 0], [10, 0]], [[1, 0], [10, 0]]])
    cluster, far, seen = centroids.evaluated(v, history[:1])
    assert rescanned(v, history, cluster, far, seen).tolist() == [0, 0]
    assert cluster.tolist() == [0, 1]
    closer = np.array([[[0, 0], [10, 0]], [[0, 9], [4, 0]]])  # the first vector's own centroid leaves, the other comes near
    assert rescanned(v, closer, cluster, far, seen).tolist() == [2, 2]
    assert cluster.tolist() == [1, 1] and seen[0].tolist() == [1, 1]
