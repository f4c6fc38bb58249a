"""Many k-means fits in the same passes, against fits one by one in numpy."""

import numpy as np
import pytest

from motifdrift.operators import restarts


@pytest.fixture(scope="module")
def spots(spark):
    rng = np.random.default_rng(3)
    middle = {g: rng.normal(scale=6, size=(4, 5)) for g in (1, 2)}
    rows = [(g * 1000 + i, g, (middle[g][i % 4] + rng.normal(size=5)).tolist()) for g in (1, 2) for i in range(120)]
    return rows, spark.createDataFrame(rows, "vec_id long, period_idx int, features array<double>").repartition(5)


def one_by_one(x, start, most, tolerance):
    c = np.array(start, float)
    for turn in range(1, most + 1):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        still = np.sqrt(((new - c) ** 2).sum(1)).max() <= tolerance
        c = new
        if still:
            break
    return turn, c, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


@pytest.mark.parametrize("wave", [restarts.WAVE_NUMBERS, 60])
def test_fits_of_given_starts(spots, wave):
    rows, points = spots
    of = {g: np.array([f for _, h, f in rows if h == g]) for g in (1, 2)}
    starts = {(g, k, r): of[g][r * 9 : r * 9 + k].tolist() for g in (1, 2) for k in (1, 3, 4) for r in range(3)}
    got = {(r.period_idx, r.k, r.restart): r for r in restarts.restarted_fits(points, [*starts, (9, 2, 0)], "vec_id", max_iter=12, starts=starts, wave_numbers=wave).collect()}
    assert set(got) == set(starts)
    for f, start in starts.items():
        turns, centers, cost = one_by_one(of[f[0]], start, 12, restarts.TOLERANCE)
        assert got[f].iterations == turns and got[f].cost == pytest.approx(cost)
        assert np.allclose(got[f].centers, centers)
    best = {(r.period_idx, r.k): r for r in restarts.best_fits(restarts.restarted_fits(points, list(starts), "vec_id", max_iter=12, starts=starts)).collect()}
    assert all(best[g, k].cost == pytest.approx(min(got[g, k, r].cost for r in range(3))) for g in (1, 2) for k in (1, 3, 4))


def test_drawn_seeds_do_not_depend_on_partitions_and_find_the_spots(spots):
    rows, points = spots
    fits = [(g, 4, r) for g in (1, 2) for r in range(30)]
    found = [{(r.period_idx, r.restart): r.cost for r in restarts.restarted_fits(p, fits, "vec_id", max_iter=20).collect()} for p in (points, points.repartition(2))]
    assert found[0].keys() == found[1].keys() and all(found[0][f] == pytest.approx(found[1][f]) for f in found[0])
    for g in (1, 2):
        x = np.array([f for _, h, f in rows if h == g])
        true = sum(((x[i::4] - x[i::4].mean(0)) ** 2).sum() for i in range(4))
        assert min(c for (h, _), c in found[0].items() if h == g) <= true * 1.0001
        assert len({round(c, 3) for (h, _), c in found[0].items() if h == g}) > 1  # restarts differ


def test_seeds_are_drawn_in_proportion_to_squared_distance(spark):
    points = spark.createDataFrame([(i, 0, [float(v)]) for i, v in enumerate([0.0, 1.0, 3.0])], "vec_id long, period_idx int, features array<double>")
    fits = [(0, 2, r) for r in range(3000)]
    starts = {}
    pairs = {}
    for r in restarts.restarted_fits(points, fits, "vec_id", max_iter=0, starts=starts).collect():
        a, b = (c[0] for c in r.centers)
        pairs[a, b] = pairs.get((a, b), 0) + 1
    first = {v: sum(n for (a, _), n in pairs.items() if a == v) for v in (0.0, 1.0, 3.0)}
    assert all(abs(n - 1000) < 130 for n in first.values())
    assert pairs[0.0, 3.0] / first[0.0] == pytest.approx(0.9, abs=0.04)
    assert pairs[3.0, 0.0] / first[3.0] == pytest.approx(9 / 13, abs=0.06)


def test_few_points_ties_and_none(spark):
    kind = "vec_id long, period_idx int, features array<double>"
    same = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(6)], kind)
    got = restarts.restarted_fits(same, [(1, 3, 0)], "vec_id", max_iter=5).first()
    assert got.cost == 0 and len(got.centers) == 3
    assert restarts.restarted_fits(spark.createDataFrame([], kind), [(1, 3, 0)], "vec_id").count() == 0
