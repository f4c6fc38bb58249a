"""Orders of sorted results, first rows by digests, splits by walk, signs of components."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from motifdrift.operators import clean, cluster, dataset, link


def test_sort_by_date_is_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), dt.date(2021, 1, 1) + dt.timedelta(rng.randrange(9)) if i % 7 else None) for i in range(200)]
    rng.shuffle(rows)
    got = [tuple(r) for r in clean.sort_by_date(spark.createDataFrame(rows, "record_idx long, batch_no int, timestamp date").repartition(7)).collect()]
    assert got == sorted(rows, key=lambda r: (r[2] is None, r[2] or dt.date.min, r[1], r[0]))


def test_sort_centroids_is_in_natural_order(spark):
    rows = [(f"{y}-{m}", c, [float(m)]) for y in (2020, 2021) for m in (1, 2, 9, 10, 11) for c in (10, 2, 0)]
    random.Random(2).shuffle(rows)
    got = [(r.period, r.cluster) for r in link.sort_centroids(spark.createDataFrame(rows, "period string, cluster int, features array<double>").repartition(5)).collect()]
    assert got == [(f"{y}-{m}", c) for y in (2020, 2021) for m in (1, 2, 9, 10, 11) for c in (0, 2, 10)]


def test_shuffled_is_in_order_of_its_keys(spark):
    rows = spark.range(3000).withColumnRenamed("id", "row_id").repartition(6)
    got = dataset.shuffled(rows, "row_id", 5).collect()
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert [r.row_id for r in got] != sorted(r.row_id for r in got) and len({r.row_id for r in got}) == 3000
    assert [r.row_id for r in dataset.shuffled(rows.repartition(2), "row_id", 5).collect()] == [r.row_id for r in got]
    assert [r.row_id for r in dataset.shuffled(rows, "row_id", 6).collect()] != [r.row_id for r in got]


def test_first_rows_by_verified_digests(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.choice([[[1, 2]], [[1], [2]], [[12]], [], None, [[None]], [[1, 2], [3, 4]]]), rng.choice(["a", "b", None, "null", ""])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, x array<array<int>>, t string").repartition(5)
    for value in ("x", "t"):
        want = {}
        for r in rows:
            want.setdefault((r[1], repr(r[2 if value == "x" else 3])), r[0])
        for digest in (F.md5, lambda text: F.lit("00" * 16), lambda text: F.substring(F.md5(text), 1, 2)):  # none, all or many digests are equal by chance
            got = clean.first_of(df, ["g"], ["id"], (value,), digest=digest).collect()
            assert sorted(r.id for r in got) == sorted(want.values())
            assert all(tuple(r) == rows[r.id] for r in got)


def test_a_value_that_is_not_kept_does_not_travel(spark):
    made = [(i, [[i % 150] * 50], 1) for i in range(200)]
    rows = spark.createDataFrame(made, "row_id long, x array<array<int>>, y int")
    thin, whole = (dataset.dedupe_dataset(rows, ["row_id"], keep) for keep in (["row_id", "y"], None))
    assert thin.columns == ["row_id", "y"]
    assert sorted(r.row_id for r in thin.collect()) == sorted(r.row_id for r in whole.collect()) == list(range(150))
    rows_of = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "min_by" in line]  # noqa: E731  # what aggregates hand on
    assert any(", x, x#" in line for line in rows_of(whole)) and not any(", x, x#" in line for line in rows_of(thin))


def test_rows_of_a_walk_are_split_together(spark):
    rows = spark.range(40 * 317).withColumnRenamed("id", "row_id")
    parts = dataset.train_test_split(rows, "row_id", 3, 30, 317).groupBy(F.floor(F.col("row_id") / 317).alias("walk")).agg(F.countDistinct("is_test").alias("n"), F.first("is_test").alias("t")).collect()
    assert len(parts) == 40 and {r.n for r in parts} == {1} and 3 <= sum(r.t for r in parts) <= 22


def test_components_have_one_sign_and_their_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.5]
    for turned in (x, -x):
        points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(turned)], "vec_id long, features array<double>").repartition(3)
        got = np.array([(r.pc1, r.pc2) for r in cluster.pca_project(points).orderBy("vec_id").collect()])
        _, vectors = np.linalg.eigh(np.cov(turned.T))
        for i in (0, 1):
            v = vectors[:, -1 - i] * np.sign(vectors[np.abs(vectors[:, -1 - i]).argmax(), -1 - i])
            assert np.allclose(got[:, i], (turned - turned.mean(0)) @ v, atol=1e-8)


def test_count_distinct_periods(spark):
    assert clean.count_distinct_periods(spark.createDataFrame([("2020-1",), ("2020-10",), ("2020-1",)], "period string")) == 2
