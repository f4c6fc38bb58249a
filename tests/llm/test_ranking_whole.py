"""Quality by pairwise ranking learns from every labelled document and every pair of unlike labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifdrift.llm import ranking

ROWS = "doc_id long, quality int, x array<float>"


def rows_of(spark, x, y, parts=5):
    return spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], ROWS).repartition(parts)


def test_every_labelled_document_is_learned_from(spark):
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert ranking.training_rows(docs, labels).count() == 45_000
    few = labels.withColumn("quality", (F.col("doc_id") == 44_999).cast("int"))  # one document alone has label 1
    assert isinstance(ranking.fitted(docs, few), ranking.Model)
    assert ranking.fitted(docs, labels.withColumn("quality", F.lit(1))) == 1.0


def test_all_pairs_in_passes_are_all_pairs_listed(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((150, ranking.WIDTH), np.float32)
    x[:, 0], x[:, [1, 20, 143]] = np.log1p(50), rng.normal(size=(150, 3))
    y = (x[:, [1, 20, 143]] @ [2.0, -3.0, 0.5] + rng.normal(size=150) > 1).astype(int)
    mean, scale = np.zeros(ranking.WIDTH), np.ones(ranking.WIDTH)
    better, worse = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    got = ranking.ranked_in_passes(rows_of(spark, x, y), mean, scale)
    assert got == pytest.approx(ranking.ranked(ranking.standard(x.astype(float), mean, scale), better, worse), abs=2e-5)
    assert np.abs(got).max() > 1


@pytest.mark.parametrize("seed", range(3))
def test_threshold_of_range_partitions_is_that_of_an_array(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 60)
    y[:2] = 0, 1
    strength = np.round((y if seed < 2 else -3 * y) * 0.8 + rng.normal(size=60), 1)
    told = spark.createDataFrame([(float(a), int(b)) for a, b in zip(strength, y, strict=True)], "strength double, quality int").repartition(3)
    assert ranking.best_threshold(told, 4) == pytest.approx(np.quantile(strength, ranking.best_quantile(strength, y)))
