import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from motifdrift.llm import exact_dedup, sharding


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_against_brute_force(hard, hard_rows):
    groups = defaultdict(list)
    for i, t, *_ in hard_rows:
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    for fan_in in (2, 8):
        got = Counter(tuple(r) for r in exact_dedup.exact_groups(hard, fan_in=fan_in).collect())
        assert got == want


def test_exact_tree_has_bounded_merges(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(40)
    rows = exact_dedup.written(exact_dedup.digests(docs), "t")
    runs = rows.groupBy("run", *exact_dedup.KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_merge = runs.groupBy((F.col("run") - F.col("run") % 8).alias("r"), "digest").count().agg(F.max("count")).first()[0]
    assert per_merge <= 8
    root = exact_dedup.merged_runs(rows)
    assert root.agg(F.sum("group_size")).first()[0] == 5000
    assert root.filter("group_size > 1").select("keep_id", "group_size").collect() == [(0, 1667)]


def test_a_round_merges_by_its_order(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(700))).alias("text")).repartition(20)
    rows = exact_dedup.written(exact_dedup.digests(docs), "t")
    runs = exact_dedup.written(exact_dedup.first_runs(rows), "runs")
    made = exact_dedup.merge_round(runs, 8, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort [run" in plan and "Window [" in plan and "Aggregate" not in plan
    stored = exact_dedup.written(made, "run")
    for part in stored.withColumn("file", F.input_file_name()).toPandas().groupby("file"):
        order = [(r.run, bytes(r.digest)) for r in part[1].itertuples()]
        assert order == sorted(set(order))  # sorted runs, each digest once
    ids = runs.groupBy((F.col("run") - F.col("run") % 8).alias("run"), "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    assert sorted(map(tuple, stored.select("run", "digest", "keep_id", "group_size").collect())) == sorted(map(tuple, ids.collect()))


def test_exact_empty_and_filter(empty, hard):
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.deduplicated(hard)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.filter("doc_id in (4, 6, 7)").collect()} == {4, 7}


def test_each_text_of_an_id_is_judged_by_itself(spark):
    rows = [(3, "B", 1), (5, "A", 2), (5, "B", 3), (None, "B", 4), (None, "C", 5), (2, None, 6), (7, "", 7), (5, "A", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(3)
    assert sorted(tuple(r) for r in exact_dedup.deduplicated(docs).select("keep_id").collect()) == [(1,), (2,), (5,), (6,), (8,)]


def test_inputs_of_one_partition_are_merged_too(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(90))).alias("text")).coalesce(1)
    rounds, real = [], exact_dedup.merge_round
    monkeypatch.setattr(exact_dedup, "merge_round", lambda runs, span, n: rounds.append(runs.select("run").distinct().count()) or real(runs, span, n))
    assert all(r.keep_id == r.doc_id % 90 for r in exact_dedup.exact_groups(docs).collect())
    assert rounds == [16, 2]


def check_shards(rows, n_shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(n_shards)) <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding_of_hard_rows(hard, hard_rows):
    rows = sharding.sharded_documents(hard).collect()
    check_shards(rows, 8)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in hard_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_sharding_in_buckets_and_repeats(spark, empty):
    df = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.lit("x").alias("shard_name")).repartition(7)
    check_shards(sharding.uniform_shards(df, 5, bucket_rows=40).collect(), 5)
    assert sharding.sharded_documents(empty).count() == 0
    again = sharding.uniform_shards(df, 5, bucket_rows=40)
    assert again.columns == ["doc_id", "shard_name", "shard", "slot"]


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.hypergeometric(rng, 30, 100, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15
    assert abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    huge = sharding.hypergeometric(rng, 10**12, 8 * 10**12, 10**6)
    assert abs(huge - 125_000) < 3000
    counts, sizes = [5, 0, 17, 30], [13, 13, 13, 13]
    m = sharding.communication_matrix(counts, sizes, 4)
    assert [sum(r) for r in m] == counts
    assert [sum(c) for c in zip(*m, strict=True)] == sizes


def test_shuffle_is_uniform(spark):
    """Each of a few rows is in each shard about equally often over seeds."""
    rows = sharding.written(spark.range(16).toDF("doc_id").repartition(3), "u")
    seen = Counter()
    for seed in range(40):
        seen.update((r.doc_id, r.shard) for r in sharding.uniform_shards(rows, 2, seed).collect())
    assert all(6 <= seen[(i, 0)] <= 34 for i in range(16))


def test_draws_have_the_hypergeometric_law():
    from math import comb

    rng = np.random.default_rng(3)
    for good, total, drawn in ((3, 7, 4), (10, 12, 5), (40, 100, 30)):
        seen = Counter(sharding.hypergeometric(rng, good, total, drawn) for _ in range(20_000))
        for k in range(drawn + 1):
            p = comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn)
            assert abs(seen[k] / 20_000 - p) < 0.015, (good, total, drawn, k)


def test_matrices_have_the_law_of_all_permutations():
    """How often each matrix comes, against counting it over every order of six rows."""
    from itertools import permutations

    counts, sizes = [3, 1, 2], [2, 2, 2]
    owner = [p for p, n in enumerate(counts) for _ in range(n)]
    shard = [s for s, n in enumerate(sizes) for _ in range(n)]
    matrix = lambda order: tuple(tuple(sum(owner[r] == p and shard[i] == s for i, r in enumerate(order)) for s in range(3)) for p in range(3))
    want = Counter(matrix(order) for order in permutations(range(6)))
    drawn = Counter(tuple(map(tuple, sharding.communication_matrix(counts, sizes, seed))) for seed in range(6000))
    assert set(drawn) == set(want)
    for m, n in want.items():
        assert abs(drawn[m] / 6000 - n / 720) < 0.03
