"""Dataset rows and features are made where their walks are: against brute force, and without exchanges of rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motifdrift import settings
from motifdrift.operators import dataset, features, ngrams, walks
from motifdrift.plans import fixtures as fx
from motifdrift.plans import queries as registered
from motifdrift.sources import tables
from tests.test_whole import brute_walk

WORDS = [a + b + c for a in "ABC" for b in "ABC" for c in "ABC"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([(i, w, float(i), i / 10) for i, w in enumerate(WORDS)], "idx int, words string, d1 double, d2 double")


@pytest.fixture
def made(spark):
    """Walks of three and two steps, of whole and of short texts."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ABC") for _ in range(n))
    return [(i, [text(rng.choice([40, 40, 23, 4])) for _ in range(2 + i % 2)]) for i in range(150)]


PLACES = [3, 4, 20, 21, 38, 21]


def sites(spark):
    return spark.createDataFrame(list(enumerate(PLACES)), "ordinal int, position int")


def brute(seqs, exact=False, known=WORDS):
    for o, p in enumerate(PLACES):
        cells = []
        for s in seqs:
            c = s[p - 2 : p + 3]
            cells.append([known.index(c[i : i + 3]) for i in range(len(c) - 2) if c[i : i + 3] in known])
        y = int(cells[-2] != cells[-1]) if exact else int(len(set(cells[-2]) & set(cells[-1])) != 3)
        yield o, y, cells[:-1]


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("cut", [False, True])
def test_f13_rows_of_a_walk_need_no_exchange(spark, vocab, made, exact, cut):
    df = spark.createDataFrame(made, "sample_id long, seqs array<string>")
    if cut:
        df = df.select("sample_id", F.transform("seqs", lambda s: ngrams.around_sites(s, PLACES)).alias("seqs"))
    built = dataset.build_rows(df, sites(spark), vocab, exact=exact, cut=cut)
    assert "Exchange" not in plan(built)
    assert sorted((r.sample_id, r.ordinal, r.y, r.x) for r in built.collect()) == sorted((i, *r) for i, seqs in made for r in brute(seqs, exact))


def test_f13_unknown_trigrams(spark, vocab, made):
    df = spark.createDataFrame(made, "sample_id long, seqs array<string>")
    fewer = vocab.filter("idx % 4 <> 1")
    known = [w if i % 4 != 1 else None for i, w in enumerate(WORDS)]
    got = dataset.build_rows(df, sites(spark), fewer, strict=False).collect()
    assert sorted((r.sample_id, r.ordinal, r.y, r.x) for r in got) == sorted((i, *r) for i, seqs in made for r in brute(seqs, known=known))
    with pytest.raises(Exception, match="trigram without a vector"):
        dataset.build_rows(df, sites(spark), fewer).collect()


def test_distinct_trigrams(spark):
    texts = ["ABCD", "CD", "", None, "É*BZ", "BCDA", "x\U0001f600yz"]
    got = [r.words for r in ngrams.distinct_trigrams(spark.createDataFrame([(t,) for t in texts], "sequence string").coalesce(1)).collect()]
    assert sorted(got) == sorted({t[i : i + 3] for t in texts if t for i in range(len(t) - 2)})


def coded(spark, vocab, made, take=("y", "x", "code")):
    df = spark.createDataFrame([m for m in made if len(m[1]) == 3], "sample_id long, seqs array<string>")
    return dataset.build_rows(df, sites(spark), vocab, take=take).withColumn("row_id", F.col("sample_id") * len(PLACES) + F.col("ordinal")).drop("sample_id", "ordinal")


def test_f15_labels_alone(spark, vocab, made):
    got = coded(spark, vocab, made, ("y",))
    assert got.columns == ["y", "row_id"]
    want = Counter(y for _, seqs in made if len(seqs) == 3 for _, y, _ in brute(seqs))
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == want


def test_f14_unique_ratio_by_codes(spark, vocab, made):
    rows = coded(spark, vocab, made)
    by_code = dataset.unique_ratio(rows.drop("x"))
    assert "md5" not in plan(by_code) and by_code.collect() == dataset.unique_ratio(rows.drop("code")).collect()


def test_f12_dedupe_by_codes(spark, vocab, made):
    rows = coded(spark, vocab, made)
    by_code = dataset.dedupe_dataset(rows.drop("x"), ["row_id"], ["row_id", "y"])
    assert "md5" not in plan(by_code)
    assert sorted(by_code.collect()) == sorted(dataset.dedupe_dataset(rows.drop("code"), ["row_id"], ["row_id", "y"]).collect())
    again = dataset.decoded(rows.select("row_id", F.col("x").alias("want"), "code"), 2, len(WORDS) - 1)
    assert all(r.x == r.want for r in again.collect())


def test_f11_shards_merge_by_codes(spark, vocab, made):
    rows = coded(spark, vocab, made)
    shards = lambda df: [df.filter("row_id % 2 = 1"), df.filter("row_id % 2 = 0")]
    by_code = dataset.merge_shards(shards(rows.drop("x")), keep=["shard", "row_id", "y"])
    assert "md5" not in plan(by_code)
    assert sorted(by_code.collect()) == sorted(dataset.merge_shards(shards(rows.drop("code"))).select("shard", "row_id", "y").collect())


def test_f9_shuffling_takes_no_sample(spark):
    got = dataset.shuffled(spark.range(5000).withColumnRenamed("id", "row_id"), "row_id", 17)
    assert "rangepartitioning" not in plan(got)
    key = lambda i: hashlib.md5(f"17|{i}".encode()).hexdigest()
    assert [(r.row_id, r.shuffle_key) for r in got.collect()] == sorted(((i, key(i)) for i in range(5000)), key=lambda r: r[1])


def test_f2_features_need_no_exchange(spark, vocab, made):
    rows = coded(spark, vocab, made)
    odd = spark.createDataFrame([(-1, 1, [[], [5, 5, 99], None, [7]]), (-2, 0, None), (-3, 0, [])], "row_id long, y int, x array<array<int>>")
    x_rows = rows.select("row_id", "y", "x").unionByName(odd)
    got = features.load_features(x_rows, vocab, ["d1", "d2"])
    assert "Exchange" not in plan(got)
    want = [(r.row_id, r.y, step, float(sum(ids)), round(sum(ids) / 10, 6)) for r in rows.collect() for step, ids in enumerate(r.x) if ids] + [(-1, 1, 1, 10.0, 1.0), (-1, 1, 3, 7.0, 0.7)]
    assert sorted((r.row_id, r.y, r.step, r.d1, round(r.d2, 6)) for r in got.collect()) == sorted(want)
    by_code = features.load_features(rows.drop("x"), vocab, ["d1", "d2"], steps=2)
    assert sorted(by_code.collect()) == sorted(features.load_features(rows, vocab, ["d1", "d2"]).collect())
    assert features.load_features(x_rows, vocab.filter("idx < 0"), ["d1", "d2"]).count() == 0


def test_f10_steps_are_transposed_without_an_exchange(spark, vocab, made):
    got = features.transpose_steps(features.load_features(coded(spark, vocab, made), vocab, ["d1", "d2"], steps=2), ["d1", "d2"])
    assert "Exchange" not in plan(got) and got.columns == ["step", "row_id", "vec"]


@pytest.mark.parametrize("n, steps", [(None, None), (None, 2), (1, None), (1, 2)])
def test_f1_flat_features_need_no_exchange(spark, vocab, made, n, steps):
    rows = coded(spark, vocab, made)
    got = features.flatten_features(rows, vocab, ["d1", "d2"], n, steps=steps)
    assert "Exchange" not in plan(got)
    want = {}
    for r in rows.collect():
        for step, ids in enumerate(r.x):
            if ids and (not n or step >= 2 - n):
                want.setdefault(r.row_id, []).extend([float(sum(ids)), round(sum(ids) / 10, 6)])
    assert {r.row_id: [round(v, 6) for v in r.features] for r in got.collect()} == want


def test_f5_a_dataset_is_written_in_one_pass_and_compressed(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, [[i, 2, 3], [], [i]]) for i in range(3000)], "y int, x array<array<int>>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tables.write_dataset(rows.mapInArrow(counted, rows.schema), f"{tmp_path}/d", steps=3)
    assert seen.value == 3000
    assert sorted((r.y, r.x) for r in tables.read_dataset(spark, f"{tmp_path}/d", 3).collect()) == sorted((r.y, r.x) for r in rows.collect())
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.csv*")) < 30_000
    with pytest.raises(Exception, match="a row has 3 steps, not 2"):
        tables.write_dataset(rows, f"{tmp_path}/e", steps=2)


def test_f5_lists_in_other_prints(spark):
    texts = ["[1,2,3]", "[1, 2, 3]", "[ 1 , 2]", "[]", None, "[1, null]", "[-4]", "no", "[12345678901]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(tables.parsed_list(F.col("t"))).collect() == df.select(F.from_json("t", "array<int>")).collect()


def test_fixed_walks_carry_what_is_around_sites(spark):
    rows = spark.createDataFrame([(i, 1 + i % 8, i // 8 % 3, "ABC" * 424 + "*") for i in range(48)], "record_idx long, period_idx int, cluster int, sequence string")
    got = fx.fixed_walks(rows).collect()
    assert got and {len(s) for r in got for s in r.seqs} == {sum(b - a for a, b in ngrams.windows(settings.site_positions()))}


@pytest.mark.parametrize("sent_bytes", [0, walks.SENT_BYTES])
def test_f16_walks_by_joins_and_with_sent_letters(spark, sent_bytes):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ACDEFGHIK") for _ in range(1270))
    base, periods, rows = [text() for _ in range(2)], (2, 3, 7, 9), []
    for i in range(90):
        own = base[rng.random() < 0.35]
        rows.append((i, periods[i % 4], rng.randrange(2), own[: rng.randrange(1270)] + "*"))
    links = {(p, c): sorted({rng.randrange(2), c}) if p < periods[-1] else [] for p in periods for c in range(2)}
    chosen = {}
    for _, p, c, s in rows:
        chosen.setdefault((p, c), []).append(s)
    members = spark.createDataFrame(rows, "record_idx long, period_idx int, cluster int, sequence string").repartition(3)
    table = spark.createDataFrame([(p, c, to) for (p, c), to in links.items()], "period_idx int, cluster int, next_cluster array<int>")
    samples = spark.createDataFrame([(i, periods[0]) for i in range(40)], "sample_id long, period_idx int")
    got = walks.sample_walks(samples, table, walks.walk_members(walks.numbered_members(members)), 3, registered.SEED, sent_bytes=sent_bytes)
    assert {r.sample_id: (r.turn, r.seqs) for r in got.collect()} == {i: brute_walk(i, periods[0], links, chosen, 3) for i in range(40)}
    with pytest.raises(RuntimeError, match="walks found no fitting"):
        walks.sample_walks(samples, table, walks.numbered_members(members), 3, registered.SEED, rounds=1, sent_bytes=sent_bytes)


def test_f16_vectors_need_no_exchange(spark, vocab):
    texts = ["ABCABC", "AB", "", None, "ZZZZ", "CCC"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_idx long, sequence string")
    got = ngrams.sequence_vectors(df, vocab, ["d1", "d2"])
    assert "Exchange" not in plan(got)
    want = {i: float(sum(WORDS.index(t[j : j + 3]) for j in range(len(t) - 2) if t[j : j + 3] in WORDS)) for i, t in enumerate(texts) if t is not None}
    assert {r.record_idx: r.d1 for r in got.collect()} == want


@pytest.fixture
def walked(spark):
    rows = [(i, 1 + i % 4, i // 4 % 2, "ABC" * (i % 5) + "ABCB" * 310 + "*") for i in range(48)]
    members = spark.createDataFrame(rows, "record_idx long, period_idx int, cluster int, sequence string")
    members = members.withColumn("sequence", F.rpad(F.expr("substring(sequence, 1, 1270)"), 1270, "A"))
    links = spark.createDataFrame([(p, c, [c, 1 - c] if p < 4 else []) for p in range(1, 5) for c in range(2)], "period_idx int, cluster int, next_cluster array<int>")
    return walks.numbered_members(members), links


def test_f6_datasets_exchange_codes(spark, walked, vocab):
    members, links = walked
    where = spark.createDataFrame(list(enumerate(settings.site_positions())), "ordinal int, position int")
    n = len(settings.site_positions())
    out = dataset.create_dataset(members, links, vocab, where, 8 * n, seed=5)
    below = plan(out).split("REPARTITION_BY_NUM")[1]
    assert "code" in below and "array<array" not in below
    got = out.collect()
    assert [r.row_id for r in got] == sorted(range(8 * n), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    free = dataset.create_dataset(members, links, vocab, where, 8 * n, seed=5, in_order=False)
    assert sorted(got) == sorted(free.collect()) and all(len(r.x) == 3 for r in got)


def test_f7_shards_make_labels_alone(spark, walked, vocab):
    members, links = walked
    where = spark.createDataFrame(list(enumerate(settings.site_positions())), "ordinal int, position int")
    ready = dataset.dataset_members(members, where)
    assert ready.filter("length(sequence) > 400").isEmpty()  # whole sequences don't travel
    shards = dataset.create_shards(lambda i: dataset.create_dataset(ready, links, vocab, where, 4 * len(settings.site_positions()), seed=i, take=("y",), in_order=False), 2)
    assert [s.columns for s in shards] == [["row_id", "y"]] * 2 and [s.count() for s in shards] == [4 * len(settings.site_positions())] * 2


def test_f8_refilling_by_codes(spark):
    def generate(n, turn, kind):
        rows = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), (F.col("id") % 10 + 10 * turn).cast("int").alias("v"))
        return rows.select("row_id", "y", F.array(F.array("v")).alias("x") if kind == "x" else F.unhex(F.lpad(F.hex("v"), 8, "0")).alias("code"))

    by = {kind: dataset.refill_dataset(lambda n, turn, kind=kind: generate(n, turn, kind), 40, 0.2) for kind in ("x", "code")}
    assert set(by["code"].columns) == {"turn", "row_id", "y", "code"}
    assert sorted(by["code"].select("turn", "row_id").collect()) == sorted(by["x"].select("turn", "row_id").collect())
