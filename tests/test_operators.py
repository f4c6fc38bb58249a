"""Hand-made cases of the operators."""

import datetime as dt
import gzip
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from motifdrift import settings
from motifdrift.functions import columns as c
from motifdrift.operators import clean, cluster, dataset, features, link, metrics, ngrams, walks
from motifdrift.sources import fasta, snapshots, tables
from motifdrift.streaming import ingest


def one(spark, col, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(col.alias("v")).first().v


def test_site_table():
    p = settings.site_positions()
    assert (len(p), len(set(p)), max(p)) == (317, 243, 1228)
    assert (len(settings.PERIOD_CLUSTERS), sum(settings.PERIOD_CLUSTERS.values())) == (23, 164)


@pytest.mark.parametrize(
    ("text", "shifted", "floored"),
    [
        ("2021-03-00", dt.date(2021, 3, 1), dt.date(2021, 3, 1)), ("2021-03-31", None, dt.date(2021, 3, 31)), ("2020-02-28", dt.date(2020, 2, 29), dt.date(2020, 2, 28)),
        ("2020-02-29", None, dt.date(2020, 2, 29)), ("2021", None, None), ("2020-03", None, None), ("x", None, None), ("2021-0a-bc", None, None),
    ],
)
def test_day_policies(spark, text, shifted, floored):
    assert one(spark, c.parsed_date(c.shifted_day(F.col("t"))), t=text) == shifted
    assert one(spark, c.parsed_date(c.floored_day(F.col("t"))), t=text) == floored


def test_periods(spark):
    days = ["2020-02-29", "2020-01-31", "2020-12-01", "2021-06-30"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(*[f(F.col("d").cast("date")).alias(n) for n, f in c.PERIODS.items()]).collect()
    assert [tuple(r) for r in got] == [("2020", "2020-q1", None), ("2020", "2020-q1", "2020-1"), ("2020", "2020-q10", "2020-12"), ("2021", "2021-q4", "2021-6")]


def test_natural_order(spark):
    rows = spark.createDataFrame([("2020-10",), ("2020-2",), ("2021-1",), ("2020-q4",)], "period string")
    assert [r.period for r in tables.periods_in_order(rows).collect()] == ["2020-2", "2020-10", "2020-q4", "2021-1"]


def test_trigrams_of_short_and_long(spark):
    assert one(spark, c.trigrams(F.col("s")), s="AB") == []
    assert one(spark, c.trigrams(F.col("s")), s="ABCA") == ["ABC", "BCA"]
    assert one(spark, c.context(F.col("s"), F.lit(3)), s="ABCDEFG") == "BCDEF"


def test_site_differences_count_overlaps(spark):
    a = "A" * 10
    b = "A" * 4 + "CC" + "A" * 4
    assert one(spark, c.site_differences(F.col("a"), F.col("b"), [(1, 5), (5, 7), (9, 12)]), a=a, b=b) == 3
    assert one(spark, c.site_differences(F.col("a"), F.col("b"), [(9, 12)]), a=a, b=a + "X") == 1


def test_clean_order_hides_later_rows(spark):
    """The batch keeps an isolate's first row before dates are looked at, so a bad date hides a good one."""
    seq = "A" * 1259 + "*"
    rows = [(0, ">S|iso/1|2021-03-31|x", seq), (1, ">S|iso/1|2021-03-10|x", seq), (2, ">S|iso/2|2021-03-10|x|y", seq), (300, ">S|iso/1|2021-03-05|x", seq), (3, ">S|iso/3|2021-03-01|x", "B" + seq), (4, ">S|iso/4", seq)]
    out = clean.period_tables(spark.createDataFrame(rows, "record_idx long, description string, sequence string"), "month", 250)
    assert sorted((r.isolate_name, r.record_idx) for r in out.collect()) == [("iso/1", 300), ("iso/2", 2)]


def test_vectors_of_unknown_and_short(spark):
    vocab = spark.createDataFrame([(0, "ABC", 1.0), (1, "BCA", 0.5)], "idx int, words string, d1 double")
    rows = spark.createDataFrame([(1, "ABCABC"), (2, "XYZ"), (3, "AB")], "record_idx long, sequence string")
    assert {r.record_idx: r.d1 for r in ngrams.sequence_vectors(rows, vocab, ["d1"]).collect()} == {1: 2.5, 2: 0.0, 3: 0.0}


def test_unknown_trigram_is_an_error_if_strict(spark):
    vocab = spark.createDataFrame([(0, "ABC")], "idx int, words string")
    sites = spark.createDataFrame([(0, 2)], "ordinal int, position int")
    rows = spark.createDataFrame([(1, "ABCDE")], "k long, sequence string")
    assert ngrams.context_trigram_ids(rows, sites, vocab, ["k"], strict=False).count() == 1
    with pytest.raises(Exception, match="trigram without a vector"):
        ngrams.context_trigram_ids(rows, sites, vocab, ["k"]).collect()


def test_links_ties_gaps_and_one_period(spark):
    cents = spark.createDataFrame([(1, 0, [0.0]), (5, 0, [1.0]), (5, 1, [-1.0]), (7, 3, [1.0])], "period_idx int, cluster int, features array<double>")
    got = {(r.period_idx, r.cluster): r.next_cluster for r in link.link_clusters(cents).collect()}
    assert got == {(1, 0): [0, 1], (5, 0): [3], (5, 1): [3], (7, 3): []}
    assert [r.next_cluster for r in link.link_clusters(cents.filter("period_idx = 1")).collect()] == [[]]
    assert one(spark, c.joined_links(F.col("l")), l=[0, 2, 3]) == "0-2-3"
    assert one(spark, c.parsed_links(F.col("l")), l="") == []


def test_windows_shrink(spark):
    periods = spark.createDataFrame([(i, p) for i, p in enumerate("abcd")], "period_idx int, period string")
    assert [(r.x, r.y) for r in walks.period_windows(periods, 2).orderBy("window_id").collect()] == [(["a", "b"], "c"), (["b", "c"], "d")]
    assert [(r.x, r.y) for r in walks.period_windows(periods, 10).collect()] == [(["a", "b", "c"], "d")]
    windows = spark.range(13).select(F.col("id").cast("int").alias("window_id"))
    shares = {r.window_id: r.n_samples for r in walks.allocate_samples(windows, 634_000).collect()}
    assert shares == {i: 153 + 11 * (i == 12) for i in range(13)}
    assert walks.sample_table(windows, walks.allocate_samples(windows, 634_000)).count() == 2000


def test_walks_restart_or_fail(spark):
    a, b = "A" * 1273 + "*", "C" * 1273 + "*"
    rows = [(1, 1, 0, a), (2, 2, 0, a), (3, 2, 0, b), (4, 3, 0, b)]
    members = walks.numbered_members(spark.createDataFrame(rows, "record_idx long, period_idx int, cluster int, sequence string"))
    links = spark.createDataFrame([(1, 0, [0]), (2, 0, [0]), (3, 0, [])], "period_idx int, cluster int, next_cluster array<int>")
    samples = spark.createDataFrame([(i, 1) for i in range(6)], "sample_id long, period_idx int")
    got = walks.sample_walks(samples, links, members, 2, 5, rounds=3).collect()
    assert {tuple(r.seqs) for r in got} == {(a, a, b)}
    far = walks.numbered_members(spark.createDataFrame([(1, 1, 0, a), (3, 2, 0, b), (4, 3, 0, b)], "record_idx long, period_idx int, cluster int, sequence string"))
    with pytest.raises(RuntimeError, match="6 walks"):
        walks.sample_walks(samples, links, far, 2, 5, rounds=2)


def test_walks_do_not_depend_on_partitions(spark):
    rows = [(i, 1 + i % 3, 0, chr(65 + i % 4) * 1273 + "*") for i in range(30)]
    links = spark.createDataFrame([(1, 0, [0]), (2, 0, [0]), (3, 0, [])], "period_idx int, cluster int, next_cluster array<int>")
    samples = spark.createDataFrame([(i, 1) for i in range(9)], "sample_id long, period_idx int")
    made = []
    for n in (1, 7):
        members = walks.numbered_members(spark.createDataFrame(rows, "record_idx long, period_idx int, cluster int, sequence string").repartition(n))
        made.append(sorted((r.sample_id, r.turn, tuple(r.seqs)) for r in walks.sample_walks(samples.repartition(n), links, members, 2, 5, 4, strict=False).collect()))
    assert made[0] == made[1]


def test_labels_use_sets(spark):
    of = lambda x, y, **k: one(spark, dataset.label_mutation(F.col("x"), F.col("y"), **k), x=x, y=y)
    assert of([1, 2, 3], [3, 2, 1]) == 0
    assert of([1, 2, 3], [3, 2, 1], exact=True) == 1
    assert of([7, 7, 7], [7, 7, 7]) == 1
    assert of([7, 7, 7], [7, 7, 7], exact=True) == 0
    assert of([1, 2, 3], [1, 2, 4]) == 1


def test_refill_and_shards(spark):
    def generate(n, turn):
        return spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.array(F.array((F.col("id") % 10 + 10 * turn).cast("int"))).alias("x"))

    out = dataset.refill_dataset(generate, 40, 0.2)
    assert 32 <= out.count() == out.select("x").distinct().count()
    merged = dataset.merge_shards(dataset.create_shards(lambda i: generate(20, i // 2), 3))
    assert sorted((r.shard, r.row_id) for r in merged.collect()) == [(0, i) for i in range(10)] + [(2, i) for i in range(10)]


def test_metrics_with_empty_margins(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    assert tuple(metrics.evaluate(rows).first()) == (0.0, 0.0, 0.0, 0.0, pytest.approx(2 / 3))
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1), (2, 1)], "y int, p int")
    m = metrics.evaluate(rows).first()
    assert (m.precision, m.recall, m.accuracy) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(3 / 5))
    assert m.mcc == pytest.approx((2 * 1 - 1) / math.sqrt(3 * 3 * 2 * 2))


def test_auc_agrees_with_pairs(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.4), (0, 0.4)]
    curve = metrics.roc_curve(spark.createDataFrame(data, "y int, score double"))
    pairs = [(a > b) + 0.5 * (a == b) for y, a in data if y for z, b in data if not z]
    assert metrics.auc(curve).first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_scores_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 1), ([0.0, 0.0], 0)], "scores array<double>, y int")
    out = metrics.predict_from_scores(df).collect()
    assert [(r.prediction, r.probability) for r in out] == [(0, 1.0), (0, 0.5)]
    assert metrics.mean_cross_entropy(df).first().loss == pytest.approx((1000 + math.log(2)) / 2)


def test_first_positive_slice_without_any(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "row_id long, y int")
    assert features.first_positive_slice(df).count() == 0


def test_kmeans_against_assignment(spark):
    rows = [(i, 0, [float(i % 3) * 10 + (i % 5) * 0.1, 0.0]) for i in range(60)]
    points = spark.createDataFrame(rows, "vec_id long, period_idx int, features array<double>")
    costs = [cluster.kmeans_fit(points, k, seeds=(1, 2)).summary.trainingCost for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    model = cluster.kmeans_fit(points, 3)
    cents = spark.createDataFrame([(0, i, [float(x) for x in m]) for i, m in enumerate(model.clusterCenters())], "period_idx int, cluster int, features array<double>")
    near = cluster.assign_nearest(points, cents)
    labels = {r.vec_id: r.cluster for r in cluster.labelled(points, model).collect()}
    assert {r.vec_id: r.cluster for r in near.collect()} == labels
    assert cluster.inertia(near).first().inertia == pytest.approx(model.summary.trainingCost, abs=1e-6)
    ratios = [r.ratio for r in cluster.pca_explained_variance(points, 2).orderBy("component").collect()]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1 + 1e-9


def test_empty_cluster_keeps_its_centroid(spark):
    cents = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [99.0])], "period_idx int, cluster int, features array<double>")
    points = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [3.0])], "vec_id long, period_idx int, features array<double>")
    assert {r.cluster: r.features for r in cluster.kmeans_grouped(points, cents, 2).collect()} == {0: [2.0], 1: [99.0]}


def test_fasta_wrapped_blank_and_dangling(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one|x\nABC\nDEF\n\n>two|y\nGHI*\n")
    (tmp_path / "b.fasta").write_text(">three\r\nJK\r\n>dangling\n")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path)).orderBy("record_idx").collect()]
    assert got == [(0, ">one|x", "ABCDEF"), (1, ">two|y", "GHI*"), (2, ">three", "JK")]


def fasta_files(at):
    rng, want = random.Random(2), []
    for k in range(3):
        text = []
        for i in range(400):
            seq = "".join(rng.choice("ACDE") for _ in range(rng.choice([0, 1, 70, 300])))
            end = rng.choice(["\n", "\r\n"])
            text.append(f">r{k}-{i}|é{end}" + "".join(seq[j : j + 60] + end for j in range(0, len(seq), 60)) + rng.choice(["", "\n"]))
            if seq:
                want.append((len(want), f">r{k}-{i}|é", seq))
        (at / f"{k}.fasta").write_bytes("".join(text).encode())
    (at / "3.fasta").write_text("\n\n>nothing\n>last\nGG")
    return [*want, (len(want), ">last", "GG")]


def test_fasta_index_reads_slices_by_offset(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    want = fasta_files(src)
    found = []
    for block, records, most in ((1 << 27, 50, 1 << 20), (5_000, 37, 1 << 20), (3_000, 10_000, 900)):  # numbers don't depend on how files are split
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        at = str(tmp_path / f"index-{block}")
        fasta.index_fasta(spark, str(src), at, records, most)
        assert sorted(tuple(r) for r in fasta.read_fasta(spark, str(src)).collect()) == want
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for start, count in ((0, None), (0, 1), (333, 400), (len(want) - 1, 5), (len(want), 5)):
            got = sorted(tuple(r) for r in fasta.read_indexed(spark, at, start, count).collect())
            assert got == want[start : None if count is None else start + count]
        found.append(spark.read.parquet(at).agg({"n_records": "sum", "end_byte": "max"}).first().asDict())
    assert all(f == found[0] for f in found)


def test_a_slice_reads_only_its_bytes(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "index")
    src.mkdir()
    want = fasta_files(src)
    fasta.index_fasta(spark, str(src), at, 40)
    used = [r for r in spark.read.parquet(at).collect() if r.first_record < 460 and r.first_record + r.n_records > 440]
    assert len(used) <= 2
    for path in src.iterdir():  # what no entry of the slice covers is overwritten
        data = bytearray(path.read_bytes())
        mine = set(i for r in used if r.file.endswith(path.name) for i in range(r.first_byte, r.end_byte))
        path.write_bytes(bytes(b if i in mine else 35 for i, b in enumerate(data)))
    assert sorted(tuple(r) for r in fasta.read_indexed(spark, at, 440, 20).collect()) == want[440:460]


def test_a_compressed_file_is_not_indexed(spark, tmp_path):
    (tmp_path / "a.fasta.gz").write_bytes(gzip.compress(b">a\nCC\n>b\nDD\n"))
    with pytest.raises(ValueError, match="offsets"):
        fasta.index_fasta(spark, str(tmp_path / "a.fasta.gz"), str(tmp_path / "index"))


def test_fasta_order_over_many_splits(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("record_idx"), F.concat(F.lit(">r"), F.col("id")).alias("description"), F.repeat(F.lit("AC"), 30).alias("sequence"))
    fasta.write_fasta(rows.coalesce(1), str(tmp_path / "f"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fasta.read_fasta(spark, str(tmp_path / "f")).orderBy("record_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.description for r in got] == [f">r{i}" for i in range(5000)]


def test_stream_equals_batches_and_does_not_repeat(spark, tmp_path):
    seq = "A" * 1259 + "*"
    files = [[("iso/1", "2021-03-04"), ("iso/1", "2021-04-04"), ("iso/2", "2021-03-09")], [("iso/1", "2021-03-20"), ("iso/3", "2021-03-01")]]
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(files):
        (src / f"{i}.fasta").write_text("".join(f">S|{n}|{d}|x\n{seq}\n" for n, d in rows))
        ingest.ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.period, r.isolate_name, str(r.timestamp)) for r in ingest.stored(spark, str(tmp_path / "out")).collect())
    assert got == [("2021-3", "iso/1", "2021-03-05"), ("2021-3", "iso/2", "2021-03-10"), ("2021-3", "iso/3", "2021-03-02")]


@pytest.mark.parametrize("files", [1, 3, 1000])
def test_ingest_restarts_from_its_state_alone(spark, tmp_path, files):
    """Many files to a batch or few, and after a restart: the same rows, without what is stored being read."""
    rng = random.Random(6)
    src, root, seen, want = tmp_path / "in", tmp_path / "out", set(), []
    src.mkdir()
    seq = "A" * 1272 + "*"
    for i in range(8):
        rows = [(f"iso/{rng.randrange(6)}", rng.choice(["2021-02-01", "2021-03-04", "2021-03-31", "2021-05-10"])) for _ in range(rng.choice([3, 9, 40]))]
        rows += [("iso/hot", f"2021-0{1 + i % 4}-03")] * 300
        (src / f"{i}.fasta").write_text("".join(f">S|{n}|{d}|x\n{seq}\n" for n, d in rows))
        os.utime(src / f"{i}.fasta", (1_700_000_000 - i, 1_700_000_000 - i) if i < 4 else (1_700_000_000 + i, 1_700_000_000 + i))
    for i in (3, 2, 1, 0, 4, 5, 6, 7):  # in order of arrival
        first = {}
        for record in (src / f"{i}.fasta").read_text().split(">")[1:]:
            _, name, day, _ = record.split("\n")[0].split("|")
            first.setdefault(name, dt.date.fromisoformat(day[:8] + f"{int(day[8:]) + 1:02d}") if day != "2021-03-31" else None)
        for name, day in first.items():
            if day and (name, day.month) not in seen:
                seen.add((name, day.month))
                want.append((name, day, f"{i}.fasta"))
    later = [src / f"{i}.fasta" for i in range(4, 8)]
    for f in later:
        f.rename(tmp_path / f.name)
    run = lambda: ingest.ingest_stream(spark, str(src), str(root), str(tmp_path / "ck"), files=files)
    one = run()
    one.awaitTermination()
    found = [(r.isolate_name, r.timestamp, r.file.rsplit("/", 1)[1]) for r in ingest.stored(spark, str(root)).collect()]
    for path in root.rglob("*.parquet"):  # a batch that read what is stored would miss these
        path.write_bytes(b"")
    for f in later:
        (tmp_path / f.name).rename(f)
    two = run()
    two.awaitTermination()
    for path in root.rglob("*.parquet"):
        if path.stat().st_size:
            found += [(r.isolate_name, r.timestamp, r.file.rsplit("/", 1)[1]) for r in spark.read.parquet(str(path)).collect()]
    assert sorted(found) == sorted(want)
    assert two.lastProgress["stateOperators"][0]["customMetrics"].get("rocksdbCommitCheckpointLatency") is not None
    run().awaitTermination()  # nothing new
    assert not hasattr(spark, "_motifdrift_paths") or not any("ingest" in p for p in spark._motifdrift_paths)


def stored_rows(spark, root, version=None):
    return sorted(tuple(r) for r in snapshots.read_table(spark, root, "id long, x string, g string", version).collect())


@pytest.fixture
def lots(spark):
    return lambda *rows: spark.createDataFrame([(i, x, g) for i, x, g in rows], "id long, x string, g string")


def test_a_killed_overwrite_changes_nothing(spark, tmp_path, lots, monkeypatch):
    root = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="division|DIVIDE"):
        snapshots.write_table(lots((1, "a", "p")).withColumn("id", F.expr("id div 0")), root, "g")
    assert stored_rows(spark, root) == []  # a killed first write
    snapshots.write_table(lots((1, "a", "p"), (2, "b", "q")), root, "g")
    want = [(1, "a", "p"), (2, "b", "q")]
    torn = lots(*[(i, "new", "p") for i in range(40)]).repartition(8).withColumn("id", F.expr("if(id = 17, raise_error('killed'), id)").cast("long"))
    with pytest.raises(Exception, match="killed"):
        snapshots.write_table(torn, root, "g", "overwrite")
    assert stored_rows(spark, root) == want
    with monkeypatch.context() as m:  # the driver is lost between the files and the commit
        m.setattr(snapshots.Manifests, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            snapshots.write_table(lots((9, "lost", "p")), root, "g", "overwrite")
    assert stored_rows(spark, root) == want
    snapshots.write_table(lots((3, "c", "p")), root, "g", "overwrite")
    assert stored_rows(spark, root) == [(2, "b", "q"), (3, "c", "p")] and stored_rows(spark, root, 1) == want
    again = snapshots.read_table(spark, root, "id long, x string, g string").withColumn("x", F.upper("x"))
    snapshots.write_table(again, root, "g", "overwrite")  # from and to the same table
    assert stored_rows(spark, root) == [(2, "B", "q"), (3, "C", "p")]
    assert snapshots.clean_table(spark, root, age_s=3600) == 0
    assert snapshots.clean_table(spark, root, kept=1, age_s=0) >= 3
    assert stored_rows(spark, root) == [(2, "B", "q"), (3, "C", "p")]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1
    snapshots.write_table(lots((5, "e", "r")), root, "g", "replace")
    assert stored_rows(spark, root) == [(5, "e", "r")]
    snapshots.write_table(lots(), root, "g", "replace")
    assert stored_rows(spark, root) == []


def test_writers_that_meet_both_count(spark, tmp_path, lots, monkeypatch):
    root, real, met = f"file://{tmp_path}/t", snapshots.Manifests.commit, []

    def late(self, state, after):
        if not met:  # another writer commits first
            met.append(1)
            snapshots.write_table(lots((1, "other", "p"), (4, "d", "s")), root, "g")
        return real(self, state, after)

    monkeypatch.setattr(snapshots.Manifests, "commit", late)
    assert snapshots.write_table(lots((2, "mine", "p")), root, "g") == 2
    assert stored_rows(spark, root) == [(1, "other", "p"), (2, "mine", "p"), (4, "d", "s")]
    with pytest.raises(snapshots.Conflict):
        real(snapshots.Manifests(spark, root), {"parts": {}}, 1)
    assert stored_rows(spark, root) == [(1, "other", "p"), (2, "mine", "p"), (4, "d", "s")]


def test_stored_shards_and_plain_folders(spark, tmp_path):
    data = lambda y: spark.createDataFrame([(y, [[1, 2, 3], [4, 5, 6]])], "y int, x array<array<int>>")
    for shard, y in ((0, 1), (1, 2), (0, 3)):
        tables.write_dataset(data(y), str(tmp_path / "d"), shard)
    assert sorted(r.y for r in tables.read_dataset(spark, str(tmp_path / "d"), 2).collect()) == [2, 3]
    tables.write_dataset(data(7), str(tmp_path / "d"))
    assert [r.y for r in tables.read_dataset(spark, str(tmp_path / "d"), 2).collect()] == [7]
    rows = spark.createDataFrame([("a", dt.date(2021, 3, 4), "S", "2021-3")], tables.ISOLATES)
    rows.write.partitionBy("period").parquet(str(tmp_path / "plain"))
    assert [r.sequence for r in tables.read_periods(spark, str(tmp_path / "plain")).collect()] == ["S"]
    assert "PartitionFilters: [isnotnull(period" in tables.read_periods(spark, str(tmp_path / "plain")).filter("period = '2021-3'")._jdf.queryExecution().toString()


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.date(2021, 3, 4), "S", "2021-3"), ("b", dt.date(2021, 4, 4), "T", "2021-4")], tables.ISOLATES)
    tables.write_periods(rows, str(tmp_path / "p"))
    tables.write_periods(rows.filter("period = '2021-3'").withColumn("sequence", F.lit("U")), str(tmp_path / "p"), "overwrite")
    assert sorted((r.period, r.sequence) for r in tables.read_periods(spark, str(tmp_path / "p")).collect()) == [("2021-3", "U"), ("2021-4", "T")]
    (tmp_path / "v.csv").write_text("words,d1,d2\nABC,1.5,2\nBCD,0.25,-1\n")
    assert [tuple(r) for r in tables.read_trigram_vectors(spark, str(tmp_path / "v.csv"), 2).orderBy("idx").collect()] == [(0, "ABC", 1.5, 2.0), (1, "BCD", 0.25, -1.0)]
    cents = spark.createDataFrame([("2020-2", 0, [1], 0.5), ("2020-3", 0, [], 1.0)], "period string, cluster int, next_cluster array<int>, d1 double")
    tables.write_centroids(cents, str(tmp_path / "c"))
    assert sorted((r.period, r.next_cluster) for r in tables.read_centroids(spark, str(tmp_path / "c"), 1).collect()) == [("2020-2", [1]), ("2020-3", [])]
    data = spark.createDataFrame([(1, [[1, 2, 3], [4, 5, 6]])], "y int, x array<array<int>>")
    tables.write_dataset(data, str(tmp_path / "d"))
    assert [tuple(r) for r in tables.read_dataset(spark, str(tmp_path / "d"), 2).collect()] == [(1, [[1, 2, 3], [4, 5, 6]])]
    labels = spark.createDataFrame([("a", 7)], "isolate_name string, cluster int")
    assert [(r.isolate_name, r.cluster) for r in tables.with_cluster_labels(rows, labels, "isolate_name").collect()] == [("a", 7)]
    assert tables.site_ranges_table(spark).count() == 16 and tables.period_k_table(spark).count() == 23
