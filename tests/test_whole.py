"""Queries do the whole job - no letter and no member is left out - and what SQL twins tell is so on small fixtures too."""

import hashlib
import json
import random
import re

import pytest

from motifdrift import settings
from motifdrift.operators import dataset, ordered, walks
from motifdrift.plans import fixtures as fx
from motifdrift.plans import queries as registered
from motifdrift.plans.queries import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i, "".join(chr(97 + (i * j + j // 7) % 26) + (" " if j % 5 == 0 else "") for j in range(1273 * (1 + i % 4) + 5 * (i % 2))), "s") for i in range(40)] + [(40, "12 !", "s"), (41, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_pieces_hold_every_letter(spark, tables):
    at, rows = tables
    found = {}
    for r in sorted(fx.isolates(spark, at).collect()):
        found.setdefault(r.record_idx >> fx.PIECE_BITS, []).append(r.sequence.rstrip("*"))
    assert set(found) == {i for i, *_ in rows}
    for i, text, _ in rows:
        letters = re.sub("[^A-Z]", "", text.upper())
        assert "".join(found[i]).translate(str.maketrans("BJZX", "ALGS")) == letters.translate(str.maketrans("BJZX", "ALGS"))
        assert [len(x) for x in found[i][:-1]] == [fx.PIECE] * (len(found[i]) - 1)


def test_stream_reads_every_isolate(spark, tables):
    at, _ = tables
    got = {r.period: (r.n, r.n_isolates) for r in queries()["ingest_stream"](spark, at).collect()}
    want = {r.period: r.n for r in queries()["clean_pipeline"](spark, at).collect()}
    assert got == {p: (n, n) for p, n in want.items()} and sum(want.values()) > 3


@pytest.fixture
def members(spark, monkeypatch):
    letters = "".join(chr(97 + (j * 7 + j // 11) % 26) for j in range(1273)).upper() + "*"
    rows = [(i, f"p{1 + i % 8}", 1 + i % 8, i // 8 % 3, letters[: i % 5] + "A" + letters[i % 5 + 1 :]) for i in range(48)]
    made = spark.createDataFrame(rows, "record_idx long, period string, period_idx int, cluster int, sequence string")
    monkeypatch.setattr(fx, "members", lambda spark, d: made)
    return made


def test_a_walk_starts_from_every_member(spark, members):
    n_sites = len(settings.site_positions())
    made = registered._rows(spark, "").select("row_id").distinct().collect()
    assert {r.row_id // n_sites for r in made} == set(range(48))
    assert len(made) == 48 * n_sites
    assert registered._features(spark, "").select("row_id").distinct().count() == len(made)
    walked = queries()["sample_walks"](spark, "").collect()
    assert sorted(r.sample_id for r in walked) == list(range(48))


def test_datasets_are_whole_and_refilled(spark, members, tables):
    at, rows = tables
    n_sites = len(settings.site_positions())
    made = queries()["create_dataset"](spark, at).collect()
    assert len({r.row_id for r in made}) == len(made) == n_sites * len(rows)
    assert all(len(json.loads(r.x)) == 7 for r in made)  # eight periods: seven steps and the label's
    first, second = (registered._generator(spark, at)(n_sites * 5, turn) for turn in (0, 1))
    assert first.count() == second.count() == 5 * n_sites
    turns = dataset.refill_dataset(lambda n, turn: registered._generator(spark, at)(n, turn), 5 * n_sites, 0.2, 3)
    assert turns.select("x").distinct().count() == turns.count()
    assert {r.turn for r in turns.select("turn").distinct().collect()} <= {0, 1, 2}


def brute_walk(sample, first, links, chosen, size):
    """A walk as the draws tell it, step by step."""
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, (registered.SEED, sample, *parts))).encode()).hexdigest()[:8], 16)
    for turn in range(settings.MOST_ROUNDS):
        clusters = sorted({c for p, c in chosen if p == first})
        at = (first, clusters[draw(turn, 0, 0, "cluster") % len(clusters)])
        seqs = [chosen[at][draw(turn, 0, 0, "member") % len(chosen[at])]]
        for step in range(1, size + 1):
            to = links[at]
            at = (min(p for p, _ in links if p > at[0]), to[draw(turn, step, 0, "link") % len(to)])
            for attempt in range(settings.ATTEMPTS if step < size else 1):
                seq = chosen[at][draw(turn, step, attempt, "member") % len(chosen[at])]
                far = sum(seqs[-1][p : p + 1] != seq[p : p + 1] for p in settings.site_positions())
                if step == size or far <= int(len(settings.site_positions()) * settings.DIFFERENCE_SHARE):
                    seqs.append(seq)
                    break
            else:
                break
        else:
            return turn, seqs
    raise AssertionError("no walk")


@pytest.mark.parametrize("periods, wave_rows", [((1, 2, 3, 4), walks.WAVE_ROWS), ((1, 3, 4, 8), walks.WAVE_ROWS), ((2, 3, 7, 9), 1)])
def test_walks_against_brute_force(spark, periods, wave_rows):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ACDEFGHIK") for _ in range(1270))
    base, rows = [text() for _ in range(2)], []
    for i in range(90):
        own = base[rng.random() < 0.35]
        rows.append((i, periods[i % 4], rng.randrange(2), own[: rng.randrange(1270)] + "*"))
    links = {(p, c): sorted({rng.randrange(2), c}) if p < periods[-1] else [] for p in periods for c in range(2)}
    chosen = {}
    for i, p, c, s in rows:
        chosen.setdefault((p, c), []).append(s)
    members = spark.createDataFrame(rows, "record_idx long, period_idx int, cluster int, sequence string").repartition(3)
    table = spark.createDataFrame([(p, c, to) for (p, c), to in links.items()], "period_idx int, cluster int, next_cluster array<int>")
    samples = spark.createDataFrame([(i, periods[0]) for i in range(40)], "sample_id long, period_idx int")
    got = {r.sample_id: (r.turn, r.seqs) for r in walks.sample_walks(samples, table, walks.numbered_members(members), 3, registered.SEED, wave_rows=wave_rows).collect()}
    assert got == {i: brute_walk(i, periods[0], links, chosen, 3) for i in range(40)}
    assert any(turn for turn, _ in got.values())


@pytest.mark.parametrize("ranges", [None, 1, 13])
def test_orders_over_ranges(spark, ranges):
    rng = random.Random(1)
    data = [(i * 3, i % 2, rng.choice([0.1, 0.5, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(data, "k long, g int, v double").repartition(4)
    got = ordered.numbered(df, ["g"], "k", "no", "total", ranges).collect()
    for g in (0, 1):
        mine = sorted(r.k for r in got if r.g == g)
        assert all((r.no, r.total) == (mine.index(r.k), 100) for r in got if r.g == g)
    sums = ordered.falling_totals(df.withColumn("one", df.g * 0 + 1), "k", ["one", "v"], ranges).collect()
    assert {r.k: r.one_upto for r in sums} == {3 * i: 200 - i for i in range(200)} and {r.one_all for r in sums} == {200}
    assert {r.k: round(r.v_upto, 9) for r in sums} == {k: round(sum(v for k2, _, v in data if k2 >= k), 9) for k, _, _ in data}
    order = sorted((v, k) for k, _, v in data)
    before = {r.k: (r.before and (r.before.v, r.before.k)) for r in ordered.with_previous(df, "v", ["v", "k"], ranges).collect()}
    assert before == {k: (order[j - 1] if j else None) for j, (_, k) in enumerate(order)}


@pytest.mark.parametrize("ranges", [None, 5])
def test_orders_with_nulls_ties_and_a_hot_key(spark, ranges):
    data = [(None if i % 4 == 0 else 7 if i % 3 else i, None if i % 5 == 0 else "a" if i % 2 else "b", i) for i in range(300)]
    df = spark.createDataFrame(data, "k long, g string, id long").repartition(6)
    got = ordered.numbered(df, ["g"], "k", "no", "total", ranges).collect()
    assert sorted(r.id for r in got) == list(range(300))
    for g in (None, "a", "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.no)
        assert [r.no for r in mine] == list(range(len(mine))) and {r.total for r in mine} == {len(mine)}
        assert [r.k for r in mine] == sorted((r.k for r in mine), key=lambda k: -1 if k is None else k)
    again = ordered.numbered(df.repartition(3), ["g"], "k", "no", "total", ranges).collect()
    assert {r.id: r.no for r in again} == {r.id: r.no for r in got}  # ties have the same order whatever the partitions
    keys = df.filter("k is not null and k <> 7").dropDuplicates(["k"]).unionByName(spark.createDataFrame([(None, "a", 1)], df.schema))
    sums = {r.k: r.one_upto for r in ordered.falling_totals(keys.withColumn("one", keys.id * 0 + 1), "k", ["one"], ranges).collect()}
    assert sums[None] == len(sums) and sorted(sums.values()) == list(range(1, len(sums) + 1))
    none = df.filter("id < 0")
    assert ordered.numbered(none, ["g"], "k", "no", "total", ranges).count() == ordered.with_previous(none, "k", ["id"], ranges).count() == 0
    assert ordered.falling_totals(none, "k", ["id"], ranges).count() == 0
