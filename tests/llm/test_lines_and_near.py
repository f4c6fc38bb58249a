import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from motifdrift.llm import line_dedup, near_dedup
from motifdrift.llm.components import components
from motifdrift.sources.snapshots import Conflict

SPACE = " \t\n\x0b\x0c\r"
UP = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(SPACE).translate(UP)


def test_lines_against_brute_force(hard, hard_rows):
    holders = defaultdict(list)
    for n, (i, t, *_) in enumerate(hard_rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append((n, i))
    last = {k: max((i for _, i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= 3}
    want = []
    for i, t, *_ in hard_rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in last or last[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    got = [tuple(r) for r in line_dedup.line_report(hard).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 3


def test_lines_keep_columns_and_empty_tables(hard, empty):
    out = line_dedup.with_kept_lines(hard)
    assert out.schema.names == hard.schema.names
    assert out.count() == hard.count()
    assert {r.n_chars for r in out.filter("doc_id = 15").collect()} <= {0, 51}
    assert line_dedup.line_report(empty).count() == 0
    assert line_dedup.with_kept_lines(empty).count() == 0


def test_prefilter_only_leaves_out_what_no_filter_has(hard):
    lines = line_dedup.written(line_dedup.keyed_lines(hard), "l")
    repeated = line_dedup.counted(lines).filter("refs >= 3")
    with_shard = repeated.withColumn("shard", line_dedup.shard_of("key", 4))
    some = line_dedup.prefiltered(lines, with_shard, 4)
    whole = line_dedup.prefiltered(lines, with_shard, 4, most_bytes=-1)
    assert whole.count() == some.count() < lines.count()  # filters that aren't sent meet the lines by shard
    assert some.join(repeated, "key").count() == lines.join(repeated, "key").count()


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    f = line_dedup.CuckooFilter.of(keys[:40_000])
    assert f.maybe(keys[:40_000]).all()
    assert f.maybe(keys[40_000:]).mean() < 0.01
    f.delete(keys[:200])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.maybe(keys[200:40_000]).all()
    assert f.maybe(keys[:200]).mean() < 0.05
    assert not line_dedup.CuckooFilter.of(keys[:0]).maybe(keys).any()


def test_digests_of_columns_and_slices(monkeypatch):
    made = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    want = line_dedup.halves(made)
    column = pa.array([b"x" * 16, *made], pa.binary())
    assert (line_dedup.halves(column[1:]) == want).all()
    assert (line_dedup.halves(pa.chunked_array([column[1:500], column[:0], column[500:]])) == want).all()
    assert (line_dedup.halves(column[1:].cast(pa.large_binary())) == want).all()
    assert line_dedup.halves(column[:0]).shape == line_dedup.halves(pa.chunked_array([], pa.binary())).shape == (0, 2)
    monkeypatch.setattr(line_dedup, "SLICE_KEYS", 64)
    f = line_dedup.CuckooFilter.of(want)
    assert f.maybe(want).all() and (f.table > 0).sum() == len(want)
    f.delete(want)
    assert not f.table.any()
    assert not line_dedup.CuckooFilter(4).insert(want)


def test_index_is_reversible(spark):
    line = lambda i: f"a line of some length, number {i:04d}"
    docs = [(d, "\n".join(line((d * j) % 17) for j in range(1, 6))) for d in range(1, 41)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda index: {bytes(r.key): (r.refs, r.last) for r in index.counts().collect()}
    both = line_dedup.LineIndex(spark, n_shards=3).insert(frame(docs[:25])).insert(frame(docs[25:]))
    once = line_dedup.LineIndex(spark, n_shards=3).insert(frame(docs))
    assert table(both) == table(once)
    first = table(line_dedup.LineIndex(spark, n_shards=3).insert(frame(docs[:25])))
    both.delete(spark.createDataFrame([(d,) for d, _ in docs[25:]], "doc_id long"))
    assert table(both) == first
    again = both.insert(frame(docs[25:]))
    assert table(again) == table(once)


def index_rows(index):
    table = {bytes(r.key): (r.refs, r.last) for r in index.counts().collect()}
    assert (index._read("filters").agg({"n_keys": "sum"}).first()[0] or 0) == len(table)
    return table


def recounted(docs):
    return {bytes(r.key): (r.refs, r.last) for r in line_dedup.counted(line_dedup.keyed_lines(docs)).collect()}


def test_an_index_outlives_its_driver(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    line = lambda i: f"a line of some length, number {i:04d}"
    rows = [(d, "\n".join(line((d * j) % 17) for j in range(1, 6))) for d in range(1, 31)] + [(5, line(90)), (5, line(90)), (None, line(91)), (None, None), (40, ""), (41, line(0))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    opened = lambda: line_dedup.LineIndex(spark, path, n_shards=3)
    assert opened().insert(frame([])).counts().count() == 0
    opened().insert(frame(rows[:12]))
    assert index_rows(opened()) == recounted(frame(rows[:12]))
    opened().insert(frame(rows[12:]))  # into what another object has made
    assert index_rows(opened()) == recounted(frame(rows))
    for stop in ("_write", "_commit"):  # killed in the middle of a change, or right before it counts
        index, real, calls = opened(), getattr(line_dedup.LineIndex, stop), []

        def killed(self, *args, real=real, calls=calls, **kw):
            calls.append(1)
            if len(calls) == 2 or real.__name__ == "_commit":
                raise KeyboardInterrupt
            return real(self, *args, **kw)

        with monkeypatch.context() as m:
            m.setattr(line_dedup.LineIndex, stop, killed)
            for change in (lambda: index.insert(frame([(99, line(3))])), lambda: index.delete(frame([(1, "")]))):
                calls.clear()
                with pytest.raises(KeyboardInterrupt):
                    change()
        assert index_rows(index) == index_rows(opened()) == recounted(frame(rows))
    first, second = opened(), opened()
    first.delete(frame([(d, "") for d in (2, 5, 5, 7, 123)]))
    with pytest.raises(Conflict):
        second.insert(frame([(50, line(1))]))
    left = [r for r in rows if r[0] not in (2, 5, 7)]
    assert index_rows(second) == index_rows(opened()) == recounted(frame(left))
    assert opened().clean(kept=1, age_s=0) > 0
    assert index_rows(opened()) == recounted(frame(left))
    # What the index says is repeated is what the query on the rest drops.
    lost = {bytes(k) for r in line_dedup.dropped_keys(frame(left)).collect() for k in r["keys"]}
    assert lost == {bytes(r.key) for r in opened().repeated().collect()} != set()
    opened().delete(frame(rows).filter("doc_id is not null"))
    assert index_rows(opened()) == recounted(frame([r for r in left if r[0] is None]))


def test_rows_of_one_id_meet_their_own_keys_alone(spark):
    own = lambda i: f"a line that three rows of this id hold, {i // 3:05d}"
    rows = [(1, f"{own(i)}\nrest {i}") for i in range(600)] + [(None, own(i)) for i in range(300)] + [(2, own(0)), (2, own(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert max(len(r["keys"]) for r in line_dedup.dropped_keys(docs).collect()) == 1
    got = line_dedup.deduplicated_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in got) == sorted(
        (i or 0, int(i is None or (i == 1 and own(0) in t)), t.replace(own(0), "").lstrip("\n") if i == 1 else "" if i is None else t) for i, t in rows
    )


def test_filters_by_shard_rule_out_what_sent_ones_do(spark):
    rows = [(d, f"the repeated line, number {d % 7:05d}, is here\nan own line of document {d:06d} and no other") for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lines = line_dedup.written(line_dedup.keyed_lines(docs), "t")
    repeated = line_dedup.written(line_dedup.counted(lines).filter("refs >= 3"), "r").withColumn("shard", line_dedup.shard_of("key", 3))
    made = [sorted((r.doc_id, bytes(r.key)) for r in line_dedup.prefiltered(lines, repeated, 3, most).collect()) for most in (1 << 20, 0)]
    assert made[0] == made[1] and 300 <= len(made[0]) < 320  # own lines are gone


def test_one_shard_of_many_lines_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_LINES", 50)
    monkeypatch.setattr(line_dedup, "PREFILTER_BYTES", 0)
    rows = [(d, "one line that all of these documents hold\n" + ("x" * (d % 5))) for d in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(line_dedup.prefiltered, "__defaults__", (0,))
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicated_lines(docs).collect()}
    assert got == {d: int(d != 499) for d in range(500)}


def test_what_an_index_drops_after_changes_is_what_the_query_drops(spark, tmp_path):
    line = lambda i: f"A line of some length, number {i:04d}"
    rng = random.Random(8)
    rows = [(d, "\n".join(line(rng.randrange(60)) for _ in range(5))) for d in range(60)] + [(7, line(1)), (7, line(1)), (None, line(2)), (None, None), (70, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda found: frame([(d, "") for d in found])
    lost = lambda frame: {(r.doc_id, r.row, bytes(k)) for r in frame.collect() for k in r["keys"]}
    path = f"file://{tmp_path}/index"
    opened = lambda: line_dedup.LineIndex(spark, path, n_shards=2, shard_keys=20)

    def brute(rows):
        last, n = {}, defaultdict(int)
        for d, t in rows:
            for k in {line_dedup.line_key(x) for x in (t or "").split("\n")} - {None}:
                n[k], last[k] = n[k] + 1, max(last.get(k, -1), -1 if d is None else d)
        return {(d, k) for d, t in rows for k in {line_dedup.line_key(x) for x in (t or "").split("\n")} - {None} if n[k] >= 3 and last[k] != (-1 if d is None else d)}

    opened().insert(frame(rows[:30]))
    assert {(d, k) for d, _, k in lost(opened().dropped())} == brute(rows[:30])
    opened().insert(frame(rows[30:]))
    whole = lost(opened().dropped())
    assert {(d, k) for d, _, k in whole} == brute(rows) and whole == lost(line_dedup.dropped_keys(frame(rows)))
    out = set(range(0, 60, 2)) | {7}
    opened().delete(ids(out))
    left = [r for r in rows if r[0] not in out]
    assert lost(opened().dropped()) == lost(line_dedup.dropped_keys(frame(left))) and {(d, k) for d, _, k in lost(opened().dropped())} == brute(left) != set()
    # Deleted documents that come back count again, and their earlier deletion takes nothing out any more.
    opened().insert(frame([r for r in rows if r[0] in out]))
    assert lost(opened().dropped()) == whole and index_rows(opened()) == recounted(frame(rows))
    opened().compact()
    assert not opened().live["gone"] and lost(opened().dropped()) == whole
    opened().delete(ids(out))
    assert opened().clean(kept=1, age_s=0) > 0
    assert lost(opened().dropped()) == lost(line_dedup.dropped_keys(frame(left)))
    assert line_dedup.LineIndex(spark, path, least_docs=9).least_docs == 3


def test_index_changes_only_its_own_shards(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(d, "\n".join(f"a line of some length, number {d * 40 + j:06d}" for j in range(40))) for d in range(30)]
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index", n_shards=8).insert(frame(rows))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("index/*/shard=*/version=*/*.parquet")}
    first, live = files(), {n: {s: list(v) for s, v in x.items()} for n, x in index.live.items()}
    index.insert(frame([(100, "a line that nobody had before this document")]))
    assert first.items() <= files().items()  # no file is written anew
    changed = {s for n in ("table", "filters") for s in range(8) if index.live[n].get(s) != live[n].get(s)}
    assert len(changed) == 1
    live = {n: {s: list(v) for s, v in x.items()} for n, x in index.live.items()}
    before = files()
    index.delete(spark.createDataFrame([(100,)], "doc_id long"))
    assert before.items() <= files().items()
    assert {s for n in ("held", "table", "filters") for s in range(8) if index.live[n].get(s) != live[n].get(s)} == changed
    assert index.counts().count() == 1200


def test_index_grows_with_its_keys(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(d, "\n".join(f"a line of some length, number {d * 30 + j:06d}" for j in range(30)) + "\nthe line that every document has") for d in range(20)]
    index = line_dedup.LineIndex(spark, shard_keys=100).insert(frame(rows[:10]))
    assert index.n_shards >= 4
    index.insert(frame(rows[10:]))
    assert index.n_shards >= 8 and index._read("filters").agg({"n_keys": "sum"}).first()[0] == 601
    assert [(r.refs, r.last) for r in index.repeated().collect()] == [(20, 19)]
    index.delete(frame(rows[5:]).select("doc_id"))
    assert index.counts().count() == 151 and [(r.refs, r.last) for r in index.repeated().collect()] == [(5, 4)]


def test_cuckoo_delete_of_equal_marks():
    keys = np.stack([np.arange(4, dtype=np.uint64) % 2, np.full(4, 7, np.uint64) + (np.arange(4, dtype=np.uint64) << np.uint64(20))], axis=1)
    f = line_dedup.CuckooFilter(4)
    assert f.insert(keys)
    f.delete(keys[:2])
    assert (f.table > 0).sum() == 2
    f.delete(keys[2:])
    assert not f.table.any()


W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = W.findall((t or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= 85 * (len(s) + len(t) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets}


def planted(seed, n_groups, size, words, edits):
    """Groups of texts around a base that need not be there; each has up to `edits` changed words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(words)] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("groups", "size", "words", "edits", "block"), [(12, 4, 90, 3, 512), (1, 150, 120, 4, 512), (1, 150, 120, 4, 16), (1, 60, 12, 1, 8)])
def test_near_groups_against_brute_force(spark, monkeypatch, groups, size, words, edits, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = planted(groups * size + words, groups, size, words, edits)
    rows += [(5000, rows[0][1].upper()), (5001, ""), (5002, None), (5003, "a b"), (5004, "A  b"), (5005, "a b c"), (5006, " ".join(f"w{i}" for i in range(20_000)))]
    want = brute_components(rows)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, key string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()}
    assert got == want
    assert any(c != i for i, (_, c) in want.items())


def test_near_groups_of_hard_rows(hard, hard_rows, empty):
    got = near_dedup.near_groups(hard).collect()
    assert len(got) == len(hard_rows)
    want = brute_components([(i, t) for i, t, *_ in {r[0]: r for r in hard_rows if r[0] is not None}.values()])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.first_of_groups(hard)
    assert kept.columns == hard.columns
    assert kept.filter("doc_id is null").count() == 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(70, 70), (9, 100)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 50), *range(100, 161)]}


def spread_shingles(seed, n):
    return np.unique(np.random.default_rng(seed).integers(0, 2**64 - 1, n, dtype=np.uint64))


def test_circulant_signature_is_two_permutations():
    """Coordinate k is the shingle whose place comes first when pi is shifted k places."""
    sigma, pi, _, _ = near_dedup.permutations()
    values = spread_shingles(2, 5)
    sig = near_dedup.signatures(np.concatenate([values[:2], values[2:]]), np.array([0, 2, 5]))
    at = sigma[(values >> np.uint64(64 - near_dedup.PLACE_BITS)).astype(int)]
    for k in (0, 3, near_dedup.ROWS * near_dedup.BANDS - 1):
        full = pi[:, 0][: near_dedup.PLACES]
        assert sig[0, k] == values[:2][full[(at[:2] + k) % near_dedup.PLACES].argmin()]
        assert sig[1, k] == values[2:][full[(at[2:] + k) % near_dedup.PLACES].argmin()]
    many = spread_shingles(3, 5000)
    same = near_dedup.signatures(many, np.array([0, len(many)]), step=64)
    assert (same == near_dedup.signatures(many, np.array([0, len(many)]))).all()


def test_signatures_of_very_large_sets_do_not_saturate():
    a, b = spread_shingles(4, 2_500_000), spread_shingles(5, 2_500_000)
    union = spread_shingles(6, 2_500_000)
    rng = np.random.default_rng(7)
    x, y = (union[rng.random(len(union)) < 0.92] for _ in range(2))
    jaccard = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    offsets = np.concatenate([[0], np.cumsum([len(a), len(b), len(x), len(y)])])
    sig = near_dedup.signatures(np.concatenate([a, b, x, y]), offsets)
    assert not (sig[0] == sig[1]).any()  # nothing in common
    assert abs((sig[2] == sig[3]).mean() - jaccard) < 0.15
    keys = near_dedup.band_keys(sig)
    assert not (keys[0] == keys[1]).any() and (keys[2] == keys[3]).any()


def test_an_id_of_several_texts_is_one_node(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(3, a), (7, a), (7, b), (9, b), (7, ""), (20, near(b)), (30, c), (31, near(c)), (31, d), (29, near(d)), (40, text()), (40, None), (50, ""), (None, a)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    component = {}
    for r in got:
        if r.doc_id is not None:
            assert component.setdefault(r.doc_id, r.component_id) == r.component_id
            assert r.kept == (r.doc_id == r.component_id)
    assert component == {3: 3, 7: 3, 9: 3, 20: 3, 30: 29, 31: 29, 29: 29, 40: 40, 50: 50}
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingle_set(t))) for i, t in rows)
