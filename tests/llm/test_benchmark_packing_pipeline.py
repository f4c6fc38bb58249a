import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from motifdrift.llm import decontaminate, entry, packing
from tests.llm.test_lines_and_near import brute_components, key, shingle_set


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 12, 25, 60])))) for i in range(30)] + [(30, "two words"), (31, None), (32, ""), (None, "no id here at all")]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rng.choice([50, 400, 2000]))]
        if i % 2:
            part = items[rng.randrange(30)][1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    docs += [(80, "Two  WORDS"), (81, None), (82, ""), (None, items[3][1]), (5, items[4][1]), (5, items[4][1])]
    return docs, items


def brute_leaks(docs, items):
    sets = [(i, shingle_set(t)) for i, t in items if i is not None]
    out = []
    for d, t in docs:
        own = shingle_set(t)
        out += [(d, i, len(s), len(s & own)) for i, s in sets if s and 100 * len(s & own) >= 80 * len(s)]
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark, leaks, empty):
    docs, items = leaks
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n int, shingle string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 20
    for most in (10**6, -1):
        got = decontaminate.contaminated(d, i, most_shingles=most).collect()
        assert sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got], key=str) == want
        clean = decontaminate.clean_documents(d, i, most_shingles=most)
        assert clean.columns == d.columns
        assert {r.doc_id for r in clean.collect()} == {x for x, _ in docs} - {w[0] for w in want}
    assert decontaminate.contaminated(empty, i).count() == 0
    assert decontaminate.contaminated(d, i.limit(0)).count() == 0


def test_only_candidates_of_the_sketches_are_compared(spark, leaks):
    docs, items = leaks
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    parts = decontaminate.indexed_items(i)
    index = decontaminate.ItemIndex(parts.toArrow())
    assert len(index.partitions) >= 4 and len(index.sketch) < 0.6 * parts.count()
    import pyarrow as pa

    from motifdrift.llm.words import distinct_in_text, shingles

    texts = [t or "" for _, t in docs]
    values, at = distinct_in_text(*shingles(pa.array(texts), 5))
    found = index.search(values, at)
    want = brute_leaks(docs, items)
    assert len(found[0]) == index.verified == len(want) and index.compared <= 2 * len(want)
    # Where a sketch can't be hit, nothing is found: the full sets have no search of their own.
    blind = decontaminate.ItemIndex(parts.withColumn("shingle", (-parts.shingle - (parts.place >= parts.k).cast("long"))).toArrow())
    assert len(blind.search(values, at)[0]) == 0
    assert decontaminate.found_by_shuffle(d, parts.withColumn("k", parts.k * 0)).count() == 0


def test_items_that_repeat_an_id_are_one(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words[k : k + 12])) for k in range(0, 200, 10)] + [(2, " ".join(words[:40]))] * 3 + [(3, " ".join(words[:40]))]
    docs = [(1, " ".join(words[:170])), (2, " ".join(words[:205])), (3, " ".join(words[3:38]))]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    sets = {k: set().union(*(shingle_set(t) for j, t in items if j == k)) for k in (1, 2, 3)}
    want = sorted((a, k, len(s), len(s & shingle_set(t))) for a, t in docs for k, s in sets.items() if 100 * len(s & shingle_set(t)) >= 80 * len(s))
    assert {k for _, k, _, _ in want} == {1, 2, 3}
    for most in (10**6, -1):
        assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(d, i, most_shingles=most).collect()) == want


def test_sketches_miss_nothing():
    for n in range(1, 400):
        k, lack = decontaminate.sketch_size(n), decontaminate.missing(n)
        assert k <= n and k - lack >= 1


def check_packing(rows, sizes, tokens):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append((r.start, r.length))
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert len({r.capacity for r in b}) == 1
        assert b[0].capacity == min(s for s in sizes if s >= at)
    for i, n in tokens.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n


@pytest.mark.parametrize("sizes", [(512, 1024, 2048), (64,), (10, 1000)])
def test_packing_is_whole_and_tight(spark, sizes):
    rng = random.Random(2)
    tokens = {i: rng.choice([1, 5, 60, 300, 700, 5000]) for i in range(500)}
    rows = packing.packed(spark.createDataFrame(list(tokens.items()), "doc_id long, tokens long").repartition(5), sizes, group_pieces=200).collect()
    check_packing(rows, sizes, tokens)


def test_packing_of_hard_rows(spark, hard, hard_rows, empty):
    got = packing.packed_documents(hard)
    assert got.agg({"length": "sum"}).first()[0] == sum(len((t or "").split()) if (t or "").isascii() else len(t.split(" ")) - t.split(" ").count("") for _, t, *_ in hard_rows) + len(hard_rows)
    assert packing.packed_documents(empty).count() == 0
    assert packing.packed(spark.createDataFrame([(1, None), (2, 0), (3, -4)], "doc_id long, tokens long")).count() == 0


def test_several_sizes_cost_less_than_one():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5, 1.2, 3000).astype(int) + 1, 8192)

    def total(sizes):
        bins, _, capacity = packing.pack(lengths, sizes)
        return sum(packing.cost(c) for _, c in {(b, c) for b, c in zip(bins.tolist(), capacity.tolist(), strict=True)})

    assert total(packing.LENGTHS) < min(total((8192,)), total((4096, 8192)))


def least_cost(lengths, sizes):
    """The cheapest packing of all, by trying every partition of the pieces."""
    best = float("inf")

    def go(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(packing.cost(next(s for s in sizes if s >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= sizes[-1]:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def cost_of(lengths, sizes):
    bins, _, capacity = packing.pack(np.array(lengths), sizes)
    return sum(packing.cost(c) for _, c in set(zip(bins.tolist(), capacity.tolist(), strict=True)))


def test_opening_sizes_are_chosen_jointly():
    sizes = (512, 1024, 2048, 4096, 8192)
    same = np.full(300, 600)
    assert packing.pack(same, sizes)[2].min() == 2048  # three of 600 fill it; one alone would fill 1024 badly
    assert packing.pack(np.full(300, 500), sizes)[2].min() == 1024  # two
    assert packing.pack(np.array([300]), sizes)[2].tolist() == [512]  # nothing else is left
    rng = np.random.default_rng(5)
    for lengths in (same, rng.integers(1, 2000, 400), rng.choice([90, 700, 1500], 200)):
        single = [packing.packed_with(lengths, np.argsort(-lengths, kind="stable").tolist(), sizes, s)[3] for s in sizes]
        assert cost_of(lengths, sizes) <= min(single)
    assert cost_of(same, sizes) < 0.8 * cost_of(same, (1024,))
    worst = 0
    for k in range(40):
        lengths = np.random.default_rng(k).integers(50, 1500, 7).tolist()
        worst = max(worst, cost_of(lengths, sizes) / least_cost(lengths, sizes))
    assert worst < 1.15


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i % 700 if i % 5 else None, rng.choice([3, 40, 40, 900, 9000])) for i in range(2000)] + [(7, 55)] * 900
    made = [
        Counter(map(tuple, packing.packed(spark.createDataFrame(rows, "doc_id long, tokens long").repartition(n), group_pieces=300).collect())) for n in (3, 7)
    ]
    assert made[0] == made[1]
    assert sum(r[3] * n for r, n in made[0].items()) == sum(t for _, t in rows)


def test_many_equal_rows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 100)
    rows = [(None, 30)] * 1050 + [(1, 30)] * 100 + [(2, 9000)] * 150
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, tokens long"), group_pieces=200).collect()
    assert Counter(r.doc_id for r in out) == {None: 1050, 1: 100, 2: 300}


def test_pipeline_stages(spark, leaks, tmp_path):
    """Each stage on its own input: what goes is what a brute-force version says, and columns stay."""
    rng = random.Random(4)
    docs, items = leaks
    line = "this same line stands in many of the documents here"
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs if i is not None and not (i == 5 and len(t) < 400)]
    rows += [(100 + i, f"{docs[2][1]} x{i}", "en", "s", 0) for i in range(4)] + [(200 + i, f"{line}\n{docs[4][1][i * 40 : i * 40 + 60]}", "en", "s", 0) for i in range(5)]
    rows += [(300, "!!! 123", "en", "s", 0)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in now.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/stage-{name}")
        now = spark.read.parquet(f"{tmp_path}/stage-{name}")
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "language":
            want = {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "lines":
            held = defaultdict(set)
            for i, t in before.items():
                for x in (t or "").split("\n"):
                    held[key(x)].add(i)
            gone = lambda x, i: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(held[key(x)])
            want = {i: "\n".join(x for x in t.split("\n") if not gone(x, i)) for i, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        elif name == "near":
            want = {i: before[i] for i, (_, c) in brute_components(sorted(before.items())).items() if c == i}
        else:
            bad = {w[0] for w in brute_leaks(sorted(before.items()), items)}
            want = {i: t for i, t in before.items() if i not in bad}
        assert after == want, name
        assert name == "lines" or len(after) < len(before)
        before = after
    tokens = {i: len(t.split()) + 1 for i, t in before.items()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect(), packing.LENGTHS, tokens)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), packing.LENGTHS, tokens)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in entry.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(entry.oracle_sql()) <= set(entry.queries())
