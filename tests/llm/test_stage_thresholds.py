"""The pipeline's own thresholds, and rows that a stage must leave."""

import corpus_pipeline
from motifdrift.llm import decontaminate, near_dedup


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_stage_links_from_80_percent(spark):
    """Changed last words: 100 shingles, of which 10 or 13 or so differ, give a Jaccard of 0.82 or below 0.8."""
    words = [f"w{i}" for i in range(104)]
    texts = {1: words, 2: words[:94] + [f"x{i}" for i in range(10)], 3: [f"q{i}" for i in range(104)], 4: [f"q{i}" for i in range(92)] + [f"y{i}" for i in range(12)]}
    cut = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    assert 0.80 <= jaccard(cut[1], cut[2]) < 0.85
    assert jaccard(cut[3], cut[4]) < 0.80
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {1, 3, 4}
    assert near_dedup.near_groups(docs).filter("kept").count() == 4


def test_bands_fit_the_threshold():
    assert near_dedup.bands_for(85) == near_dedup.BANDS
    for percent in (50, 80, 85, 95):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISSED


def test_benchmark_stage_removes_rows_not_ids(spark):
    """Both forms leave the same rows, also where a contaminated row shares its id, or has none."""
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    bad = f"{text('a', 20)} {text('item', 15)}"
    rows = [(1, bad, 1), (1, text("b", 30), 2), (None, bad, 3), (None, text("c", 30), 4), (None, None, 5), (2, text("d", 30), 6), (3, bad, 7), (3, bad, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    items = spark.createDataFrame([(1, text("item", 15))], "item_id long, text string")
    want = sorted([r for r in rows if r[1] != bad], key=str)
    for most in (10**6, -1):
        clean = decontaminate.clean_documents(docs, items, most_shingles=most)
        assert clean.schema == docs.schema
        assert sorted([tuple(r) for r in clean.collect()], key=str) == want
