"""Quality by pairwise ranking: held-out labels, the fit and the threshold against brute force, hard rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from motifdrift.llm import ranking

LABELS = "doc_id long, quality int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        words, bad = [word() for _ in range(rng.randint(15, 80))], i % 4 == 0
        if bad:
            words = {0: [w.upper() + "!!" for w in words], 1: [w + "$$$" for w in words], 2: words[:2] * 20}[i // 4 % 3]
        rows.append((i, " ".join(words) + ".", "en"))
        labels.append((i, 0 if bad else 1, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, LABELS).repartition(3)


def test_held_out_quality(corpus):
    docs, labels = corpus
    out = ranking.quality_report(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert len(out) == 400 and {r.held_out for r in out} == {True, False}
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_labels_of_held_out_documents_change_nothing(spark, corpus):
    docs, labels = corpus
    want = {r.doc_id: r.score for r in ranking.quality_report(docs, labels).collect()}
    out = ranking.held_out(of=3, rest=1)
    turned = labels.filter(~out).unionByName(labels.filter(out).selectExpr("doc_id", "1 - quality AS quality", "text"))
    assert {r.doc_id: r.score for r in ranking.quality_report(docs, turned).collect()} == want


def test_weights_have_the_least_loss_of_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=40) > 0).astype(int)
    better, worse = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    w = ranking.ranked(x, better, worse, ridge=0.01)
    loss = lambda w: np.mean([np.log1p(np.exp(-(x[a] - x[b]) @ w)) for a, b in zip(better, worse, strict=True)]) + 0.005 * (w @ w)
    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(w + step) >= loss(w)


def test_every_row_meets_opponents_of_the_other_label():
    y = np.array([1, 0, 1, 1, 0])
    better, worse = ranking.preference_pairs(y, 3)
    assert (y[better] == 1).all() and (y[worse] == 0).all()
    assert all(((better == i) | (worse == i)).sum() >= 3 for i in range(5))


@pytest.mark.parametrize("seed", range(5))
def test_quantile_parts_labels_best(seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 30)
    y[:2] = 0, 1
    strength = np.round(y * 0.8 + rng.normal(size=30), 1)
    at = np.quantile(strength, ranking.best_quantile(strength, y))
    merit = lambda t: ((strength >= t) & (y == 1)).sum() / (y == 1).sum() + ((strength < t) & (y == 0)).sum() / (y == 0).sum()
    assert merit(at) == pytest.approx(max(merit(t) for t in [-99, *(strength + 1e-9), *strength]))


def test_features_of_whole_texts():
    text = pa.array(["One two two", "", "A!! B!! 12\nA!! B!! 12", "x" * 30])
    told = dict(zip(ranking.STYLE, ranking.features(text).T, strict=False))
    assert told["words"].tolist() == pytest.approx(np.log1p([3, 0, 6, 1]).tolist())
    assert told["capital_share"].tolist() == pytest.approx([1 / 9, 0, 1, 0])
    assert told["doubled_ends"].tolist() == pytest.approx([0, 0, 4 / 6, 0])
    assert told["digit_share"].tolist() == pytest.approx([0, 0, 4 / 16, 0])
    assert told["repeated_lines"].tolist() == pytest.approx([0, 0, 0.5, 0])
    assert told["commonest_word"].tolist() == pytest.approx([2 / 3, 0, 2 / 6, 1])
    assert told["distinct_pairs"].tolist() == pytest.approx([1, 0, 3 / 5, 0])
    assert told["long_words"].tolist() == [0, 0, 0, 1]
    end = ranking.features(pa.array(["a " * 50_000 + "END!!"]))
    assert end[0, ranking.STYLE.index("doubled_ends")] > 0  # the last word of a long text counts


def test_hard_rows(hard, corpus, empty, spark):
    docs, labels = corpus
    model = ranking.fitted(docs, labels)
    got = ranking.scored(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3]
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert ranking.quality_report(empty, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in ranking.quality_report(hard, none).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1, "a"), (4, 1, "a"), (5, 1, "b"), (None, 0, "c"), (6, None, "d")], LABELS)
    assert {r.score for r in ranking.scored(hard, ranking.fitted(hard, one)).collect()} == {1.0}


def test_the_fit_stays_bounded(corpus):
    docs, labels = corpus
    assert 0 < ranking.training_rows(docs, labels, 100).count() < 200
    doubled = docs.unionByName(docs)
    assert ranking.training_rows(doubled, labels, 1000).count() == 400
