import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifdrift.llm import lang_id, toxicity
from motifdrift.llm.shared import held_out

SYLLABLES = {"aa": ["the", "ing", "wh", "ou", "st"], "bb": ["sch", "ung", "ber", "ei", "tz"], "cc": ["жи", "ра", "но", "ти"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 30) + ".", lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 240))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_held_out_languages(corpus):
    out = lang_id.language_report(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in out} == {True, False}
    assert all(r.lang_pred == r.lang for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_mixed_text_has_spans(spark, corpus):
    rng = random.Random(9)
    text = f"{sentence(rng, 'aa', 20)} 123 -- {sentence(rng, 'bb', 15)} {sentence(rng, 'cc', 10)} ung"
    rows = [(1, text), (2, None), (3, "123 !!"), (4, ""), (5, "漢字"), (None, sentence(rng, "cc", 3)), (1, text)]
    model = lang_id.fitted(corpus)
    got = lang_id.labelled_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    mixed = [r for r in got if r.doc_id == 1]
    assert mixed[0] == mixed[1]
    assert [s.lang for s in mixed[0].spans][:3] == ["aa", "bb", "cc"]
    assert mixed[0].spans[0].first == 0 and mixed[0].spans[-1].last == mixed[0].n_words - 1
    assert all(a.last + 1 == b.first for a, b in zip(mixed[0].spans, mixed[0].spans[1:]))
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {i: ("und", 0.0) for i in (2, 3, 4)}
    assert next(r for r in got if r.doc_id is None).lang_pred == "cc"
    assert next(r for r in got if r.doc_id == 5).lang_pred in SYLLABLES  # a letter, but of a script that was never seen


def test_nothing_learned_and_filter(spark, corpus, empty, hard):
    assert lang_id.fitted(empty) is None
    assert {r.lang_pred for r in lang_id.labelled_spans(hard, None).collect()} == {"und"}
    kept = lang_id.identified(hard, lang_id.fitted(corpus))
    assert kept.columns == hard.columns
    assert not {r.doc_id for r in kept.collect()} & {1, 2, 3, 40}
    assert lang_id.language_report(empty).count() == 0


def brute_viterbi(scores, switch):
    n, k = scores.shape
    return max(
        itertools.product(range(k), repeat=n),
        key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])),
    )


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    lengths = [0, 6, 1, 5, 0, 6]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    for switch in (0.5, 3.0, 50.0):
        got = lang_id.viterbi(scores, offsets, switch)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b > a:
                best = brute_viterbi(scores[a:b], switch)
                total = lambda p, a=a: sum(scores[a + i, s] for i, s in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:]))
                assert abs(total(best) - total(got[a:b].tolist())) < 1e-3


def brute_kernel(s, t):
    d, total = toxicity.DECAY, 0.0
    for i in itertools.combinations(range(len(s)), toxicity.DEPTH):
        for j in itertools.combinations(range(len(t)), toxicity.DEPTH):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += d ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_all_subsequences():
    words = ["idiot", "i-dxiot", "banana", "ananas", "ab", "trashy"]
    codes = toxicity.char_codes(words, 8)
    for w in words:
        got = toxicity.kernel(codes, toxicity.char_codes([w], len(w)))
        assert np.allclose(got, [brute_kernel(v, w) for v in words], atol=1e-4)


def test_gapped_insults_are_like_the_plain_one():
    marks = toxicity.Landmarks(["moron", "pathetic"], 2)
    words = ["moron", "morxon", "mooron", "pathettic", "window", "thread"]
    rows, k = marks.like(words)
    like = dict(zip((words[i] for i in rows), k.max(1), strict=True))
    assert min(like.get(w, 0) for w in words[:4]) > 0.5
    assert max(like.get(w, 0) for w in words[4:]) < 0.35
    k, of = marks.sentence_features(pa.array(["", "fine words. m o r o n you", "Moron! fine", "so pa-the-tic " + "q" * 100]))
    assert sorted(of.tolist()) == [1, 2, 3]
    assert (k.max(1) > 0.95).all()


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(8)
    bad = ["moron", "pathetic", "worthless"]
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, "aa", 40).split()
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark, insults):
    docs, labels = insults
    out = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 40
    assert Counter((r.predicted, r.toxic) for r in out).keys() == {(0, 0), (1, 1)}
    model = toxicity.fitted(docs, labels)
    odd = [(1, None), (2, ""), (3, "a mo-ron"), (4, "m o r o n"), (5, "patheetic the"), (6, "the ing"), (None, "moron"), (7, "the " * 30_000 + "moron")]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == got[6] < 0.5 < min(got[i] for i in (3, 4, 5, 7, None))


def test_toxicity_without_classes(spark, insults, hard, empty):
    docs, labels = insults
    none = labels.filter("toxic > 5")
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity_report(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1.0}
    assert toxicity.toxicity_report(empty, labels).count() == 0
    assert toxicity.toxicity_report(hard, labels).count() == hard.count()


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def best_total(scores, switch):
    """The best path's total, word by word."""
    best = scores[0].astype(float)
    for row in scores[1:]:
        best = np.maximum(best, best.max() - switch) + row
    return best.max()


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_viterbi_in_blocks_is_viterbi(monkeypatch, block):
    monkeypatch.setattr(lang_id, "BLOCK_WORDS", block)
    rng = np.random.default_rng(block)
    for n_labels in (2, 5):
        offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 30))])
        scores = (rng.normal(size=(offsets[-1], n_labels)) * 4).astype(np.float32)
        labels = lang_id.viterbi(scores, offsets, 14.0)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b > a:
                own = scores[np.arange(a, b), labels[a:b]].astype(float).sum() - 14 * (np.diff(labels[a:b]) != 0).sum()
                assert own == pytest.approx(best_total(scores[a:b], 14.0), abs=0.01)


def test_viterbi_of_a_million_words_takes_seconds():
    import time

    scores = np.random.default_rng(1).normal(size=(1_000_000, 4)).astype(np.float32)
    began = time.time()
    assert len(lang_id.viterbi(scores, np.array([0, len(scores)]), 14.0)) == len(scores)
    assert time.time() - began < 20


def test_evenly_mixed_texts_and_unknown_scripts(spark):
    rng = random.Random(3)
    langs = {f"l{i:02d}": [chr(97 + (i * 7 + j * 5) % 26) + chr(97 + (i * 3 + j) % 26) + "aeiou"[(i + j) % 5] for j in range(4)] for i in range(40)}
    word = lambda lang: "".join(rng.choice(langs[lang]) for _ in range(3))
    docs = spark.createDataFrame([(i, " ".join(word(lang) for _ in range(40)), lang) for i, lang in enumerate(sorted(langs) * 3)], "doc_id long, text string, lang string")
    model = lang_id.fitted(docs)
    assert model.languages == sorted(langs)  # none is left out
    mixed = " ".join(" ".join(word(lang) for _ in range(25)) for lang in ("l01", "l11", "l21", "l31", "l05"))
    rows = [(1, mixed), (2, "漢字漢字 カナ"), (3, "漢 " + mixed), (4, "... 12"), (5, None)]
    kept = lang_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    nothing = lang_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {r.doc_id for r in nothing.collect()} == {1, 2, 3}


@pytest.fixture(scope="module")
def four(spark):
    """A model of four Latin languages, each of its own syllables, and a maker of their sentences; "ee" and "ff" aren't learned."""
    syllables = {
        "aa": ["the", "ing", "wh", "ou", "st", "an"], "bb": ["sch", "ung", "ber", "ei", "tz", "en"], "cc": ["que", "ado", "ll", "ci", "ra", "os"], "dd": ["eau", "oi", "ment", "re", "vi", "la"],
        "ee": ["kko", "yyt", "ään", "uus", "vat", "pii"], "ff": ["szcz", "owa", "zny", "rzy", "dź", "ków"],
    }
    rng = random.Random(11)
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."
    rows = [(i, say(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 40)]
    return lang_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string")), say, rows


def test_languages_without_labels_go(spark, four):
    model, say, rows = four
    mixed = " ".join(say(lang, 12) for lang in ("aa", "bb", "cc", "dd"))
    stay = {1: say("aa", 40), 2: mixed, 3: " ".join(say(lang, 3) for lang in ("aa", "bb", "cc", "dd") * 5), 4: "ok", 5: f"{say('bb', 30)} {say('ee', 25)}", 6: say("dd", 1)}
    stay[7] = say("cc", 12) + ' token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab"'
    stay[8] = "yyt kko"
    go = {20: say("ee", 40), 21: say("ff", 40), 22: "zxqv wqkj xkcd bvnm qqzz jjxx", 23: "漢字仮名 カナ 漢字", 24: None, 25: "", 26: "12 .. !", 27: say("ee", 2000), 28: "Жи ра но ти щука"}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in {**stay, **go}.items()], "doc_id long, text string, score double").repartition(3)
    kept = lang_id.identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(stay)
    assert lang_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).count() == len(rows)


def test_scores_and_evidence_from_recounted_letters(four):
    model, say, rows = four
    grams, letters = {lang: Counter() for lang in model.languages}, Counter()
    around = lambda w: [(a, b, c) for a, b, c in zip("\n" + w[:-1], w, w[1:] + "\n", strict=True) if b.isalpha()]
    for _, text, lang in rows:
        for w in text.lower().split():
            grams[lang].update(around(w))
            letters.update(x for g in around(w) for x in g)
    kept = [w for w in {w for _, t, _ in rows for w in t.lower().split()}]
    scores, n, apart = model.word_scores(kept)
    everything, size = sum(letters.values()), lang_id.SMOOTH * lang_id.BUCKETS
    # Buckets of hashes may be shared, which can only raise a count.
    close = 0
    for i, w in enumerate(kept):
        assert n[i] == sum(c.isalpha() for c in w)
        back = sum(max(sum(np.log((letters[x] + lang_id.SMOOTH) / (everything + lang_id.SMOOTH * lang_id.LETTERS)) for x in g), -np.log(lang_id.BUCKETS)) for g in around(w))
        assert apart[i] == pytest.approx(back, rel=1e-6)
        for k, lang in enumerate(model.languages):
            own = sum(np.log((grams[lang][g] + lang_id.SMOOTH) / (sum(grams[lang].values()) + size)) for g in around(w))
            assert scores[i, k] >= own - 1e-3
            close += scores[i, k] == pytest.approx(own, abs=1e-3)
    assert close > 0.9 * len(kept) * len(model.languages)
    texts = [say("aa", 9), say("ee", 9), say("aa", 5) + " " + say("bb", 5)]
    total, told, gain, known = lang_id.told_by_labels(pa.array(texts), model)
    assert known.tolist() == total.tolist()
    for i, t in enumerate(texts):
        words = t.split()
        scores, n, apart = model.word_scores(words)
        labels = brute_viterbi(scores, lang_id.SWITCH) if len(words) < 9 else lang_id.viterbi(scores, np.array([0, len(words)]), lang_id.SWITCH)
        own = [scores[j, label] - apart[j] for j, label in enumerate(labels)]
        assert (total[i], told[i]) == (sum(n), sum(m for m, g in zip(n, own, strict=True) if g > 0)) and gain[i] == pytest.approx(sum(own), abs=1e-2)


def test_windows_of_long_words_are_one_word():
    marks = toxicity.Landmarks(["grubbish", "plainly"], 1)
    pad = "acdefjklmnopqtvwxyz"
    long = f"{pad}grubbish{pad}"
    texts = pa.array([f"a {long} b", "grubbish", " ".join(f"{pad}{i:04d}grubbish{pad}" for i in range(3000))])
    values, of = marks.sentence_features(texts, by_word=True)
    assert (of == 0).sum() == 1 and (of == 1).sum() == 1 and (of == 2).sum() == 3000
    pieces = toxicity.windows(long)
    alone, k = marks.like(pieces)
    assert values[of == 0][0].tolist() == k.max(0).tolist()
    again, same = marks.like(pieces)
    assert again.tolist() == alone.tolist() and (same == k).all()


def test_the_form_is_chosen_inside_the_rows_given():
    rng = np.random.default_rng(2)
    n = 2000
    y = (rng.random(n) < 0.2).astype(float)
    seen = np.zeros((n, toxicity.EVIDENCE))
    seen[:, 0] = 2 + rng.random(n)  # the worst word tells nothing, the next ones do
    seen[:, 1:4] = -np.sort(-(rng.random((n, 3)) * 0.3 + y[:, None] * (rng.random((n, 3)) < 0.9)), axis=1)
    n_words, weight = toxicity.chosen_form(seen, y, np.arange(n) % toxicity.FOLDS)
    assert n_words >= 2
    w = toxicity.logistic_fit(seen, y, n_words, weight)
    said = toxicity.form_of(seen, n_words) @ w[:-1] + w[-1] >= 0
    assert said[y == 1].mean() > 0.9 and said[y == 0].mean() < 0.05
    assert toxicity.chosen_form(seen * 0, y, np.arange(n) % toxicity.FOLDS) in [(a, b) for a in toxicity.FORMS for b in toxicity.WEIGHTS]
