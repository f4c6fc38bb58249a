"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of DEPTH characters, weighted by DECAY for each character that they span, so an
insult with gaps or inserted characters stays close to the plain one. Landmarks are words: those that set toxic
documents apart, and ordinary ones. A sentence's features are the kernel values of its closest word to each landmark,
mapped by K^(-1/2) of the landmarks. A linear SVM is trained on labelled sentences: all sentences of clean
documents, and of each toxic one those that the last fit finds worst. The margins of a document's worst
words, taken as sentences of their own, and its length are turned into a probability by a logistic fit on training documents:
one word that looks like an insult by chance, in a long text, is less than several in a short one. How many words decide, and how much
more a toxic document weighs, is chosen by cross-validation inside the training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift.llm.shared import held_out, written
from motifdrift.llm.words import coded_words, list_array, slices

#: Labelled documents that the model is fitted on, about; landmarks of both kinds.
TRAIN_DOCS, TOXIC, USUAL = 20_000, 64, 16
#: Words, and beginnings of so many letters, can be toxic landmarks from this log-likelihood ratio (G squared) of their
#: document counts. So many of the highest are considered; one that is so like a chosen one is passed over.
STEMS, LEAST_TELLING, CONSIDERED, ALIKE = (4, 5, 6, 7, 8), 12.0, 1_000, 0.6
DEPTH, DECAY = 3, 0.7
#: Words are compared in windows of so many characters; kernel values below LEAST_LIKE are chance and count as 0.
WINDOW, LEAST_LIKE = 24, 0.2
#: Hash places of ordered letter pairs; pairs up to GAP apart must agree in this share before the kernel is computed.
PAIRS, GAP, PAIR_SHARE = 256, 4, 0.5
ROUNDS = 3
#: Words that a Python worker remembers to have compared.
REMEMBERED = 300_000
#: Distinct sentences that a fit takes, about; of more clean ones, a sample by hash.
MOST_SENTENCES = 50_000
#: Forms that cross-validation chooses from: so many of a document's worst words decide, and toxic documents weigh so much more.
WORST, FORMS, WEIGHTS, FOLDS = 8, (1, 2, 4, 8), (1.0, 2.0, 4.0), 4
EVIDENCE = WORST + 2
#: The share of clean documents that a chosen form calls toxic at most, if any form does so.
FALSE_SHARE = 0.01


def plain(word: str) -> str:
    """Lower case, letters and digits only."""
    word = word.lower()
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def windows(unit: str) -> list[str]:
    return [unit] if len(unit) <= WINDOW else [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def char_codes(words: list[str], width: int) -> np.ndarray:
    """words x width code points; 0 fills up."""
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def decay_matrix(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.where(i[:, None] >= i[None, :], DECAY ** np.maximum(0, i[:, None] - i[None, :]), 0).astype(np.float32)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Weights of the common subsequences of DEPTH characters, for rows of codes s and t (t may be one row for all)."""
    t = np.broadcast_to(t, (len(s), t.shape[-1]))
    equal = ((s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)).astype(np.float32) * np.float32(DECAY**2)
    left, right = decay_matrix(s.shape[1]), decay_matrix(t.shape[1]).T
    ends = equal
    for _ in range(DEPTH - 1):
        before = left @ ends @ right
        ends = np.zeros_like(equal)
        ends[:, 1:, 1:] = equal[:, 1:, 1:] * before[:, :-1, :-1]
    return ends.sum((1, 2))


def pair_places(codes: np.ndarray) -> np.ndarray:
    """words x PAIRS: which ordered letter pairs, at most GAP apart, a word has."""
    out = np.zeros((len(codes), PAIRS), np.float32)
    for gap in range(1, min(GAP + 1, codes.shape[1])):
        a, b = codes[:, :-gap], codes[:, gap:]
        row, col = np.nonzero((a > 0) & (b > 0))
        out[row, (a[row, col].astype(np.uint64) * np.uint64(0x9E3779B1) + b[row, col].astype(np.uint64) * np.uint64(0x85EBCA77) >> np.uint64(11)).astype(np.int64) % PAIRS] = 1
    return out


class Landmarks:
    """Words that others are compared with. Only those like one of the first n_toxic are looked at: for an ordinary word all features are 0."""

    def __init__(self, words: list[str], n_toxic: int):
        self.words, self.n_toxic = words, n_toxic
        self.codes = char_codes(words, WINDOW)
        self.own = np.sqrt(kernel(self.codes, self.codes))
        self.lengths = [len(w) for w in words]
        self.pairs = pair_places(self.codes[:n_toxic])
        self.least = np.maximum(2, PAIR_SHARE * self.pairs.sum(1))
        self.compared: dict[str, np.ndarray | None] = {}

    def like(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are like any landmark, and their normalised kernel values. Words are compared once."""
        if len(self.compared) > REMEMBERED:
            self.compared.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.compared]:
            self.compared.update(dict.fromkeys(new))
            at, values = self.compare(new)
            self.compared.update(zip((new[i] for i in at.tolist()), values, strict=True))
        found = [(i, v) for i, w in enumerate(words) if (v := self.compared[w]) is not None]
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        return np.array([i for i, _ in found], np.int64), np.stack([v for _, v in found])

    def compare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """like() without memory."""
        rows, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        long_enough = [i for i, w in enumerate(words) if len(w) >= DEPTH]
        for a in range(0, len(long_enough), 8192):
            part = long_enough[a : a + 8192]
            codes = char_codes([words[i] for i in part], max(len(words[i]) for i in part))
            maybe = pair_places(codes) @ self.pairs.T >= self.least
            some = np.flatnonzero(maybe.any(1))
            if not len(some):
                continue
            codes, maybe = codes[some], maybe[some]
            own = np.sqrt(np.maximum(kernel(codes, codes), 1e-12))
            k = np.zeros((len(some), len(self.words)), np.float32)
            for j, n in enumerate(self.lengths):
                # An ordinary landmark is compared with the words that a toxic one has let through.
                at = np.flatnonzero(maybe[:, j] if j < self.n_toxic else k[:, : self.n_toxic].any(1))
                if len(at):
                    like = kernel(codes[at], self.codes[j : j + 1, :n]) / (own[at] * self.own[j])
                    k[at, j] = np.where(like < LEAST_LIKE, 0, like)
            keep = k.any(1)
            rows.append(np.array(part, np.int64)[some[keep]])
            values.append(k[keep])
        return np.concatenate(rows), np.concatenate(values)

    def gram(self) -> np.ndarray:
        k = np.array([kernel(self.codes, self.codes[j : j + 1, :n]) for j, n in enumerate(self.lengths)], np.float64)
        k = k / np.outer(self.own, self.own)
        k[k < LEAST_LIKE] = 0
        return (k + k.T) / 2

    def sentence_features(self, text: pa.Array, by_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Features (max over words) of all sentences with any, and the text that each belongs to. Runs of single letters are words too.

        by_word: every word is a sentence of its own.
        """
        codes, distinct, offsets = coded_words(text)
        owner = np.repeat(np.arange(len(text)), np.diff(offsets))
        ends = np.array([w[-1] in ".!?" for w in distinct], bool)[codes] if len(codes) else np.zeros(0, bool)
        new = np.ones(len(codes), bool)
        new[1:] = ends[:-1] | (owner[1:] != owner[:-1])
        sentence = np.cumsum(new) - 1
        units = [plain(w) for w in distinct]
        single = np.array([len(u) == 1 for u in units], bool)[codes] if len(codes) else np.zeros(0, bool)
        places, extra = [], []
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= DEPTH:
                for w in windows("".join(units[c] for c in codes[a:b])):
                    places.append(sentence[a])
                    extra.append(w)
        long = [(c, w) for c, u in enumerate(units) if len(u) > WINDOW for w in windows(u)]
        base = [u if len(u) <= WINDOW else "" for u in units]
        rows, k = self.like(base + [w for _, w in long] + extra)
        row_of = np.full((len(distinct),), -1, np.int64)
        n, m = len(base), len(base) + len(long)
        row_of[rows[rows < n]] = np.arange((rows < n).sum())
        # The windows of a long word are one row, their largest values.
        of_long = (rows >= n) & (rows < m)
        which, place = np.unique(np.array([c for c, _ in long], np.int64)[rows[of_long] - n], return_inverse=True)
        joined = np.zeros((len(which), len(self.words)), np.float32)
        np.maximum.at(joined, place, k[of_long])
        row_of[which] = (rows < n).sum() + np.arange(len(which))
        table = np.concatenate([k[rows < n], joined])
        at = np.flatnonzero(row_of[codes] >= 0) if len(codes) else np.zeros(0, np.int64)
        of = np.concatenate([sentence[at], np.array([places[r - m] for r in rows[rows >= m]], np.int64)])
        values = np.concatenate([table[row_of[codes[at]]] if len(at) else np.zeros((0, len(self.words)), np.float32), k[rows >= m]])
        order = np.argsort(of, kind="stable")
        of, values = of[order], values[order]
        if not len(of):
            return values, of
        text_of = owner[np.flatnonzero(new)]
        if by_word:
            return values, text_of[of]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return np.maximum.reduceat(values, first, axis=0), text_of[of[first]]


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slopes: np.ndarray | None = None  # of the logistic fit, and the intercept

    def evidence(self, text: pa.Array) -> np.ndarray:
        """texts x EVIDENCE: how far the margins of the worst words are above the bias, falling; whether there are any, and the text's length if so.

        A word unlike all landmarks has the bias, and none counts less, so all texts without a likeness are rows of zeros.
        """
        out = np.zeros((len(text), EVIDENCE))
        k, of = self.landmarks.sentence_features(text, by_word=True)
        margin = np.maximum(k @ self.weights, 0)
        order = np.lexsort((-margin, of))
        margin, of = margin[order], of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < WORST
        out[of[top], place[top]] = margin[top]
        some = out[:, 0] > 0
        out[:, WORST] = some
        out[some, WORST + 1] = np.log1p(pc.binary_length(text).to_numpy(zero_copy_only=False)[some])
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(text) @ self.slopes[:-1] + self.slopes[-1], -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, most_docs: int) -> DataFrame:
    """doc_id, text, toxic of about most_docs labelled documents; a document with several labels is toxic if any says so."""
    by_doc = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = by_doc.count()
    some = by_doc if n <= most_docs else by_doc.sample(most_docs / n, seed=5)
    some = written(some, "toxic-labels")
    return written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "toxic-train")  # about most_docs rows of ids


def stems(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words and word beginnings (STEMS letters); and pairs: number of a word, number of one of its stems."""
    place: dict[str, int] = {}
    word, stem = [], []
    for i, w in enumerate(words):
        w = plain(w)
        for x in {w[:n] for n in (*STEMS, len(w)) if DEPTH <= n <= len(w) <= WINDOW}:
            word.append(i)
            stem.append(place.setdefault(x, len(place)))
    return list(place), np.array(word, np.int64), np.array(stem, np.int64)


def chosen_landmarks(train: DataFrame, n_toxic: int, n_usual: int) -> tuple[list[str], list[str]]:
    """Words and stems that set toxic documents most apart, no two of them alike; and ordinary words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=4 << 20):
            codes, distinct, offsets = coded_words(text)
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
            names, word, stem = stems(distinct)
            size = max(1, len(distinct))
            each = np.unique(np.repeat(np.arange(len(text)), np.diff(offsets)) * size + codes)
            starts, n = np.searchsorted(word, np.arange(size)), np.bincount(word, minlength=size)
            n_each = n[each % size]
            at = np.repeat(starts[each % size] - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
            pair = np.unique(np.repeat(each // size, n_each) * max(1, len(names)) + stem[at])
            bad, which = toxic[pair // max(1, len(names))] == 1, pair % max(1, len(names))
            pos, neg = np.bincount(which[bad], minlength=len(names)), np.bincount(which[~bad], minlength=len(names))
            yield pa.record_batch({"word": pa.array(names, pa.string()), "pos": pa.array(pos), "neg": pa.array(neg)})

    words = train.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = train.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = total["pos"] or 0, total["n"] - (total["pos"] or 0)
    rate_pos, rate_neg = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    rate = (F.col("pos") + F.col("neg") + 1) / (pos + neg + 2)
    telling = F.when(rate_pos > rate_neg, 2 * (F.col("pos") * F.log(rate_pos / rate) + F.col("neg") * F.log(rate_neg / rate))).otherwise(0.0)
    words = written(words.withColumn("g", telling), "toxic-words")
    best = [r.word for r in words.filter(F.col("g") >= LEAST_TELLING).orderBy(F.desc("g"), F.desc(F.length("word")), "word").limit(CONSIDERED).collect()]
    worst: list[str] = []
    if best:
        codes = char_codes(best, WINDOW)
        own = np.sqrt(kernel(codes, codes))
        free = np.ones(len(best), bool)
        for i in range(len(best)):
            if free[i] and len(worst) < n_toxic:
                worst.append(best[i])
                free &= kernel(codes, codes[i : i + 1]) / (own * own[i]) < ALIKE
    usual = [r.word for r in words.filter("neg >= 5 and g < 4").orderBy(F.xxhash64("word"), "word").limit(n_usual).collect()]
    return worst, usual


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    x1 = np.column_stack([x, np.ones(len(x))])
    del x
    ridge = np.diag(np.append(np.full(x1.shape[1] - 1, reg), reg * 1e-3))
    w = np.zeros(x1.shape[1])
    for _ in range(100):
        inside = y * (x1 @ w) < 1
        part = x1[inside] * weight[inside, None]
        new = np.linalg.solve(part.T @ x1[inside] + ridge, part.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fitted(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, n_toxic: int = TOXIC, n_usual: int = USUAL) -> Model | float:
    """A model of docs (doc_id, text) and labels (doc_id, toxic); only the base rate if there are not both classes or no landmark."""
    train = training_rows(docs, labels, most_docs)
    row = train.agg(F.avg("toxic")).first()
    rate = float(row[0] or 0.0)
    worst_words, usual = chosen_landmarks(train, n_toxic, n_usual) if 0 < rate < 1 else ([], [])
    if not worst_words:
        return rate
    names = worst_words + usual
    marks = Landmarks(names, len(worst_words))
    values, vectors = np.linalg.eigh(marks.gram())
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=8 << 20):
            k, of = sent.value.sentence_features(text)
            # Each document also has one sentence that is like no landmark.
            k, of = np.concatenate([k, np.zeros((len(text), len(names)), np.float32)]), np.concatenate([of, np.arange(len(text))])
            take = pa.array(of)
            yield pa.record_batch({
                "doc_id": batch.column(0).take(take), "toxic": batch.column(2).take(take),
                "k": list_array(k.round(3).astype(np.float64).ravel(), np.arange(len(of) + 1) * len(names), pa.float64()),
            })

    sentences = written(train.mapInArrow(features, "doc_id long, toxic int, k array<double>"), "toxic-sentences")
    worst = Window.partitionBy("doc_id").orderBy(F.desc("margin"), F.hash("k"))
    chosen = sentences
    for turn in range(ROUNDS):
        distinct = written(chosen.groupBy("toxic", "k").agg(F.count("*").alias("n")), "toxic-distinct")
        there = {r["toxic"]: r["c"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("c")).collect()}  # two rows
        # Sentences of toxic documents come first; clean ones have what these leave of the bound, but half of it at least.
        most = {1: MOST_SENTENCES // 2, 0: max(MOST_SENTENCES // 2, MOST_SENTENCES - there.get(1, 0))}
        thinned = lambda side: F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.lit(min(1 << 20, (most[side] << 20) // max(1, there.get(side, 0))))
        rows = distinct.filter(F.when(F.col("toxic") == 1, thinned(1)).otherwise(thinned(0))).toArrow()  # about MOST_SENTENCES rows at most
        y, n = np.where(rows.column("toxic").to_numpy() == 1, 1.0, -1.0), rows.column("n").to_numpy().astype(np.float64)
        for side in (-1.0, 1.0):
            n[y == side] /= 2 * n[y == side].sum()
        w, b = support_vectors(matrix(rows.column("k"), len(names)) @ root, y, n)
        if turn + 1 == ROUNDS:
            break
        raw = root @ w
        dot = F.aggregate(F.zip_with("k", F.lit([float(x) for x in raw]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        scored = sentences.withColumn("margin", dot + F.lit(b))
        # The next fit takes all clean sentences, and of a toxic document the worst.
        bad = scored.filter("toxic = 1").withColumn("r", F.row_number().over(worst)).filter("r = 1 or margin > 1").drop("r", "margin")
        chosen = bad.unionByName(sentences.filter("toxic <> 1"))
    model = Model(marks, root @ w, b)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=8 << 20):
            seen = known.value.evidence(text)
            fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in batch.column(0).to_pylist()])
            yield pa.record_batch({"toxic": batch.column(2), "seen": list_array(seen.ravel(), np.arange(len(text) + 1) * EVIDENCE, pa.float64()), "fold": pa.array(fold, pa.int32())})

    rows = written(train.mapInArrow(evidence, "toxic int, seen array<double>, fold int"), "toxic-evidence").orderBy("fold", "seen").toArrow()  # most_docs rows of a few numbers
    seen, y, fold = matrix(rows.column("seen"), EVIDENCE), rows.column("toxic").to_numpy().astype(np.float64), rows.column("fold").to_numpy()
    model.slopes = logistic_fit(seen, y, *chosen_form(seen, y, fold))
    return model


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def form_of(seen: np.ndarray, n_words: int) -> np.ndarray:
    """Evidence with the margins of the n_words worst words alone."""
    out = seen.copy()
    out[:, n_words:WORST] = 0
    return out


def logistic_fit(seen: np.ndarray, y: np.ndarray, n_words: int, weight: float, ridge: float = 1e-4) -> np.ndarray:
    """Slopes and intercept of a logistic fit by Newton steps; toxic rows weigh `weight` times as much."""
    x = np.column_stack([form_of(seen, n_words), np.ones(len(seen))])
    w, each = np.zeros(x.shape[1]), np.where(y == 1, weight, 1.0) / len(y)
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-9)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((each * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (each * (p - y)) + penalty * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def chosen_form(seen: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[int, float]:
    """How many worst words decide and how much toxic documents weigh: of the forms that call at most FALSE_SHARE of the clean documents
    of left-out folds toxic, the one that finds most toxic ones; if there is none, the one with fewest errors by class. Ties go to the simplest."""
    best, found = (FORMS[0], WEIGHTS[0]), (-1, -np.inf)
    for n_words in FORMS:
        for weight in WEIGHTS:
            said = np.zeros(len(y), bool)
            for k in range(FOLDS):
                out = fold == k
                if out.any() and len(np.unique(y[~out])) == 2:
                    w = logistic_fit(seen[~out], y[~out], n_words, weight)
                    said[out] = form_of(seen[out], n_words) @ w[:-1] + w[-1] >= 0
            recall, wrong = said[y == 1].mean(), said[y == 0].mean()
            merit = (1, recall) if wrong <= FALSE_SHARE else (0, recall - wrong)
            if merit > found:
                best, found = (n_words, weight), merit
    return best


def scored(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row, from its text alone.

    Null and empty texts have the score of a text unlike all landmarks. Repeated rows have equal scores, whatever their
    id; null ids stay. Without both classes to learn from, every score is the share of toxic labels (0 without labels). An
    empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, text in slices(batches, most=12 << 20):
            out = np.full(len(text), own) if isinstance(own, float) else own.scores(text)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(out, pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; fitted on the labels of documents that aren't held out."""
    model = fitted(docs, labels.filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
