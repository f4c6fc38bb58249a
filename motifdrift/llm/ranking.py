"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of its features. Of two documents, the one labelled 1 is preferred to the one labelled 0 with probability
sigmoid(difference of strengths); the weights minimise the logistic loss of that on differences of features, over all pairs of labelled documents
of unlike labels. A quantile of the strengths of all labelled documents is the threshold, and the score is the probability of being preferred to a document there.

Neither documents nor pairs are drawn. A document meets all others through sums at the nodes of a grid of strengths, which each pass over the features
adds up by task: what a smooth function of strengths comes to over all documents is told by the sums at four nodes around each (cubic interpolation,
off by 1e-6 at most). So a pass is linear in the documents, however many pairs they make.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import held_out, written
from motifdrift.llm.words import coded_word_array, list_array, slices, word_hashes
from motifdrift.operators.ordered import falling_totals

#: Nodes of strengths lie so far apart; so many of them, of one label, are added up as one row.
GRID, NODES = 0.125, 32
#: Rows of features that a pass handles at once, and rows of second derivatives that are added up as one.
CHUNK, BEND_ROWS = 2048, 16
#: Shares of words in so many hashed buckets are features too.
BUCKETS = 128
RIDGE = 1e-2
#: A text of so many words counts for half of what it shows.
SHRINK = 6
#: Standardised features beyond this count as it.
MOST = 5.0
STYLE = (
    "words", "letters_a_word", "letter_share", "capital_share", "digit_share", "mark_share", "doubled_ends", "bare_marks", "capitalised",
    "long_words", "distinct_words", "commonest_word", "distinct_pairs", "words_a_line", "repeated_lines", "short_lines",
)
WIDTH = len(STYLE) + BUCKETS
OTHER, LOWER, UPPER, DIGIT, MARK = range(5)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point: capital, other letter, digit, mark, or anything else."""
    by = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT}
    of = (by.get(c, LOWER if c[0] in "LM" else MARK if c[0] in "PS" else OTHER) for c in (unicodedata.category(chr(i)) for i in range(0x110000)))
    return np.fromiter(of, np.int8, 0x110000)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(1, whole)


def word_traits(words: pa.Array) -> dict[str, np.ndarray]:
    """Counts of kinds of characters in each word, and whether it begins with a capital or ends in the same mark twice."""
    code = np.frombuffer(("\n" + "\n".join(words.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(code == 10)  # words have no line break
    kind, word, n = kinds()[code], np.cumsum(code == 10) - 1, len(words)
    count = lambda k: np.bincount(word[kind == k], minlength=n)[:n].astype(np.float64)
    out = {"upper": count(UPPER), "digit": count(DIGIT), "mark": count(MARK), "lower": count(LOWER), "length": (np.diff(breaks) - 1).astype(np.float64)}
    first, last = breaks[:-1] + 1, breaks[1:] - 1
    out["capital"] = (kind[first] == UPPER).astype(np.float64)
    out["doubled"] = ((kind[last] == MARK) & (code[last] == code[last - 1])).astype(np.float64)
    return out


def runs(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: how many distinct keys it has, and how often its commonest."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(owner) else np.zeros(0, np.int64)
    times, most = np.diff(np.append(at, len(owner))), np.zeros(n)
    np.maximum.at(most, owner[at], times)
    return np.bincount(owner[at], minlength=n).astype(np.float64), most


def features(text: pa.Array) -> np.ndarray:
    """texts x WIDTH, from whole texts. A text without words has zeros."""
    n = len(text)
    codes, distinct, offsets = coded_word_array(text)
    owner, n_words = np.repeat(np.arange(n), np.diff(offsets)), np.diff(offsets).astype(np.float64)
    out = np.zeros((n, WIDTH))
    if not len(codes):
        return out
    trait = word_traits(distinct)
    total = lambda of: np.bincount(owner, weights=of[codes], minlength=n)
    length, upper, letters = total(trait["length"]), total(trait["upper"]), total(trait["upper"] + trait["lower"])
    kinds_of_word, commonest = runs(owner, codes, n)
    same = owner[1:] == owner[:-1]
    pairs, _ = runs(owner[1:][same], (codes[:-1].astype(np.int64) * len(distinct) + codes[1:])[same], n)
    lines = pc.split_pattern(text, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    n_lines = np.diff(line_at).astype(np.float64)
    flat = lines.flatten()
    of_line = np.repeat(np.arange(n), np.diff(line_at))
    different, _ = runs(of_line, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False), n)
    short = np.bincount(of_line, weights=pc.utf8_length(flat).to_numpy(zero_copy_only=False) < 20, minlength=n)
    out[:, : len(STYLE)] = np.column_stack([
        np.log1p(n_words), share(letters, n_words), share(letters, length), share(upper, letters), share(total(trait["digit"]), length), share(total(trait["mark"]), length),
        share(total(trait["doubled"]), n_words), share(total((trait["upper"] + trait["lower"] + trait["digit"] == 0).astype(float)), n_words), share(total(trait["capital"]), n_words),
        share(total((trait["length"] > 20).astype(float)), n_words), share(np.log1p(kinds_of_word), np.log1p(n_words)), share(commonest, n_words),
        share(pairs, np.maximum(0, n_words - 1)), np.log1p(share(n_words, n_lines)), 1 - share(different, n_lines), share(short, n_lines),
    ])
    plain = pc.utf8_trim(pc.ascii_lower(distinct), characters="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    bucket = (word_hashes(plain.to_pylist()) % np.uint64(BUCKETS)).astype(np.int64)
    out[:, len(STYLE) :] = np.sqrt(share(np.bincount(owner * BUCKETS + bucket[codes], minlength=n * BUCKETS).reshape(n, BUCKETS), n_words[:, None]))
    out[n_words == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that they don't depend on what else is in a batch."""
        return np.round(standard(x, self.mean, self.scale) @ self.weights, 9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.threshold, -500, 500)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features. Those of short texts shrink towards the mean, as a few words show little; the first, the length, does not."""
    out, n_words = np.clip((x - mean) / scale, -MOST, MOST), np.expm1(x[:, :1])
    out[:, 1:] *= n_words / (n_words + SHRINK)
    return out


def preference_pairs(y: np.ndarray, opponents: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are preferred, and rows that they are preferred to: each row meets so many of the other label, drawn evenly. For small arrays; fitted() takes all pairs."""
    rng, good, bad = np.random.default_rng(seed), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    return (
        np.concatenate([np.repeat(good, opponents), rng.choice(good, len(bad) * opponents)]),
        np.concatenate([rng.choice(bad, len(good) * opponents), np.repeat(bad, opponents)]),
    )


def ranked(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least logistic loss over the listed pairs of small arrays, by Newton steps that never raise it; what ranked_in_passes() is tested against."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -(x[better] - x[worse]) @ w).mean() + ridge / 2 * (w @ w)
    for _ in range(50):
        slope, bend = ridge * w, ridge * np.eye(len(w))
        for a in range(0, len(better), 1 << 14):
            d = x[better[a : a + (1 << 14)]] - x[worse[a : a + (1 << 14)]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the pair turning out otherwise
            slope = slope - d.T @ p / len(better)
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / len(better)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def best_quantile(strength: np.ndarray, y: np.ndarray) -> float:
    """The level between two neighbouring strengths that tells the labels apart best (mean of both labels' shares); of equal ones, the one nearest to the share of 0. For small arrays; what best_threshold() is tested against."""
    order = np.argsort(strength, kind="stable")
    zeros = np.concatenate([[0], np.cumsum(y[order] == 0)])
    below = np.arange(len(y) + 1)
    merit = zeros / zeros[-1] + 1 - (below - zeros) / (len(y) - zeros[-1])
    ties = np.flatnonzero(np.diff(strength[order]) <= 0) + 1
    merit[ties] = -1  # no threshold parts equal strengths
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    at = best[np.abs(best - zeros[-1]).argmin()]
    return float(np.clip((at - 0.5) / (len(y) - 1), 0, 1))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (features of the whole text) of every row of docs (doc_id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, most=8 << 20):
            x = features(text).astype(np.float32)
            yield pa.record_batch({"doc_id": batch.column(0), "x": list_array(x.ravel(), np.arange(len(x) + 1) * WIDTH, pa.float32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, x array<float>")


def training_rows(docs: DataFrame, labels: DataFrame, most_docs: int | None = None) -> DataFrame:
    """doc_id, quality, x (features) of all labelled documents, or of about most_docs. A document with several labels has the least; equal rows count once.

    docs has doc_id and text, or x in its place.
    """
    some = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    if most_docs is not None and (n := some.count()) > most_docs:
        some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit((most_docs << 20) // n))
    rows = docs if "x" in docs.columns else measured(docs)
    return rows.join(some, "doc_id").select("doc_id", "quality", "x").distinct()


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def sums(rows: DataFrame, step: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sum over all rows (quality, x) of the arrays that step makes, by key, of chunks of features and labels. A task has a row for each key, and few keys come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                for key, value in step(matrix(part.column("x")), part.column("quality").to_numpy()).items():
                    totals[key] = totals[key] + value.ravel() if key in totals else value.ravel()
        for key, total in totals.items():
            yield pa.record_batch({"key": pa.array([key], pa.int64()), "v": list_array(total, np.array([0, len(total)]), pa.float64())})

    def add(part: pa.Table) -> pa.Table:
        values = part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        total = np.sort(values, axis=0).sum(0)  # in an order that doesn't depend on which task came first
        return pa.table({"key": part.column("key").slice(0, 1), "v": list_array(total, np.array([0, len(total)]), pa.float64())})

    added = rows.select("quality", "x").mapInArrow(run, "key long, v array<double>").groupBy("key").applyInArrow(add, "key long, v array<double>").toArrow()
    return {k: np.array(v) for k, v in zip(added.column("key").to_pylist(), added.column("v").to_pylist(), strict=True)}


def nodes_of(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4 x rows: the nodes around each strength, and their weights in cubic interpolation."""
    at = np.floor(strength / GRID)
    t = strength / GRID - at
    weight = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])
    return at.astype(np.int64) + np.arange(-1, 3)[:, None], weight


@dataclass
class Meetings:
    """All pairs of unlike labels at some weights, by the nodes of each label (0, 1): numbers of documents and sums of their features there."""

    node: list[np.ndarray]
    count: list[np.ndarray]
    total: list[np.ndarray]
    pairs: float

    @classmethod
    def at(cls, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Meetings:
        def place(raw: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
            x, out = standard(raw, mean, scale), {}
            for label in np.unique(y):
                own = x[y == label]
                node, weight = nodes_of(own @ w)
                there, inverse = np.unique(node, return_inverse=True)
                dealt = np.zeros((len(there), len(own)))
                np.add.at(dealt, (inverse.reshape(node.shape), np.arange(len(own))[None, :]), weight)
                held = np.column_stack([dealt.sum(1), dealt @ own])
                for block in np.unique(there // NODES):
                    mine = there // NODES == block
                    value = out[2 * int(block) + int(label)] = np.zeros((NODES, 1 + WIDTH))
                    value[there[mine] % NODES] = held[mine]
            return out

        found, node, count, total = sums(rows, place), [], [], []
        for label in (0, 1):
            keys = sorted(k for k in found if k % 2 == label)
            held = np.concatenate([found[k].reshape(NODES, 1 + WIDTH) for k in keys])
            node.append(np.concatenate([k // 2 * NODES + np.arange(NODES) for k in keys]))
            count.append(held[:, 0])
            total.append(held[:, 1:])
        return cls(node, count, total, count[0].sum() * count[1].sum())

    def chance(self, a: int, b: int, at: np.ndarray | None = None) -> np.ndarray:
        """Nodes of label a (or at) x nodes of label b: how likely a document of label 0 is preferred to one of label 1."""
        ahead = ((self.node[a] if at is None else at)[:, None] - self.node[b][None, :]) * GRID * (1 if a == 1 else -1)
        return 1 / (1 + np.exp(np.clip(ahead, -500, 500)))

    def loss(self) -> float:
        ahead = (self.node[1][:, None] - self.node[0][None, :]) * GRID
        return float(self.count[1] @ np.logaddexp(0, -ahead) @ self.count[0] / self.pairs)

    def slope(self) -> np.ndarray:
        p = self.chance(1, 0)
        return ((self.count[1] @ p) @ self.total[0] - (p @ self.count[0]) @ self.total[1]) / self.pairs

    def bend(self, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Second derivatives: those of a document with itself take a pass, the mixed ones are in the sums at the nodes."""
        low = [n.min() - 2 for n in self.node]
        tables = []
        for label in (0, 1):
            p = self.chance(label, 1 - label, np.arange(low[label], self.node[label].max() + 3))
            tables.append((p * (1 - p)) @ self.count[1 - label])

        def own(raw: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
            x = standard(raw, mean, scale)
            node, weight = nodes_of(x @ w)
            size = np.zeros(len(x))
            for label in (0, 1):
                mine = y == label
                size[mine] = (tables[label][np.clip(node[:, mine] - low[label], 0, len(tables[label]) - 1)] * weight[:, mine]).sum(0)
            whole = (x * size[:, None]).T @ x
            return {i: whole[i : i + BEND_ROWS] for i in range(0, WIDTH, BEND_ROWS)}

        found, p = sums(rows, own), self.chance(1, 0)
        mixed = self.total[1].T @ (p * (1 - p)) @ self.total[0]
        return (np.concatenate([found[i].reshape(-1, WIDTH) for i in sorted(found)]) - mixed - mixed.T) / self.pairs


def ranked_in_passes(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least logistic loss over all pairs of rows (quality, x) of unlike labels, by Newton steps that never raise it: two passes a step."""
    w = np.zeros(WIDTH)
    now = Meetings.at(rows, mean, scale, w)
    for _ in range(50):
        step, size = np.linalg.solve(now.bend(rows, mean, scale, w) + ridge * np.eye(WIDTH), now.slope() + ridge * w), 1.0
        before = now.loss() + ridge / 2 * (w @ w)
        while True:
            to = w - size * step
            now = Meetings.at(rows, mean, scale, to)
            if size < 1e-6 or now.loss() + ridge / 2 * (to @ to) <= before + 1e-6:  # the grid's own error
                break
            size /= 2
        w = to
        if np.abs(size * step).max() < 1e-4:
            break
    return np.round(w, 6)  # so that the order of additions changes nothing


def best_threshold(told: DataFrame, ranges: int | None = None) -> float:
    """best_quantile()'s level as a strength, of all rows (strength, quality), which are sorted and counted in range partitions."""
    by = told.groupBy("strength").agg(F.sum(F.expr("int(quality = 0)")).alias("zeros"), F.sum(F.expr("int(quality = 1)")).alias("ones"))
    upto = falling_totals(by, "strength", ["zeros", "ones"], ranges)
    below = F.col("zeros_all") + F.col("ones_all") - F.col("zeros_upto") - F.col("ones_upto")
    merit = (F.col("zeros_all") - F.col("zeros_upto")) / F.col("zeros_all") + F.col("ones_upto") / F.col("ones_all")
    cuts = written(upto.select("strength", "zeros_all", (F.col("zeros_all") + F.col("ones_all")).alias("n"), below.alias("below"), merit.alias("merit")), "quality-cuts")
    best = cuts.agg(F.max("merit")).first()[0]
    away = F.abs(F.col("below") - F.col("zeros_all"))
    at = cuts.filter(F.col("merit") >= F.lit(best - 1e-12)).orderBy(away, "below").first()
    # Above all strengths, the shares are 1 and 0.
    if best <= 1 + 1e-12 and at.n - at.zeros_all < abs(at.below - at.zeros_all):
        return cuts.agg(F.max("strength")).first()[0]
    last = cuts.filter(F.col("strength") < F.lit(at.strength)).agg(F.max("strength")).first()[0]
    return at.strength if last is None else (last + at.strength) / 2


def fitted(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model of all docs (doc_id, text or x) that labels (doc_id, quality) tell of; only the share of label 1 if there are not both labels."""
    rows = written(training_rows(docs, labels), "quality-rows")
    moments = sums(rows, lambda x, y: {0: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]).astype(np.float64)})
    if not moments:
        return 0.0
    n, ones, of = moments[0][0], moments[0][1], moments[0][2:].reshape(2, WIDTH) / moments[0][0]
    if ones in (0, n):
        return float(ones / n)
    mean, scale = np.round(of[0], 9), np.round(np.maximum(np.sqrt(np.maximum(0, of[1] - of[0] ** 2)), 1e-3), 9)
    model = Model(mean, scale, ranked_in_passes(rows, mean, scale), 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"strength": pa.array(model.strengths(matrix(batch.column("x")))), "quality": batch.column("quality")})

    model.threshold = best_threshold(rows.select("quality", "x").mapInArrow(strengths, "strength double, quality int"))
    return model


def scored(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row, from its whole text alone, or from its features x, if they are there in place of texts.

    Null counts as empty, and texts without words share one score. Repeated rows have equal scores, null ids stay. Without both labels to
    learn from, every score is the share of label 1 (0 without labels). An empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, own) if isinstance(own, float) else own.scores(matrix(batch.column("x")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(out, pa.float64())})

    rows = docs if text_col not in docs.columns and "x" in docs.columns else measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), score, predicted; fitted on the labels of documents that aren't held out. Features are taken once, and written."""
    out, rows = held_out(of=3, rest=1), written(measured(docs), "quality-features")
    model = fitted(rows, labels.filter(~out).select("doc_id", "quality"))
    return scored(rows, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
