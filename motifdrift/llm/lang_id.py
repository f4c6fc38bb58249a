"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script (the Unicode ranges that most of its letters fall in) narrows the languages to those that were seen in that
script. The word gets a score for each of them: the log-likelihood of its character trigrams. Viterbi over the
words of a text then finds the labels of best total score, where each switch of language costs SWITCH. Runs of
one label are the spans of mixed-language text; the language of most letters is the document's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import held_out, thrifty
from motifdrift.llm.words import coded_words, slices

#: Script ranges, first and last code point. Letters elsewhere are script "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
OTHER = len(SCRIPTS)
#: Trigrams fall in so many buckets: a model has so many numbers of 4 bytes for each language that was learned.
BUCKETS = 1 << 15
#: Documents that a model is fitted on, about; a language belongs to a script from this share of the script's letters or of its own.
TRAIN_DOCS = 20_000
SCRIPT_SHARE = 0.005
#: In nats. A word of a few letters that favours another language doesn't switch; a sentence does.
SWITCH = 14.0
SMOOTH = 0.2
OUTSIDE = -60.0
UNKNOWN = "und"
#: Letters fall in so many buckets in the background, where neighbours don't depend on each other. Its counts follow those of trigrams and scripts.
LETTERS, AT_LETTERS = 1 << 12, BUCKETS + len(SCRIPTS) + 1
#: A text goes if its labels are less likely than the background by so many nats, and less than this share of its letters is in words that they explain better.
SURE, LEAST_TOLD = 12.0, 0.3
#: Texts of fewer letters are too short to tell by; they go only if their letters are of scripts that no language was learned in.
LEAST_LETTERS = 20
#: Bytes of text labelled at once with up to FEW languages; fewer with more, as each word has a score for each. Words that Viterbi takes one after another.
LABELLED_BYTES, FEW, BLOCK_WORDS = 8 << 20, 8, 1024
#: Bytes of text that are counted, or told from the background, at once: a worker holds some 50 times that, and small slices take no longer.
TOLD_BYTES = 1 << 20


@lru_cache(maxsize=1)
def letter_scripts() -> np.ndarray:
    """For each code point: -1 if it is no letter, else its script's number."""
    out = np.full(0x110000, -1, np.int8)
    out[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = OTHER
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = out[a : b + 1]
            part[part == OTHER] = k
    return out


def letter_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the letters of all words: bucket of the trigram around each, its word, its script; each word's letter count; and 3 x letters, the letter buckets of each trigram."""
    code = np.frombuffer(("\n" + "\n".join(words).lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(code == 10) - 1
    script = letter_scripts()[code]
    at = np.flatnonzero(script >= 0)
    x = code.astype(np.uint64)
    mix = x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 1] * np.uint64(0x165667B19E3779F9)
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mix >> np.uint64(64 - 15)).astype(np.int64)
    near = np.stack([code[at - 1] % LETTERS, code[at] % LETTERS, code[at + 1] % LETTERS]).astype(np.int16)
    return bucket, word[at], script[at], np.bincount(word[at], minlength=len(words))[: len(words)], near


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: log probabilities
    allowed: np.ndarray  # scripts x languages: bool
    background: np.ndarray  # LETTERS: log probabilities of single letters

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words x languages; letters of each word; and what the background gives each word. Words of no learned script say nothing for a language, and nothing against the background."""
        bucket, word, script, letters, near = letter_trigrams(words)
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        # Three letters by themselves, or any trigram as likely as another.
        apart = np.bincount(word, weights=np.maximum(self.background[near].sum(0), -np.log(BUCKETS)), minlength=len(words))
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            scores[word[first]] = np.add.reduceat(self.table[bucket], first, axis=0)
            counts = np.bincount(word * (OTHER + 1) + script, minlength=len(words) * (OTHER + 1)).reshape(-1, OTHER + 1)
            allowed = self.allowed[counts.argmax(1)]
            seen = allowed.any(1) & (letters > 0)
            scores = np.where(seen[:, None], scores + np.where(allowed, 0, OUTSIDE).astype(np.float32), 0)
            apart = np.where(seen, apart, -OUTSIDE * (letters > 0))
        return scores, letters, apart

    def slice_bytes(self) -> int:
        return max(64 << 10, LABELLED_BYTES * FEW // max(FEW, len(self.languages)))


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; scores: words x languages. Texts are cut into blocks that advance side by side, a word of each a step.

    A first pass, over texts of several blocks, finds what every label before a block comes to at its end; chained, that is the
    state that each block begins with, and the second pass is Viterbi from there. A text takes some thousand steps, however long it is.
    """
    n_words, n_labels = scores.shape
    if not n_words or n_labels == 1:
        return np.zeros(n_words, np.int16)
    offsets = offsets[np.flatnonzero(np.diff(offsets, prepend=-1))]  # texts without words are no texts here
    size = max(BLOCK_WORDS, int(np.sqrt(np.diff(offsets).max())))
    n_blocks = -(-np.diff(offsets) // size)
    text = np.repeat(np.arange(len(n_blocks)), n_blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = offsets[text] + number * size
    length = np.minimum(size, offsets[text + 1] - start)
    last = number == n_blocks[text] - 1
    before = np.zeros((len(text), n_labels), np.float32)
    inner = np.flatnonzero(~last)
    for b, through in zip(inner.tolist(), block_transfers(scores, start[inner], size, switch), strict=True):
        state = (before[b][:, None] + through).max(0)
        before[b + 1] = state - state.max()
    order = np.argsort(-length, kind="stable")
    first, active = start[order], np.searchsorted(-length[order], -np.arange(length.max()), side="left")  # blocks longer than t
    back = np.zeros((n_words, n_labels), np.int16)
    own = np.arange(n_labels, dtype=np.int16)[None, :]
    best = before[order]
    for t, a in enumerate(active.tolist()):
        at, now = first[:a] + t, best[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top][:, None] - np.float32(switch)
        back[at] = np.where(now >= jump, own, top[:, None].astype(np.int16))
        now = np.maximum(now, jump) + scores[at]
        best[:a] = now - now.max(1, keepdims=True)
    # Backwards, each label at the end of a block leads to one at every word of it, and to one before it.
    path, route = np.zeros((n_words, n_labels), np.int16), np.repeat(own, len(order), axis=0)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        path[at] = route[:a]
        route[:a] = np.take_along_axis(back[at], route[:a].astype(np.int64), 1)
    placed = np.argsort(order, kind="stable")
    end, route = best[placed].argmax(1), route[placed]
    for b in inner[::-1].tolist():
        end[b] = route[b + 1, end[b + 1]]
    return path[np.arange(n_words), np.repeat(end, length)]


def block_transfers(scores: np.ndarray, start: np.ndarray, size: int, switch: float) -> np.ndarray:
    """blocks x labels before x labels at the end: the best score on the way, over blocks of so many words."""
    n = scores.shape[1]
    if not len(start):
        return np.zeros((0, n, n), np.float32)
    off = np.full((n, n), -np.float32(switch), np.float32)
    np.fill_diagonal(off, 0)
    now = np.broadcast_to(off, (len(start), n, n)) + scores[start][:, None, :]
    for t in range(1, size):
        now = np.maximum(now, now.max(2, keepdims=True) - np.float32(switch)) + scores[start + t][:, None, :]
    return now


def fitted(docs: DataFrame, most_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of text and non-null lang of docs (doc_id, text, lang); None without any letter. Rows are sampled down to about most_docs."""
    labelled = docs.filter("lang is not null").select("text", "lang")
    n = labelled.count()
    if n > most_docs:
        labelled = labelled.sample(most_docs / n, seed=3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch, text in slices(batches, most=TOLD_BYTES):
            langs = batch.column(1).to_pylist()
            codes, distinct, offsets = coded_words(text)
            bucket, word, script, _, near = letter_trigrams(distinct)
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                times = np.bincount(codes[mine], minlength=len(distinct)).astype(np.float64)
                total = totals.setdefault(lang, np.zeros(AT_LETTERS + LETTERS))
                total += np.bincount(bucket, weights=times[word], minlength=len(total))
                total += np.bincount(BUCKETS + script.astype(np.int64), weights=times[word], minlength=len(total))
                for letter in near:
                    total += np.bincount(AT_LETTERS + letter.astype(np.int64), weights=times[word], minlength=len(total))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[at].astype(np.int64))})

    counts = labelled.mapInArrow(thrifty(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # languages x (buckets, scripts and letters) rows at most
    if not rows.num_rows:
        return None
    languages = sorted(set(rows.column("lang").to_pylist()))
    dense = np.zeros((AT_LETTERS + LETTERS, len(languages)))
    dense[rows.column("bucket").to_numpy(), np.searchsorted(np.array(languages, object), np.array(rows.column("lang").to_pylist(), object))] = rows.column("n").to_numpy()
    grams, scripts, alone = dense[:BUCKETS], dense[BUCKETS:AT_LETTERS], dense[AT_LETTERS:].sum(1)
    table = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)
    share = np.maximum(scripts / np.maximum(1, scripts.sum(1, keepdims=True)), scripts / np.maximum(1, scripts.sum(0)))
    return Model(languages, table, (share >= SCRIPT_SHARE) & (scripts > 0), np.log((alone + SMOOTH) / (alone.sum() + SMOOTH * LETTERS)))


def label_texts(text: pa.Array, model: Model | None, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label of each word; letters of each text by label; where each text's words start and end. Without a model all letters are of no label."""
    codes, distinct, offsets = coded_words(text)
    if model is None:
        return np.zeros(len(codes), np.int16), np.zeros((len(text), 1)), offsets
    scores, letters, _ = model.word_scores(distinct)
    labels = viterbi(scores[codes], offsets, switch)
    owner, n = np.repeat(np.arange(len(text)), np.diff(offsets)), len(model.languages)
    return labels, np.bincount(owner * n + labels, weights=letters[codes], minlength=len(text) * n).reshape(-1, n), offsets


RESULT = "doc_id long, lang_pred string, score double, n_words long, spans array<struct<first:int,last:int,lang:string>>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))


def labelled_spans(docs: DataFrame, model: Model | None, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: lang_pred, score (share of the letters that its spans hold), n_words, spans (first and last word, language).

    'und' with score 0 and no span if the text is null or has no letter, or nothing was learned. Ties go to the first language by
    name. Words without letters, and those in scripts no language was seen in, take the language around them. Rows that
    repeat, null ids and other columns change nothing; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, text in slices(batches, most=own.slice_bytes() if own else LABELLED_BYTES):
            labels, mass, offsets = label_texts(text, own, switch)
            n_docs = len(text)
            owner = np.repeat(np.arange(n_docs), np.diff(offsets))
            total, top = mass.sum(1), mass.argmax(1)
            some = total > 0
            names = np.array((own.languages if own else [UNKNOWN]) + [UNKNOWN], object)
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
            new &= some[owner]
            first = np.flatnonzero(new)
            ends = np.append(first, len(labels))[1:]
            ends = np.minimum(ends, offsets[owner[first] + 1])
            span = pa.StructArray.from_arrays(
                [pa.array(first - offsets[owner[first]], pa.int32()), pa.array(ends - 1 - offsets[owner[first]], pa.int32()), pa.array(names[labels[first]], pa.string())], ["first", "last", "lang"]
            )
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n_docs))])
            yield pa.record_batch({
                "doc_id": batch.column(0), "lang_pred": pa.array(names[np.where(some, top, -1)], pa.string()),
                "score": pa.array(np.where(some, mass[np.arange(n_docs), top] / np.maximum(total, 1), 0.0)),
                "n_words": pa.array(np.diff(offsets)), "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), span).cast(SPANS),
            })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, RESULT)


def fitted_on_train(docs: DataFrame) -> Model | None:
    """The model of the documents that aren't held out."""
    return fitted(docs.filter(~held_out()).select("doc_id", "text", "lang"))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the number of language spans."""
    return labelled_spans(docs, fitted_on_train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def told_by_labels(text: pa.Array, model: Model, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its letters, those in words that the Viterbi label explains better than the background does, by how many nats all its labels do, and its letters in words of learned scripts."""
    codes, distinct, offsets = coded_words(text)
    scores, letters, apart = model.word_scores(distinct)
    labels = viterbi(scores[codes], offsets, switch)
    gain = scores[codes, labels] - apart[codes]
    owner = np.repeat(np.arange(len(text)), np.diff(offsets))
    return tuple(np.bincount(owner, weights=w, minlength=len(text)) for w in (letters[codes], np.where(gain > 0, letters[codes], 0), gain, np.where(apart <= 0, letters, 0)[codes]))


def identified(docs: DataFrame, model: Model | None, sure: float = SURE, least_told: float = LEAST_TOLD) -> DataFrame:
    """The rows of docs whose language can be told by the labels of their words.

    A text goes if it has no letter; if less than least_told of its letters are in words of scripts that a language was learned in; or if a background in which letters don't depend on their neighbours explains it better than the languages of its
    Viterbi labels do, by `sure` nats, less than least_told of its letters are in words where a label does better, and it has LEAST_LETTERS letters. So languages go that nobody has labelled,
    in any script, and random letters; texts of several learned languages stay, however evenly they are mixed, and so do texts too short to tell. If
    nothing was learned, every text with a letter stays. All columns stay; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, text in slices(batches, most=min(TOLD_BYTES, own.slice_bytes()) if own else TOLD_BYTES):
            if own is None:
                codes, distinct, offsets = coded_words(text)
                letters = np.bincount(np.repeat(np.arange(len(text)), np.diff(offsets)), weights=letter_trigrams(distinct)[3][codes], minlength=len(text))
                yield batch.filter(pa.array(letters > 0))
                continue
            letters, told, gain, known = told_by_labels(text, own)
            stays = (letters < LEAST_LETTERS) | (gain > -sure) | (told >= least_told * letters)
            yield batch.filter(pa.array((letters > 0) & (known >= least_told * letters) & stays))

    return docs.mapInArrow(thrifty(keep), docs.schema)
