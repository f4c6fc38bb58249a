"""Alignment of the tokens of two tokenizers on whole texts, by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. An interval of tokens is halved at an end that both have, the nearest to its middle, found by bisecting one
tokenizer's ends for those of the other; both halves go on alike. Intervals without a cut inside are the leaf groups. All intervals of
all texts of a slice are halved side by side, so a slice takes some log2(tokens) turns. Tokens whose bytes overlap are linked; how many documents hold
a pair of ids linked is counted over the whole corpus, and each document's links are then valued by these counts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import written
from motifdrift.llm.words import binary_rows, list_array, slices

#: Bytes of text aligned at once; segments whose tokens a Python worker remembers; segments that the tokenizers get at once.
ALIGNED_BYTES, REMEMBERED, AT_ONCE = 4 << 20, 400_000, 4_096
#: Counts of so many pairs are sent to all tasks, the most frequent ones; documents meet the others by a shuffle. 20 bytes each.
MOST_SENT = 2_000_000
#: Pairs counted in a task before they are handed on.
COUNTED = 1 << 21
BLANK = "▁"
#: A blank between two such characters begins a token in both tokenizers. Others may too; these surely do.
SAFE = r"[!-~\p{L}\p{N}]"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Token ids of a segment (a blank and what follows) under two tokenizers, remembered by segment.

    The byte-level one never joins what a single blank between letters or marks separates, nor does the piece model if no
    piece has a blank after another character. Other tokenizers get whole texts as one segment.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte = byte_letters()
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (names[-1][1] + 1)
        for w, i in names:
            self.bytes_a[i] = bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        self.by_segment = (
            told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        )
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.zeros(0, bool)

    def alone(self, segments: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both tokenizers, joined; how many each segment has; and whether both give it back."""
        both = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)], self.b.encode(segments, num_threads=1)  # b adds the blank itself
        same = [b"".join([self.bytes_a[i] for i in x]) == b"".join([self.bytes_b[i] for i in y]) == b" " + s.encode() for s, x, y in zip(segments, *both, strict=True)]
        ids = [np.fromiter(chain.from_iterable(lists), np.int64) for lists in both]
        return ids, [np.fromiter(map(len, lists), np.int64, len(lists)) for lists in both], np.array(same, bool)

    def together(self, segments: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The same for segments that begin and end in SAFE: one text of all, cut where segments end."""
        text = " " + " ".join(segments)
        ids = [np.array(x, np.int64) for x in (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]))]
        raw = text.encode()
        if not all(b"".join([table[i] for i in x.tolist()]) == raw for x, table in zip(ids, (self.bytes_a, self.bytes_b), strict=True)):
            return self.alone(segments)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        at = [np.searchsorted(np.cumsum(n[x]), ends) + 1 for x, n in zip(ids, self.lengths, strict=True)]
        return ids, [np.diff(x, prepend=0) for x in at], np.ones(len(segments), bool)

    def learn(self, segments: list[str]) -> None:
        both_safe = pc.match_substring_regex(pa.array(segments, pa.string()), rf"(?s)^{SAFE}(.*{SAFE})?\z").to_numpy(zero_copy_only=False) & self.by_segment
        names, ids, counts, same = [], ([], []), ([], []), []
        for some, encode in ((np.flatnonzero(both_safe), self.together), (np.flatnonzero(~both_safe), self.alone)):
            for at in range(0, len(some), AT_ONCE):
                part = [segments[i] for i in some[at : at + AT_ONCE].tolist()]
                got, n, good = encode(part)
                names += part
                same.append(good)
                for k in (0, 1):
                    ids[k].append(got[k])
                    counts[k].append(n[k])
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.whole = np.concatenate([self.whole, *same])
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], *ids[k]])
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(np.concatenate(counts[k]))])

    def numbers(self, names: list[str]) -> np.ndarray:
        """The numbers of segments, learned if new. One that repeats is learned once."""
        if new := [s for s in names if s not in self.known]:
            self.learn(list(dict.fromkeys(new)))
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def segments(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the segments of all texts, and where each text's start and end."""
        if not self.by_segment:
            return self.numbers(text.to_pylist()), np.arange(len(text) + 1)
        lists = pc.split_pattern(text, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        begins, ends = (pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)[code] for pattern in ("^" + SAFE, SAFE + r"\z"))
        new = np.ones(len(flat), bool)
        new[1:] = begins[1:] & ends[:-1]
        new[offsets[:-1]] = True  # no text is without a piece
        first = np.flatnonzero(new)
        number = np.concatenate([[0], np.cumsum(new)])
        several = np.diff(np.append(first, len(flat))) > 1
        used = np.unique(code[first[~several]])
        known = np.zeros(len(distinct), np.int64)
        known[used] = self.numbers(distinct.take(pa.array(used)).to_pylist())
        out = known[code[first]]
        if several.any():
            inside = np.repeat(several, np.diff(np.append(first, len(flat))))
            at = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(flat)))[several])])
            out[several] = self.numbers(pc.binary_join(list_array_of(at, flat.filter(pa.array(inside))), " ").to_pylist())
        return out, number[offsets]

    def encode(self, text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers: ids of all texts, and where each text's start and end. A text that is empty or that one of them doesn't give back has none."""
        if len(self.known) > REMEMBERED:
            self.forget()
        number, offsets = self.segments(text)
        owner = np.repeat(np.arange(len(text)), np.diff(offsets))
        good = (np.bincount(owner[~self.whole[number]], minlength=len(text)) == 0) & (pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
        number, owner = number[good[owner]], owner[good[owner]]
        out = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            n = starts[number + 1] - starts[number]
            at = np.repeat(starts[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((ids[at], np.concatenate([[0], np.cumsum(np.bincount(owner, weights=n, minlength=len(text)))]).astype(np.int64)))
        return out


def list_array_of(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@lru_cache(maxsize=1)
def tokens_of(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


def cut_near_middle(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For intervals of A's tokens lo to hi - 1 that begin at a byte: the token inside whose end B has too, nearest to the middle; -1 if there is none.

    Around the middle, windows of doubling width are searched in B's ends until one holds a cut or the interval is used up.
    """
    out = np.full(len(lo), -1, np.int64)
    middle = np.clip(np.searchsorted(ends_a, (begin + ends_a[hi - 1]) // 2), lo, np.maximum(lo, hi - 2))
    open_, near, far = np.flatnonzero(hi - lo > 1), 0, 0
    while len(open_):
        mid, first, last = middle[open_], lo[open_], hi[open_] - 2
        # Tokens between near and far away from the middle, on both sides.
        sides = [(np.maximum(first, mid - far), np.minimum(mid - near, last)), (np.maximum(mid + max(near, 1), first), np.minimum(mid + far, last))]
        n = np.maximum(0, np.stack([b - a + 1 for a, b in sides], 1))
        start, n = np.stack([a for a, _ in sides], 1).ravel(), n.ravel()
        of = np.repeat(np.arange(len(n)), n)
        token = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        end = ends_a[token]
        hit = ends_b[np.minimum(np.searchsorted(ends_b, end), len(ends_b) - 1)] == end
        token, interval = token[hit], of[hit] // 2
        order = np.lexsort((np.abs(token - mid[interval]), interval))
        one, at = np.unique(interval[order], return_index=True)
        out[open_[one]] = token[order][at]
        left = np.ones(len(open_), bool)
        left[one] = False
        left &= (mid - far > first) | (mid + far < last)
        open_, near, far = open_[left], far + 1, 2 * far + 2
    return out


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first A and the first B token of each group, ascending. Ends are bytes over all texts, one after another; at_a and at_b: where each text's tokens start and end."""
    some = np.diff(at_a) > 0
    lo_a, hi_a, lo_b, hi_b = at_a[:-1][some], at_a[1:][some], at_b[:-1][some], at_b[1:][some]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo_a):
        begin = np.where(lo_a > 0, ends_a[lo_a - 1], 0)
        cut = cut_near_middle(ends_a, ends_b, lo_a, np.where(hi_b - lo_b > 1, hi_a, lo_a + 1), begin)
        leaf = cut < 0
        leaves.append((lo_a[leaf], lo_b[leaf]))
        cut, lo_a, hi_a, lo_b, hi_b = (x[~leaf] for x in (cut, lo_a, hi_a, lo_b, hi_b))
        mid_a, mid_b = cut + 1, np.searchsorted(ends_b, ends_a[cut]) + 1
        halves = [np.stack(pair, 1).ravel() for pair in ((lo_a, mid_a), (mid_a, hi_a), (lo_b, mid_b), (mid_b, hi_b))]
        lo_a, hi_a, lo_b, hi_b = halves
    first_a, first_b = (np.sort(np.concatenate(x)) if leaves else np.zeros(0, np.int64) for x in zip(*leaves, strict=True)) if leaves else (np.zeros(0, np.int64),) * 2
    return first_a, first_b


def group_links(first_a: np.ndarray, first_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token of every link: two tokens whose bytes overlap. Within a group, each stretch between two neighbouring ends is one."""
    n_a, n_b = np.diff(np.append(first_a, len(ends_a))), np.diff(np.append(first_b, len(ends_b)))
    flat = (n_a == 1) | (n_b == 1)
    n = np.maximum(n_a, n_b)[flat]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(first_a[flat], n) + np.minimum(step, np.repeat(n_a[flat] - 1, n))
    b = np.repeat(first_b[flat], n) + np.minimum(step, np.repeat(n_b[flat] - 1, n))
    ends = np.unique(np.concatenate([ends_a[np.repeat(~flat, n_a)], ends_b[np.repeat(~flat, n_b)]]))
    return np.concatenate([a, np.searchsorted(ends_a, ends)]), np.concatenate([b, np.searchsorted(ends_b, ends)])


class Aligned:
    """Both tokenizers' ids, groups and links of the texts of a slice. first_a and first_b: the first token of each group."""

    def __init__(self, text: pa.Array, tokens: Tokens):
        (self.a, self.at_a), (self.b, self.at_b) = tokens.encode(text)
        self.ends_a, self.ends_b = np.cumsum(tokens.lengths[0][self.a]), np.cumsum(tokens.lengths[1][self.b])
        self.first_a, self.first_b = leaf_groups(self.ends_a, self.ends_b, self.at_a, self.at_b)
        self.at_group = np.searchsorted(self.first_a, self.at_a)
        self.n_b_ids = len(tokens.bytes_b)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the distinct linked pairs, as A id x number of B ids + B id, ascending; how often each is there; where each text's start and end."""
        a, b = group_links(self.first_a, self.first_b, self.ends_a, self.ends_b)
        owner = np.searchsorted(self.at_a, a, side="right") - 1
        code = self.a[a] * self.n_b_ids + self.b[b]
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
        return code[at], np.diff(np.append(at, len(code))), np.searchsorted(owner[at], np.arange(len(self.at_a)))

    def digests(self, names: list[np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3 with decimal ids; empty for a text without tokens."""
        n_a, n_b = np.diff(np.append(self.first_a, len(self.a))), np.diff(np.append(self.first_b, len(self.b)))
        new_a, new_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        new_a[self.first_a], new_b[self.first_b] = True, True
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.repeat(self.first_b, n_a)] = np.where(new_a, names[0][self.a], names[1][self.a])
        out[np.arange(len(self.b)) + np.repeat(self.first_a + n_a, n_b)] = np.where(new_b, names[2][self.b], names[1][self.b])
        at = self.at_a + self.at_b
        return [hashlib.sha256(b"".join(out[x:y].tolist())[1:]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def decimal_names(n: int) -> list[np.ndarray]:
    """;0 ;1 ..., ,0 ,1 ... and |0 |1 ..."""
    return [np.array([sign + b"%d" % i for i in range(n)], object) for sign in (b";", b",", b"|")]


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups (first and last byte of a blank and the text; ids of both tokenizers) of every row."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(a_path, b_path)
        for batch, text in slices(batches, most=ALIGNED_BYTES):
            x = Aligned(text, tokens)
            base = np.repeat(np.append(0, x.ends_a)[x.at_a[:-1]], np.diff(x.at_group))
            begin = np.append(0, x.ends_a)[x.first_a]
            end = np.append(begin[1:], x.ends_a[-1:])
            ids = [list_array(v, np.append(first, len(v)), pa.int32()) for v, first in ((x.a, x.first_a), (x.b, x.first_b))]
            group = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base - 1, pa.int32()), *ids], ["first", "last", "a", "b"])
            yield pa.record_batch({"doc_id": batch.column(0), "groups": list_array_of(x.at_group, group)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(align, "doc_id long, groups array<struct<first:int,last:int,a:array<int>,b:array<int>>>")


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROWS of every row: counts, digest of the groups, and its distinct linked pairs with how often each is there (little-endian numbers of 4 bytes)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(a_path, b_path)
        names = decimal_names(max(len(tokens.bytes_a), len(tokens.bytes_b)))
        if len(tokens.bytes_a) * len(tokens.bytes_b) > 1 << 32:
            raise ValueError("pairs of ids of these two tokenizers need more than 4 bytes")
        for batch, text in slices(batches, most=ALIGNED_BYTES):
            x = Aligned(text, tokens)
            code, times, at = x.pairs()
            n_a, n_b, n_groups = np.diff(x.at_a), np.diff(x.at_b), np.diff(x.at_group)
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_a + n_b - n_groups),
                "groups_sha256": pa.array(x.digests(names), pa.string()), "pairs": binary_rows(code.astype("<u4"), at), "times": binary_rows(times.astype("<u4"), at),
            })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(align, ROWS)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte numbers of binary values, joined, and where each value's start and end."""
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def pair_counts(rows: DataFrame, n_b_ids: int) -> DataFrame:
    """pair, n (rows that hold it linked), best (n is the highest of its A id's pairs). rows: ROWS. Tasks count first, so a pair has a row for each task at most."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts.append(np.unique(numbers(batch.column(0).slice(at, 256))[0], return_counts=True))
                held += len(parts[-1][0])
                if held > COUNTED:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > COUNTED // 2:
                        yield pa.record_batch(list(map(pa.array, parts[0])), ["pair", "n"])
                        parts, held = [], 0
        if parts:
            yield pa.record_batch(list(map(pa.array, merged(parts))), ["pair", "n"])

    counts = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / n_b_ids)), "token-pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def valued(rows: DataFrame, counts: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """rows with n_best (links whose pair is a best one) and count_sum (the links' counts added up).

    Counts of the most frequent pairs are sent to all tasks. What a row holds of the others, it meets by a join of pairs: each of them is in few rows, so no key is hot.
    """
    spark = rows.sparkSession
    size = F.floor(F.log2("n")).cast("int")
    by_size = {r["s"]: r["c"] for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("c")).collect()}  # 63 rows at most
    least, total = 64, 0
    for s in sorted(by_size, reverse=True):
        total += by_size[s]
        if total > most_sent:
            break
        least = s
    sent = counts.filter(size >= least).orderBy("pair").toArrow()  # most_sent rows at most
    known = spark.sparkContext.broadcast(tuple(sent.column(c).to_numpy() for c in ("pair", "n", "best")))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        pair, n, best = (np.append(x, extra) for x, extra in ((pair, -1), (n, 0), (best, False)))  # the last is that of a pair that wasn't sent
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                (code, at), (times, _) = numbers(part.column(6)), numbers(part.column(7))
                place = np.searchsorted(pair[:-1], code)
                found = pair[place] == code
                place = np.where(found, place, len(pair) - 1)
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))
                left = np.concatenate([[0], np.cumsum(np.bincount(owner[~found], minlength=part.num_rows))])
                added = [np.concatenate([[0], np.cumsum(x)])[at] for x in (times * best[place], times * n[place])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:6], *(pa.array(np.diff(x).astype(np.int64)) for x in added), *(binary_rows(x[~found].astype("<u4"), left) for x in (code, times))],
                    [*part.schema.names[:6], "n_best", "count_sum", "pairs", "times"],
                )

    out = rows.mapInArrow(value, ROWS.replace("pairs", "n_best long, count_sum long, pairs"))
    if total <= most_sent:
        return out.drop("pairs", "times")
    out = written(out.withColumn("_row", F.monotonically_increasing_id()), "token-values")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                (code, at), (times, _) = numbers(part.column(1)), numbers(part.column(2))
                yield pa.record_batch({"_row": pa.array(np.repeat(part.column(0).to_numpy(), np.diff(at))), "pair": pa.array(code), "times": pa.array(times)})

    met = out.select("_row", "pairs", "times").mapInArrow(rest, "_row long, pair long, times long").join(counts.filter(size < least), "pair")
    added = met.groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("_b"), F.sum(F.col("times") * F.col("n")).alias("_c"))
    return out.join(added, "_row", "left").withColumns({c: F.col(c) + F.coalesce(x, F.lit(0)) for c, x in (("n_best", "_b"), ("count_sum", "_c"))}).drop("_row", "pairs", "times", "_b", "_c")


def alignment_report(docs: DataFrame, a_path: str, b_path: str, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row's whole text.

    A (byte-level) reads a blank and the text, B (pieces) the text. Texts that are null or empty, or that a tokenizer doesn't give back, have
    zeros and an empty digest. Rows that repeat count as often as they are there; null ids stay. An empty table gives no rows.
    """
    from sentencepiece import SentencePieceProcessor

    n_b_ids = SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = written(aligned_rows(docs, a_path, b_path), "token-alignment")
    out = valued(rows, written(pair_counts(rows, n_b_ids), "token-pair-counts"), most_sent)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
