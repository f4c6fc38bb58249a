"""Token-id files: each document's ids compressed by itself with a shared zstandard dictionary.

Layout under a path: `dictionary` (one row: the dictionary, its SHA-256, the id width) and `blocks`, in ascending
identifier order: a row holds up to BLOCK_BYTES of compressed documents, their ids and token counts, the offset of each
frame, and the dictionary's SHA-256. A short document is read by pruning blocks on first_id and last_id,
slicing its frame and decompressing that alone. Spark's writer commits the files, so a lost executor leaves none half
written.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift.llm.shared import new_path, partitions
from motifdrift.llm.words import coded_word_array, slices

END_ID = 1
BLOCK_BYTES = 4 << 20
LEVEL = 3
#: The dictionary is trained on about so many documents, at most so many bytes of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 32 << 10, 2_000, 16 << 10
#: Pieces whose ids a Python worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once, and pieces that the tokenizer gets at once: its results are large objects.
ENCODED_BYTES, LEARNED_AT_ONCE = 8 << 20, 4_096
#: Punctuation that is a piece of its own after a letter or digit.
MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: How a tokenizer must cut and lower-case texts so that pieces can be encoded by themselves.
WORD_CUTS = {
    "normalizer": [("NFC",), ("Replace", "\\s+", " "), ("Lowercase",)],
    "pre_tokenizer": [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True), ("ByteLevel", False, False)],
    "suffix": "</w>",
}


def cuts_of(path: str) -> tuple[dict, np.ndarray]:
    """How the tokenizer in a file cuts texts, in the form of WORD_CUTS, and which ids end a piece."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    norm = [
        (x["type"], x["pattern"].get("Regex"), x["content"]) if x["type"] == "Replace" else (x["type"],) for x in (told.get("normalizer") or {}).get("normalizers", [])
    ]
    pre = []
    for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", []):
        pre.append((x["type"], x["pattern"].get("Regex"), x["behavior"], x["invert"]) if x["type"] == "Split" else (x["type"], x.get("add_prefix_space"), x.get("use_regex")))
    vocab, suffix = told["model"].get("vocab") or {}, told["model"].get("end_of_word_suffix")
    ends = np.zeros(max(vocab.values(), default=0) + 1 if isinstance(vocab, dict) else 1, bool)
    if suffix and isinstance(vocab, dict):
        ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
    return {"normalizer": norm, "pre_tokenizer": pre, "suffix": suffix}, ends


class WordEncoder:
    """Ids of texts. With a tokenizer of WORD_CUTS, of whitespace-separated pieces that are encoded once and remembered.

    Such a tokenizer drops white space and never joins what it separates, so a text's ids are those of its pieces in order.
    Punctuation after a letter or digit is a piece of its own for it too. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        told, self.ends = cuts_of(path)
        self.by_piece = told == WORD_CUTS
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0, "\n": 1}  # piece 0: nothing; piece 1: the end of a document
        self.ids, self.starts = np.array([END_ID], self.width), np.array([0, 0, 1], np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, joined, and how many each has."""
        coded = [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(coded) if coded else np.zeros(0, self.width), np.array([len(x) for x in coded], np.int64)

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: one text of all, cut where a piece ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.width)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # lower-casing made something else of a letter
            return self.whole(words)
        return ids, np.diff(np.concatenate([[0], ends]))

    def learn(self, pieces: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(pieces, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        coded, lengths, names = [self.ids], [], []
        for some, encode in ((np.flatnonzero(plain), self.letters), (np.flatnonzero(~plain), self.whole)):
            for a in range(0, len(some), LEARNED_AT_ONCE):
                part = [pieces[i] for i in some[a : a + LEARNED_AT_ONCE].tolist()]
                ids, n = encode(part)
                coded.append(ids)
                lengths.append(n)
                names += part
        self.ids = np.concatenate(coded)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of pieces, learned if new."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [w for w in names if w not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with END_ID after each text, and where each text's ids start and end."""
        if not self.by_piece:
            ids, n = self.whole(text.to_pylist())
            at = np.cumsum(n)
            return np.insert(ids, at, END_ID), np.concatenate([[0], at + np.arange(1, len(n) + 1)])
        codes, distinct, offsets = coded_word_array(text)
        if len(self.known) > REMEMBERED:
            self.forget()
        # Only ASCII words are lower-cased ahead: elsewhere that and composing don't commute.
        # "<" may begin the name of a special token, which is no matter of pieces; U+0130 ends in a mark once it is lower case.
        special = pc.match_substring_regex(distinct, "[<\u0130]")
        ours = pc.and_(pc.string_is_ascii(distinct), pc.invert(special))
        words = pc.if_else(ours, pc.ascii_lower(distinct), distinct)
        heads = pc.if_else(special, words, pc.ascii_rtrim(words, characters=MARKS))
        n_all, n_head = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, heads))
        cut = np.flatnonzero(n_head < n_all)
        cut = cut[pc.match_substring_regex(heads.take(pa.array(cut)), r"[\p{L}\p{N}]$").to_numpy(zero_copy_only=False)]
        tails = [w.encode()[n:].decode() for w, n in zip(words.take(pa.array(cut)).to_pylist(), n_head[cut].tolist(), strict=True)]
        is_cut = np.zeros(len(distinct), bool)
        is_cut[cut] = True
        pieces = np.zeros((len(distinct) + 1, 2), np.int64)
        pieces[:-1, 0] = self.numbers(pc.if_else(pa.array(is_cut), heads, words))
        pieces[cut, 1] = self.numbers(pa.array(tails, pa.string()))
        pieces[-1] = (1, 0)
        n = np.arange(1, len(offsets))
        with_ends = np.insert(codes, offsets[1:], len(distinct))
        lengths_of = np.diff(self.starts)
        # The ids of each distinct word of this slice, then those of all words.
        flat = pieces.reshape(-1)
        own, own_starts = gathered(self.ids, self.starts[flat], lengths_of[flat])
        own_starts = own_starts[::2]
        out, out_starts = gathered(own, own_starts[with_ends], np.diff(own_starts)[with_ends])
        return out, np.concatenate([[0], out_starts[offsets[1:] + n]])


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + length] for each pair, joined; and where each begins, with the end."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kind = np.int32 if max(ends[-1], len(values)) < 1 << 31 else np.int64
    place = np.repeat((starts - ends[:-1]).astype(kind), lengths)
    place += np.arange(ends[-1], dtype=kind)
    return values[place], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def trained_dictionary(docs: DataFrame, tokenizer_path: str, n_docs: int) -> bytes:
    """A dictionary from whole-corpus row sampling; raw sample bytes if there are too few to train on."""
    sample = docs.select("text") if n_docs <= SAMPLE_DOCS else docs.select("text").sample(SAMPLE_DOCS / n_docs, seed=7)

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in slices(batches, most=ENCODED_BYTES):
            ids, at = encoder(tokenizer_path).encode(text)
            yield pa.record_batch({"ids": pa.array([ids[a:b].tobytes()[:SAMPLE_BYTES] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x for b in batches for x in b.column(0).to_pylist()]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b"".join(samples)[-DICTIONARY_BYTES:]
        yield pa.record_batch({"dictionary": pa.array([made], pa.binary())})

    rows = sample.mapInArrow(serialised, "ids binary").repartition(1).mapInArrow(train, "dictionary binary").collect()  # one row of 32 KB
    return rows[0][0] if rows else b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if len(dictionary) >= 8 else zstandard.ZstdCompressor(level=LEVEL)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if len(dictionary) >= 8 else zstandard.ZstdDecompressor()


BLOCK = (
    "shard int, block int, first_id long, last_id long, tokens_before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "offsets array<long>, payload binary, dictionary_sha256 string"
)
#: A null id's place in the order.
NO_ID = -(1 << 63)


def shards_of(docs: DataFrame, n: int) -> Column:
    """The writing task of a row: by ranges of doc_id. An id that fills several ranges, as many null ids do, is dealt over them by its rows' places."""
    place = F.coalesce("doc_id", F.lit(NO_ID))
    cuts = docs.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    if not cuts:
        return F.lit(0)
    below, same = F.size(F.filter(F.lit(cuts), lambda c: c < place)), F.size(F.filter(F.lit(cuts), lambda c: c == place))
    return (below + F.when(same > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), same)).otherwise(0)).cast("int")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of docs under path. A null text counts as empty and has only the end id; null ids come first; rows that
    repeat an id are all written, side by side and in no promised order. An empty table writes no block."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, n = docs.count(), partitions(spark)
    dictionary = trained_dictionary(docs, tokenizer_path, n_docs)
    digest = hashlib.sha256(dictionary).hexdigest()
    width = np.dtype(encoder(tokenizer_path).width).itemsize
    spark.createDataFrame([(bytearray(dictionary), digest, width)], "dictionary binary, sha256 string, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(dictionary)
        for batch, text in slices(batches, most=ENCODED_BYTES):
            ids, at = encoder(tokenizer_path).encode(text)
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            frames = [press.compress(view[a * width : b * width]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch({"shard": batch.column(2), "doc_id": batch.column(0), "n": pa.array(np.diff(at)), "frame": pa.array(frames, pa.binary())})

    def block(shard: int, number: int, before: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, counts, frames = zip(*rows, strict=True)
        some = [i for i in ids if i is not None]
        row = (shard, number, min(some, default=None), max(some, default=None), before, sum(counts), list(ids), list(counts), np.cumsum([0, *map(len, frames)]).tolist(), b"".join(frames), digest)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], NAMES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, shard, number, before = [], 0, 0, 0, 0
        for batch in batches:
            for of, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (size >= BLOCK_BYTES or of != shard):
                    yield block(shard, number, before, rows)
                    before, number, rows, size = (before + sum(r[1] for r in rows), number + 1, [], 0) if of == shard else (0, 0, [], 0)
                shard, size = of, size + len(row[2])
                rows.append(tuple(row))
        if rows:
            yield block(shard, number, before, rows)

    (
        docs.withColumn("shard", shards_of(docs, n))
        .mapInArrow(compress, "shard int, doc_id long, n long, frame binary")
        .repartitionById(n, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n", "frame")
        .mapInArrow(blocks, BLOCK)
        .write.option("parquet.block.row.count.limit", 1)  # a block can be skipped by itself
        .parquet(f"{path}/blocks")
    )


NAMES = [x.split()[0] for x in BLOCK.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in BLOCK.split(", ")]
#: Looked-up ids whose blocks are told apart in the scan's own filter; of more, it gets the range of each such share.
PUSHED = 64


def open_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, np.dtype]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row[0])).hexdigest() != row[1]:
        raise ValueError(f"{path}: the dictionary doesn't have its recorded hash")
    return bytes(row[0]), row[1], np.dtype(f"<u{row[2]}")


def holding(only: list[int]) -> Column:
    """Blocks that may hold one of the ids: plain comparisons of first_id and last_id, which the scan skips row groups by."""
    ids = sorted(set(only))
    step = -(-len(ids) // PUSHED)
    ranges = [(ids[i], ids[min(i + step, len(ids)) - 1]) for i in range(0, len(ids), step)]
    pushed = reduce(lambda a, b: a | b, [(F.col("first_id") <= hi) & (F.col("last_id") >= lo) for lo, hi in ranges])
    return pushed if step == 1 else pushed & F.exists(F.lit(ids), lambda i: i.between(F.col("first_id"), F.col("last_id")))


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids: from the files. only: identifiers to read; other blocks and frames stay closed."""
    dictionary, digest, width = open_dictionary(spark, path)
    stored = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))  # a row for each writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    if only is not None:
        stored = stored.filter(holding(only)) if only else stored.limit(0)
    wanted = set(only) if only is not None else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = decompressor(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                out, start, payload = [], row["base"] + row["tokens_before"], row["payload"]
                for doc_id, n, a, b in zip(row["doc_ids"], row["doc_tokens"], row["offsets"], row["offsets"][1:], strict=False):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(press.decompress(payload[a:b], max_output_size=n * width.itemsize), width).astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id}: {len(ids)} ids for {n}")
                        out.append((doc_id, start, n, zlib.crc32(ids), ids.tobytes()))
                    start += n
                for i in range(0, len(out), 256):
                    cols = list(zip(*out[i : i + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return stored.join(F.broadcast(bases), "shard").select("base", "tokens_before", "doc_ids", "doc_tokens", "offsets", "payload", "dictionary_sha256").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def token_report(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files that it writes."""
    path = path or new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path).drop("ids")
