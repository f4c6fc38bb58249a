"""Word arrays of whole texts, in Arrow and numpy: the kernel that the Python operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 24 << 20


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row slices of bounded text size, each with its texts (null: empty)."""
    for batch in batches:
        text = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(text):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start), text.slice(start, stop - start)
            start = stop


def coded_words(text: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between [\\x20\\x09-\\x0D]: a code for each, the distinct words, and where each text's words start and end."""
    codes, distinct, offsets = coded_word_array(text)
    return codes, distinct.to_pylist(), offsets


def coded_word_array(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """coded_words() with the distinct words as an Arrow array."""
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads them (splitmix64's finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingles(text: pa.Array, width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `width` words (A-Z lower-cased) in order, and where each text's run starts and ends.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    codes, distinct, offsets = coded_words(pc.ascii_lower(text) if lower else text)
    hashes = word_hashes(distinct)[codes]
    n_words = np.diff(offsets)
    counts = np.where(n_words >= width, n_words - width + 1, n_words > 0).astype(np.int64)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    odd = np.uint64(0x9E3779B97F4A7C15)
    mult = [np.uint64(pow(int(odd), j + 1, 1 << 64)) for j in range(width)]
    total = len(hashes)
    rolled = np.zeros(max(total, 1), np.uint64)
    for j in range(width):
        if total > j:
            rolled[: total - j] += hashes[j:] * mult[j]
    # The place of each run: its text's first word, plus its number in the text.
    first = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    out = mixed(rolled[first]) if len(first) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        h, n = np.uint64(0), int(n_words[i])
        with np.errstate(over="ignore"):
            for j in range(n):
                h += hashes[offsets[i] + j] * mult[j]
            out[out_offsets[i]] = mixed(np.array([h + np.uint64(n)], np.uint64))[0]
    return out, out_offsets


def distinct_in_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner)) if len(offsets) > 2 else np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1))]).astype(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each text: its slice of values as little-endian bytes."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
