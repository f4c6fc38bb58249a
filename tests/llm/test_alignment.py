"""Alignment of two tokenizers against whole-text encoding and brute force, hard rows, and pairs that aren't sent."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from motifdrift.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", " a", "a ", "a  b", "\n", "a\n b", "x y   z", "▁a", "<|endoftext|> hi <s> <0x41>", "漢字 テスト mixed漢字text 😀😀 é é ﬁ", "a\tb\t c", "don't 's 'll  it's",
    "\x00 a\x00b", "A" * 3000, "ab" * 1500 + " " + "漢" * 900, "  x 　 y", "1234567 89  000", "a\r\n\r\nb   \n  c", "́ x ́", "x ​ y​ z", "# !! ## \x1c q \x85 w", "ő Ğ İ ß",
]


def plain_tokens():
    """Ids and bytes of whole texts, as the contract words it."""
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte, n = {}, 0
    for x in range(256):
        if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE:
            byte[chr(x)] = x
        else:
            byte[chr(256 + n)] = x
            n += 1

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])

    return tokens


def brute(texts):
    """A tuple for each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tokens, rows, held = plain_tokens(), [], Counter()
    for text in texts:
        a, b = tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, place = [], [0, 0]
        for cut in cuts:
            both = []
            for k in (0, 1):
                start = place[k]
                while place[k] < len(spans[k]) and spans[k][place[k]][2] <= cut:
                    place[k] += 1
                both.append(",".join(str(i) for i, _, _ in spans[k][start : place[k]]))
            groups.append("|".join(both))
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        held.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(n_a, n_b, n_g, len(ls), sum(held[x] == top[x[0]] for x in ls), sum(held[x] for x in ls), sha) for n_a, n_b, n_g, ls, sha in rows]


def words(rng, n):
    return "".join(rng.choice(["the", "ing", "schön", "ß", "Quark", "12", "...", "re", "über", "é"]) + rng.choice(["", " ", " ", "\n", ", "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [*ODD, None, "", *(words(rng, n) for n in (1, 2, 5, 30, 30, 400, 3000)), *["the same thing, again"] * 5]


def told(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("most_sent", [alignment.MOST_SENT, 300, 0])
def test_equals_brute_force(spark, texts, most_sent):
    docs = spark.createDataFrame([(i // 2, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pair string").repartition(3)
    want = sorted([(i // 2, *row) for i, row in enumerate(brute(texts))], key=str)
    assert told(alignment.alignment_report(docs, *PATHS, most_sent=most_sent)) == want


def test_hard_rows(hard, hard_rows, empty):
    want = sorted([(r[0], *row) for r, row in zip(hard_rows, brute([r[1] for r in hard_rows]), strict=True)], key=str)
    assert told(alignment.alignment_report(hard, *PATHS)) == want
    assert alignment.alignment_report(empty, *PATHS).count() == 0


def test_groups_cover_every_byte_with_both_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = alignment.Tokens(*PATHS)
    for r in alignment.token_groups(docs, *PATHS).collect():
        whole, at = (" " + (texts[r.doc_id] or "")).encode(), 0
        for g in r.groups:
            part = whole[g.first : g.last + 1]
            assert g.first == at and part == b"".join(tokens.bytes_a[i] for i in g.a) == b"".join(tokens.bytes_b[i] for i in g.b)
            at = g.last + 1
        assert at in (0, len(whole))


@pytest.mark.parametrize("seed", range(20))
def test_divide_and_conquer_finds_every_shared_cut(seed):
    rng = np.random.default_rng(seed)
    ends, at, base, want = ([], []), ([0], [0]), 0, []
    for _ in range(rng.integers(1, 6)):
        size = int(rng.choice([0, 1, 2, 7, 300, 5000]))
        shared = rng.random(size) < rng.choice([0.0, 0.01, 0.3, 1.0])  # none, few, many or all
        for k in (0, 1):
            own = np.arange(1, size + 1)[shared | (rng.random(size) < 0.5) & (np.arange(size) % 2 == k)]
            own = np.union1d(own, [size] if size else [])
            ends[k].extend((own + base).tolist())
            at[k].append(len(ends[k]))
        base += size
    a, b = np.array(ends[0], np.int64), np.array(ends[1], np.int64)
    first_a, first_b = alignment.leaf_groups(a, b, np.array(at[0]), np.array(at[1]))
    want = np.intersect1d(a, b)
    assert first_a.tolist() == np.searchsorted(a, np.append(0, want[:-1]), side="right").tolist()[: len(want)]
    assert first_b.tolist() == np.searchsorted(b, np.append(0, want[:-1]), side="right").tolist()[: len(want)]
    link_a, link_b = alignment.group_links(first_a, first_b, a, b)
    start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    if len(a) < 2000:
        lap = (start_a[:, None] < b[None, :]) & (start_b[None, :] < a[:, None])
        assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(lap).tolist()]
    assert len(link_a) == len(a) + len(b) - len(first_a)


def test_segments_give_the_ids_of_whole_texts():
    tokens, plain = alignment.Tokens(*PATHS), plain_tokens()
    assert tokens.by_segment
    rng = random.Random(1)
    for _ in range(3):  # later turns remember
        some = [*ODD, *(words(rng, 200) for _ in range(20))]
        (a, at_a), (b, at_b) = tokens.encode(pa.array(some))
        for i, text in enumerate(some):
            want = plain(text)
            assert [a[at_a[i] : at_a[i + 1]].tolist(), b[at_b[i] : at_b[i + 1]].tolist()] == [[x for x, _ in side] for side in want]


def test_cutless_stretches_are_one_group():
    a, b = np.arange(2, 20_002, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    first_a, first_b = alignment.leaf_groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert first_a.tolist() == [0] and first_b.tolist() == [0]
    assert len(alignment.group_links(first_a, first_b, a, b)[0]) == len(a) + len(b) - 1
