"""Token counts, byte-level BPE and packing against the public libraries."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from retentio.llm import byte_bpe, packing, token_counts
from retentio.llm.common import frozen
from retentio.llm.word_bpe import WordBpe

from .conftest import TEXTS, by_id, frame

WORD = Tokenizer.from_file(P.path("word_bpe_49k.json"))
BYTE_RANKS = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
BYTE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BYTE_RANKS, special_tokens={})
PARTS = ["क़", "K", "Å", "ǅ", "é.", "DIE,", "a", "the", "The", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "İ", "Σ", "ß", "12", "'s", "!!",
         "<|endoftext|>", "<|", "😀", "漢字", "x" * 130, "ab" * 60, "½", "\x00", "ing"]


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    return [*(t or "" for t in TEXTS), *("".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(n))]


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    out = by_id(token_counts.token_counts(frame(spark, list(enumerate(texts)))), "n_bytes", "n_tokens", "over_limit")
    for i, t in enumerate(texts):
        n = len(WORD.encode(t, add_special_tokens=False).ids)
        assert out[i] == (len(t.encode()), n, n > 2048), t[:80]


def test_token_counts_of_null_and_no_rows(docs, no_docs):
    assert by_id(token_counts.token_counts(docs), "n_bytes", "n_tokens")[0] == (0, 0)
    assert token_counts.token_counts(no_docs).count() == 0


def test_whole_tokens_are_single_tokens_by_the_library():
    words = sorted(WordBpe(P.path("word_bpe_49k.json")).whole_tokens())[::37]
    plain = [w for w in words if w == w.lower() and len(w.split()) == 1 and WordBpe.normal(w) == w]
    one = [w for w in plain if len(WORD.encode(w, add_special_tokens=False).ids) == 1]
    assert len(one) > 0.9 * len(plain)  # the rest are no single pre-token, such as "don't"


def test_byte_bpe_equals_the_library_and_round_trips(spark):
    texts = odd_texts(seed=4)
    out = byte_bpe.decode(byte_bpe.encode(frame(spark, list(enumerate(texts))))).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = BYTE.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.bytes) == texts[r.doc_id].encode()


def test_segment_tree_merges_equal_the_plain_rule():
    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            ranked = [(BYTE_RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            if not ranked or min(ranked)[0] == 1 << 60:
                return [BYTE_RANKS[p] for p in parts]
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choices(b"aabcdehilnorst \xc3\xa9", k=rng.randint(1, 40)))
        if piece not in BYTE_RANKS:
            assert byte_bpe.merge_ranks(piece, BYTE_RANKS) == plain(piece)


def test_byte_bpe_of_no_rows(no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs)).count() == 0


def naive_best_fit(lengths, capacity):
    left, out = [], []
    for n in lengths:
        fits = [(room, i) for i, room in enumerate(left) if room >= n]
        if fits:
            i = min(fits)[1]
        else:
            i = len(left)
            left.append(capacity)
        left[i] -= n
        out.append(i)
    return len(left)


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(2)
    for capacity in (1, 7, 50, 64, 100):
        lengths = sorted((rng.randint(1, capacity) for _ in range(200)), reverse=True)
        bins = packing.best_fit(lengths, capacity)
        filled = {}
        for b, n in zip(bins, lengths):
            filled[b] = filled.get(b, 0) + n
        assert max(filled.values()) <= capacity
        assert len(filled) == max(bins) + 1 == naive_best_fit(lengths, capacity)


def check_packing(rows, texts, capacity):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    used = {}
    for i, t in enumerate(texts):
        ids = [*WORD.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and len(mine) == -(-len(ids) // capacity)
        for r in mine:
            part = ids[r.start:r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length
            assert bytes(r.ids) == struct.pack(f"<{len(part)}I", *part)
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(r.length for r in mine) == len(ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("shard_pieces", [20_000, 60])
def test_packing_keeps_every_token_and_fills_sequences(spark, shard_pieces):
    texts = [None if t == "" else t for t in odd_texts(600, seed=5)]
    pieces = frozen(packing.document_pieces(frame(spark, list(enumerate(texts))), capacity=64))
    rows = packing.best_fit_decreasing(pieces, capacity=64, shard_pieces=shard_pieces).collect()
    n = check_packing(rows, texts, 64)
    whole = naive_best_fit(sorted((r.length for r in rows), reverse=True), 64)
    assert n <= whole * 1.02 + 1


def test_packing_of_repeated_rows_and_no_rows(spark, no_docs):
    twice = frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    rows = packing.best_fit_decreasing(frozen(packing.document_pieces(twice))).collect()
    assert len(rows) == 4 and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows)[0] == 0 and sum(r.length for r in rows) == 9
    assert packing.best_fit_decreasing(frozen(packing.document_pieces(no_docs))).count() == 0


def test_queries_hash_the_ids(spark, docs):
    r = byte_bpe.encode(docs).where("doc_id = 6").first()
    ids = BYTE.encode_ordinary(TEXTS[6])
    assert hashlib.sha256(bytes(r.ids)).hexdigest() == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_chunk_shortcuts_equal_the_library():
    encode = packing._encoder(P.path("word_bpe_49k.json"))
    rng = random.Random(9)
    parts = [*PARTS, "İ", "ς", "ﬁ", "̸", "̈́", "ι", "ΐ", "ŉ", "ẞ", "Ŀ", ".", ","]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 10)))
        assert list(memoryview(encode(text)).cast("I")) == WORD.encode(text, add_special_tokens=False).ids, text


def test_caches_do_not_remember_texts_without_spaces():
    from retentio.llm.common import LONGEST_KEY, BoundedCache

    asked = []
    cache = BoundedCache(lambda key: asked.append(key) or len(key), limit=10)
    long = [chr(0x4E00 + i) * 20_000 for i in range(50)]
    for key in [*long, *long, "a" * LONGEST_KEY, "a" * LONGEST_KEY]:
        assert cache[key] == len(key)
        cache.trim()
    assert len(asked) == 101 and list(cache) == ["a" * LONGEST_KEY]


def test_caches_stay_bounded_within_one_text():
    import public_tokenizers

    from retentio.llm.byte_bpe import CACHED_UNITS, ByteBpe, default_path
    from retentio.llm.common import BoundedCache

    cache = BoundedCache(len, limit=10)
    for i in range(1000):
        assert cache[f"k{i}"] == len(f"k{i}") and len(cache) <= 10 and len(cache.old) <= 10
    bpe = ByteBpe(default_path(), public_tokenizers.PATTERN)
    assert bpe.plain.limit == bpe.spaced.limit == CACHED_UNITS <= 300_000
    text = " ".join(f"w{i}" for i in range(300))
    whole = bpe.encode(text)
    bpe.plain.limit = bpe.spaced.limit = 7
    bpe.plain.clear(), bpe.spaced.clear()
    assert bpe.encode(text) == whole and len(bpe.spaced) <= 7
