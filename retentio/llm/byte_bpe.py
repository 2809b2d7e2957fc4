"""Byte-level BPE, encoding and decoding.

A segment tree over a pre-token's byte positions holds at each leaf the rank
of the pair that starts there and at each node the least rank below it.  The
root gives the next merge, a walk down the leftmost place of it, and a merge
updates three leaves: the joined pair, its live left neighbour's, and the
position that is no longer live.  A pre-token of n bytes costs n log n.

Units of a text (a white-space run and the word after it) are encoded apart,
with a bounded cache; no text is cut.  Null text counts as empty: no ids,
empty bytes.  Decoding maps each id to its bytes.  An empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
from array import array

from pyspark.sql import DataFrame

from .common import BoundedCache, per_document, text_or_empty, worker_state
from .word_bpe import WHITE

_NONE = 1 << 60
#: entries of a generation of a cache; a worker holds up to four, some 200 bytes an entry
CACHED_UNITS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    pairs = n - 1  # a leaf for each place where a pair can start
    size = 1 << (pairs - 1).bit_length()
    tree = [_NONE] * (2 * size)
    tree[size:size + pairs] = [get(piece[i:i + 2], _NONE) for i in range(pairs)]
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    while (best := tree[1]) != _NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != best:
                k += 1
        i = k - size
        j = after[i]
        e = after[i] = after[j]
        if e < n:
            before[e] = i
            changed = [(j, _NONE), (i, get(piece[i:after[e]], _NONE))]
        else:
            changed = [(i, _NONE)] if j >= pairs else [(j, _NONE), (i, _NONE)]
        p = before[i]
        if p >= 0:
            changed.append((p, get(piece[p:e], _NONE)))
        for at, rank in changed:
            k = size + at
            if tree[k] == rank:
                continue
            tree[k] = rank
            while k > 1:
                low = tree[k ^ 1]
                if rank < low:
                    low = rank
                k >>= 1
                if tree[k] == low:
                    break
                tree[k] = rank = low
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class ByteBpe:
    """Texts to ids; units whose white space is not one plain character each go the exact way."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pretokens = regex.compile(pattern).findall
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.runs = re.compile(f"[{WHITE}][{WHITE}]").search
        self.spaced = BoundedCache(self._spaced, CACHED_UNITS)
        self.plain = BoundedCache(self.unit, CACHED_UNITS)

    def unit(self, unit: str) -> bytes:
        ids = array("I")
        for piece in self.pretokens(unit):
            ids.extend(merge_ranks(piece.encode("utf-8"), self.ranks))
        return ids.tobytes()

    def _spaced(self, piece: str) -> bytes:
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():  # a stop after letters is a pre-token of its own
            return self.spaced[piece[:-1]] + self.plain[piece[-1]]
        return self.unit(" " + piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.plain.trim()
        self.spaced.trim()
        if self.runs(text):  # a run of white space falls apart by what follows it
            return b"".join(map(self.plain.__getitem__, self.units(text)))
        first, *rest = text.split(" ")
        return b"".join([self.plain[first], *map(self.spaced.__getitem__, rest)])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every document."""
    import public_tokenizers

    path, pattern = path or default_path(), pattern or public_tokenizers.PATTERN

    def make():
        state, key = worker_state("byte_bpe"), ("byte_bpe", path, pattern)
        bpe = state[key] = state.get(key) or ByteBpe(path, pattern)
        return lambda texts: [[bpe.encode(t) for t in texts]]

    return per_document(docs.select("doc_id", text_or_empty("text").alias("text")), make, [("ids", "binary")])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and bytes (the decoded text) of rows with ids; null ids count as none."""
    path = path or default_path()

    def make():
        state, key = worker_state("byte_bpe"), ("byte_bpe_decode", path)
        if key not in state:
            table = [b""] * (1 + max((ranks := load_ranks(path)).values()))
            for token, rank in ranks.items():
                table[rank] = token
            state[key] = table
        take = state[key].__getitem__

        def one(ids):
            return b"".join(map(take, memoryview(ids or b"").cast("I")))

        return lambda rows: [rows, [one(r) for r in rows]]

    return per_document(encoded, make, [("ids", "binary"), ("bytes", "binary")], column="ids")
