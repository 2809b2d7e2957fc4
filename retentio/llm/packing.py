"""Best-fit-decreasing packing of documents into fixed-length sequences.

Every document becomes its token ids and one separator; longer ones are cut
into full pieces and a rest.  Pieces are dealt by hash into shards of about
``SHARD_PIECES`` (the number of shards grows with the pieces, so no task grows
with the input), and each shard is packed longest first.  A segment tree over
the remaining capacities 0..capacity tells which of them have an open bin;
the tightest one that fits is found on one way up and down the tree.  The
loosely filled sequences of all shards are packed again, each as one item and
dealt anew, by shards of about ``SHARD_PIECES`` at most, until one shard has
had them all, no two of them fit together or a round saves nothing.

Null text counts as empty (the separator alone).  Ties are broken by the
smallest doc_id and piece, then by the other columns, so a run repeats exactly.
Rows with the same doc_id, or none, are packed apart and dealt by their other
columns, too; only rows alike in all of them that are more than a quarter of a
shard are dealt by their place in the table.  An empty table gives an empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

from .common import BoundedCache, bounded_batches, frozen, text_or_empty, worker_state
from .word_bpe import byte_alphabet, default_path, splitter

CAPACITY = 2048
SEPARATOR = 0
SHARD_PIECES = 20_000
#: chunks whose ids a worker remembers, about, in each of two generations
CACHED_CHUNKS = 600_000
#: a sequence with at least this share of its capacity free is offered for another round
LOOSE = 1 / 64


def _encoder(path: str, cached_chunks: int = CACHED_CHUNKS):
    """text -> ids (little-endian unsigned 32-bit) by the tokenizers library, chunk by chunk."""
    state, key = worker_state("packing"), ("word_bpe_ids", path, cached_chunks)
    if key not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from array import array
        from unicodedata import is_normalized, normalize

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        model, alphabet = tokenizer.model, byte_alphabet()

        def ids_of(chunk: str) -> bytes:
            core, stop = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
            if core.isalpha() and "Σ" not in core:
                plain = core.lower() if core.isascii() else normalize("NFC", core).lower()
                if plain.isalpha() and is_normalized("NFC", plain):  # still letters only: one pre-token
                    if stop:  # and a stop after letters is another
                        return cache[plain] + cache[stop]
                    if plain != core:
                        return cache[plain]
                    word = plain if plain.isascii() else "".join(map(alphabet.__getitem__, plain.encode()))
                    return array("I", [t.id for t in model.tokenize(word)]).tobytes()
            return array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

        cache = state[key] = BoundedCache(ids_of, cached_chunks)
    cache, chunks = state[key], splitter()

    def encode(text: str) -> bytes:
        cache.trim()
        return b"".join(map(cache.__getitem__, chunks(text)))

    return encode


def document_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR,
                    cached_chunks: int = CACHED_CHUNKS) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (binary, little-endian unsigned 32-bit).

    ``cached_chunks`` trades a worker's memory (about 0.4 kB each) for time; results don't depend on it."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode, end = _encoder(path, cached_chunks), separator.to_bytes(4, "little")
        for batch in batches:
            at, pieces, starts, lengths, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text) + end
                for k, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start:start + 4 * capacity]
                    at.append(i)
                    pieces.append(k)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    ids.append(part)
            take = pa.array(np.array(at, dtype="int64"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(
        run, f"doc_id {key}, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item, items in the order given."""
    size = 1 << capacity.bit_length()
    open_ = bytearray(2 * size)  # a leaf per remaining capacity: is there such a bin
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = [], 0
    for need in lengths:
        k = size + need
        if not open_[k]:
            # up to the first subtree to the right that has a bin, then down its left side
            while k > 1 and (k & 1 or not open_[k + 1]):
                k >>= 1
            if k > 1:
                k += 1
                while k < size:
                    k *= 2
                    if not open_[k]:
                        k += 1
        if k > 1:
            left = k - size
            bin_ = bins[left].pop()
            if not bins[left]:
                while k and open_[k]:
                    open_[k] = k < size and (open_[2 * k] or open_[2 * k + 1])
                    if open_[k]:
                        break
                    k >>= 1
        else:
            left, bin_, made = capacity, made, made + 1
        out.append(bin_)
        left -= need
        bins[left].append(bin_)
        k = size + left
        while k and not open_[k]:
            open_[k] = 1
            k >>= 1
    return out


def _packed(items: DataFrame, order: list[str], key: Column, shards: int, capacity: int) -> DataFrame:
    """``items`` (with length), dealt by ``key``, plus bin (shard in the high bits) and offset."""
    dealt = items.withColumn("_shard", F.pmod(key, F.lit(shards)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def pack(table):
        import pyarrow as pa

        shard = table.column("_shard")[0].as_py()
        table = table.drop_columns(["_shard"]).sort_by([("length", "descending"), *[(c, "ascending") for c in order]])
        lengths = table.column("length").to_pylist()
        bins = best_fit(lengths, capacity)
        filled, offsets = [0] * (max(bins) + 1), []
        for b, n in zip(bins, lengths):
            offsets.append(filled[b])
            filled[b] += n
        return (table.append_column("bin", pa.array([(shard << 32) | b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    return dealt.groupBy("_shard").applyInArrow(pack, f"{fields}, bin bigint, offset bigint")


def _frequent(keys: DataFrame, least: int) -> list[int]:
    """Values of ``key`` on more than ``least`` rows."""
    return [x["key"] for x in keys.groupBy("key").count().where(F.col("count") > least).select("key").collect()]


def best_fit_decreasing(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length up to ``capacity`` and any others) plus sequence_id and offset.

    ``pieces`` is read several times: pass a frozen table.
    """
    pieces = pieces.drop("sequence_id", "offset", "bin")
    shards = max(1, -(-pieces.count() // shard_pieces))
    plain = (NumericType, StringType, BinaryType, BooleanType)
    order = ["doc_id", "piece", *[f.name for f in pieces.schema
                                  if isinstance(f.dataType, plain) and f.name not in ("doc_id", "piece", "length")]]
    key = F.xxhash64("length", *order)
    # at most four keys a shard have so many rows
    if shards > 1 and (frequent := _frequent(pieces.select(key.alias("key")), max(1, shard_pieces // 4))):
        key = F.when(key.isin(frequent), F.xxhash64(F.monotonically_increasing_id())).otherwise(key)
    packed = _packed(pieces, order, key, shards, capacity).withColumnRenamed("bin", "sequence_id")
    if shards == 1:
        return packed
    packed = frozen(packed)
    bins = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    # where each loose sequence has gone: into sequence ``home``, ``shift`` tokens after its start
    moved = frozen(bins.where(F.col("length") <= int(capacity * (1 - LOOSE)))
                   .select("sequence_id", "length", F.col("sequence_id").alias("home"), F.lit(0).cast("bigint").alias("shift")))
    turn, before = 0, None
    while shards > 1:
        homes = frozen(moved.groupBy("home").agg(F.sum("length").alias("length")))
        left = homes.count()
        least = [x["length"] for x in homes.orderBy("length").limit(2).collect()]
        # a shard's bins are pairwise too full for each other, so at most one of each is half empty and has a chance:
        # every round that goes on makes those fewer
        if left == before or len(least) < 2 or sum(least) > capacity:
            break
        turn, before = turn + 1, left
        shards = -(-left // shard_pieces)
        joined = frozen(_packed(homes, ["home"], F.xxhash64("home", F.lit(turn)), shards, capacity))
        first = joined.where("offset = 0").select("bin", F.col("home").alias("into"))
        step = joined.join(first, "bin").select("home", "into", F.col("offset").alias("by"))
        moved = frozen(moved.join(step, "home").select(
            "sequence_id", "length", F.col("into").alias("home"), (F.col("shift") + F.col("by")).alias("shift")))
    return (packed.join(moved.drop("length"), "sequence_id", "left")
            .withColumn("sequence_id", F.coalesce("home", "sequence_id"))
            .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
            .drop("home", "shift"))
