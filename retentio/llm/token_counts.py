"""Token counts with a whole-token shortcut.

The driver proves once which strings of the vocabulary encode alone as a
single token (a set bounded by the vocabulary, broadcast).  In the workers a
pre-token in that set counts one, and only the rest goes through the merges.
Counts of chunks are remembered in a bounded cache; no text is cut.

Null text counts as empty: 0 bytes, 0 tokens.  An empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, per_document, text_or_empty, worker_state
from .word_bpe import WordBpe, default_path, splitter

LIMIT = 2048


def _counter(path: str, proven):
    """text list -> [token counts]; built once per worker process."""
    key = ("token_counts", path)
    state = worker_state("token_counts")
    if key not in state:
        bpe, whole = WordBpe(path), proven.value

        def count_pretokens(part: str) -> int:
            return sum(1 if p in whole else len(bpe.merged(p)) for p in bpe.pretokens(bpe.normal(part)))

        def count_chunk(chunk: str) -> int:
            if bpe.special_mark in chunk:
                parts = bpe.special.split(chunk)
                return len(parts) - 1 + sum(map(count_pretokens, parts))
            return count_pretokens(chunk)

        state[key] = BoundedCache(count_chunk)
    cache, chunks = state[key], splitter()

    def work(texts):
        out = []
        for text in texts:
            cache.trim()
            out.append(sum(map(cache.__getitem__, chunks(text))))
        return [out]

    return work


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    path = path or default_path()
    proven = docs.sparkSession.sparkContext.broadcast(WordBpe(path).whole_tokens())
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    sized = texts.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    # n_bytes rides along as part of the key column so that one pass gives both
    keyed = sized.select(F.struct("doc_id", "n_bytes").alias("doc_id"), "text")
    counted = per_document(keyed, lambda: _counter(path, proven), [("n_tokens", "bigint")])
    return counted.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
