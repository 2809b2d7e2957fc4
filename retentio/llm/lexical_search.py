"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector over the terms that the items use; its entry at a
term is the term's weight times the document's saturated frequency, an integer.
An item is the set of its terms, so a score is the inner product of the
document's vector with the item's indicator vector.

1. *Vectors.*  One pass takes the terms of every whole text and keeps the
   document's length and the frequencies of the items' terms.  Documents,
   lengths and document frequencies are counted over all rows.
2. *Trees.*  A task builds ball trees over its documents, some thousands at a
   time: a node has the centroid of its documents and a radius that none of
   them exceeds, and is cut between the centroids of two halves about far
   documents.
3. *Search.*  For an item q and a node with centroid c and radius r no document
   below it scores more than q.c + |q| r, where q is cut to the terms that c
   has (a document's entries are positive, so it has no others).  Nodes are taken best bound first and
   the search ends when the best bound is under the task's tenth best score.
   Bounds are computed in doubles and raised by more than their rounding
   errors, so no document is lost; documents of a leaf are scored in 64-bit
   integers.
4. *Ranking.*  Tasks give their best ``k`` of each item; these are ranked.

Items are taken in blocks of about ``BLOCK_PAIRS`` (item, term) pairs, which is
what bounds the vocabulary that goes to every task; each block searches all
documents.

Null or term-less documents are in no result and don't count for the
statistics; an item without terms has no result.  Rows that repeat a doc_id are
documents of their own, each with a rank; of equal scores the smaller doc_id
comes first, a null one last.  Rows that repeat an item_id are one item with
the terms of all; a null item_id is an item like any other.  Empty tables give
an empty result.  Only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, bounded_batches, frozen, text_or_empty

K = 10
#: (item, term) pairs that are searched at once, about
BLOCK_PAIRS = 200_000
#: documents and vector entries of one tree at most (a single document may have more entries), documents of a leaf
TREE_DOCS = 8192
TREE_ENTRIES = 2_000_000
LEAF = 32
#: partial rankings of one item before the last one
SALTS = 32
#: fixed values: what separates terms
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each pair once."""
    terms = F.split(ascii_lower(text_or_empty("text")), SEPARATORS)
    return items.select("item_id", F.explode(terms).alias("term")).where("term <> ''").distinct()


def _vectors(vocabulary: dict):
    """Batches of (doc_id, text bytes) to doc_id, n (terms), terms (numbers in the vocabulary) and tf."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        number = vocabulary.get
        for batch in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = (text or b"").translate(_TERM_BYTES).split()
                lengths.append(len(words))
                found, tf = np.unique(np.array([i for i in map(number, words) if i is not None], dtype="i4"), return_counts=True)
                terms.append(found)
                counts.append(tf.astype("i4"))
                ends.append(ends[-1] + len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, counts)]],
                names=["doc_id", "n", "terms", "tf"])

    return run


class BallTree:
    """Ball tree over sparse rows of whole numbers: ``ptr``, ``idx`` and ``val`` as in compressed rows, none empty."""

    def __init__(self, ptr, idx, val, dims: int, leaf: int = LEAF):
        import numpy as np

        n = len(ptr) - 1
        weight = val.astype("f8")
        norms = np.add.reduceat(weight * weight, ptr[:-1])
        order = np.arange(n)
        self.lo, self.hi, self.left, radius = [], [], [], []
        parts = []
        waiting = [(0, n)]
        while waiting:  # level by level; a node's children are next to each other
            nexts = []
            for lo, hi in waiting:
                rows = order[lo:hi]
                flat, starts = _entries(ptr, rows)
                i, w = idx[flat], weight[flat]
                centre = np.bincount(i, w, dims) / (hi - lo)
                size = float(centre @ centre)
                norm = norms[rows]
                apart = norm - 2 * np.add.reduceat(w * centre[i], starts) + size
                # squares lose some 1e-15 of their terms; a part in 1e9 is far above that
                radius.append(math.sqrt(max(0.0, float((apart + 1e-9 * (norm + size)).max()))))
                self.lo.append(lo)
                self.hi.append(hi)
                places = np.flatnonzero(centre)
                parts.append((places, centre[places]))
                if hi - lo <= leaf:
                    self.left.append(-1)
                    continue
                a = _dense(ptr, idx, weight, rows[int(apart.argmax())], dims)
                along_a = np.add.reduceat(w * a[i], starts)
                b = _dense(ptr, idx, weight, rows[int((norm - 2 * along_a).argmax())], dims)
                half = (hi - lo) // 2
                nearer = np.argsort(np.add.reduceat(w * b[i], starts) - along_a, kind="stable")
                # cut again between the centroids of the two halves, in their middle unless that is lopsided
                means = []
                for part in (nearer[:half], nearer[half:]):
                    f, _ = _entries(ptr, rows[part])
                    means.append(np.bincount(idx[f], weight[f], dims) / len(part))
                low, high = means
                side = np.add.reduceat(w * (high - low)[i], starts) - (high @ high - low @ low) / 2
                nearer = np.argsort(side, kind="stable")
                cut = int((side < 0).sum())
                cut = cut if 8 * min(cut, hi - lo - cut) >= hi - lo else half
                order[lo:hi] = rows[nearer]
                self.left.append(0)  # numbered below
                nexts += [(lo, lo + cut), (lo + cut, hi)]
            first = child = len(self.lo)  # the children follow all nodes of this level
            for node in range(first - len(waiting), first):
                if self.left[node] == 0:
                    self.left[node] = child
                    child += 2
            waiting = nexts
        self.radius = np.array(radius)
        self.order = order
        flat, _ = _entries(ptr, order)
        self.idx, self.val = idx[flat], val[flat]
        self.ptr = np.r_[0, np.cumsum(np.diff(ptr)[order])]
        # centroids by term, for the inner products of one item with all of them
        node = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
        term = np.concatenate([p for p, _ in parts])
        by_term = np.argsort(term, kind="stable")
        self.node, self.mean = node[by_term], np.concatenate([c for _, c in parts])[by_term]
        self.term_at = np.searchsorted(term[by_term], np.arange(dims + 1))
        self.wanted = np.zeros(dims, dtype=bool)

    def bounds(self, terms):
        """For each node a number that no score below it exceeds."""
        import numpy as np

        spans = [slice(self.term_at[t], self.term_at[t + 1]) for t in terms]
        node = np.concatenate([self.node[s] for s in spans])
        inner = np.bincount(node, np.concatenate([self.mean[s] for s in spans]), len(self.radius))
        held = np.bincount(node, minlength=len(self.radius))  # entries are positive: a term not in c is in no document below
        return (inner + np.sqrt(held) * self.radius) * (1 + 1e-9) + (held > 0)

    def search(self, terms, offer, least: int) -> int:
        """Calls ``offer(rows, scores)``, which returns the score from which on more are wanted, for leaves best
        first.  ``least`` is that score at the start."""
        import heapq

        import numpy as np

        bound = self.bounds(terms)
        self.wanted[terms] = True
        heap, visited = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.ptr[lo], self.ptr[hi]
            scores = np.add.reduceat(self.val[a:b] * self.wanted[self.idx[a:b]], self.ptr[lo:hi] - a)
            least = offer(self.order[lo:hi], scores)
            visited += 1
        self.wanted[terms] = False
        return visited


def _entries(ptr, rows):
    """Places of the rows' entries, row after row, and where each row starts among them."""
    import numpy as np

    lengths = ptr[rows + 1] - ptr[rows]
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(ptr[rows] - starts, lengths), starts


def _dense(ptr, idx, weight, row, dims):
    import numpy as np

    out = np.zeros(dims)
    out[idx[ptr[row]:ptr[row + 1]]] = weight[ptr[row]:ptr[row + 1]]
    return out


def _best(queries: list, weights: list, documents_: int, terms_: int, k: int, kinds: list):
    """Batches of vectors to the task's best ``k`` documents of each item."""

    def run(batches):
        import bisect

        import numpy as np
        import pyarrow as pa

        weight = np.array(weights, dtype="i8")
        sets = [np.array(t, dtype="i8") for _, t in queries]
        tops: list[list] = [[] for _ in queries]

        def search(ids, lengths, rows):
            ptr = np.r_[0, np.cumsum([len(t) for t, _ in rows])]
            idx = np.concatenate([t for t, _ in rows]).astype("i8")
            tf = np.concatenate([c for _, c in rows]).astype("i8")
            m = np.repeat(np.array([10 + 90 * n * documents_ // terms_ for n in lengths], dtype="i8"), np.diff(ptr))
            val = weight[idx] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            tree = BallTree(ptr, idx, val, len(weight))
            present = np.zeros(len(weight), dtype=bool)
            present[idx] = True
            for terms, top in zip(sets, tops):
                here = terms[present[terms]]
                if not len(here):
                    continue

                def offer(rows_, scores, top=top):
                    least = top[-1][0] if len(top) == k else -1  # scores are kept negative
                    for j in np.flatnonzero(scores >= -least).tolist():
                        doc = ids[rows_[j]]
                        bisect.insort(top, (-int(scores[j]), doc is None, doc))
                        del top[k:]
                    return -top[-1][0] if len(top) == k else 1

                tree.search(here, offer, -top[-1][0] if len(top) == k else 1)

        ids, lengths, rows, entries = [], [], [], 0
        for batch in batches:
            doc_ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = []
            for c in (2, 3):
                column = batch.column(c)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                lists.append(np.split(flat, (ends[1:-1] - ends[0])))
            for doc, n, terms, tf in zip(doc_ids, sizes, *lists):
                if not len(terms):
                    continue
                if len(rows) == TREE_DOCS or (rows and entries + len(terms) > TREE_ENTRIES):
                    search(ids, lengths, rows)
                    ids, lengths, rows, entries = [], [], [], 0
                ids.append(doc)
                lengths.append(n)
                rows.append((terms, tf))
                entries += len(terms)
        if rows:
            search(ids, lengths, rows)
        found = [(item, doc, -score) for (item, _), top in zip(queries, tops) for score, _, doc in top]
        table = pa.table({"item_id": [x[0] for x in found], "doc_id": [x[1] for x in found], "score": [x[2] for x in found]})
        schema = pa.schema([("item_id", kinds[0]), ("doc_id", kinds[1]), ("score", pa.int64())])
        yield from table.cast(schema).to_batches()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
            .where(F.col("rank") <= k).drop("rank", "salt"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    types = [items.schema["item_id"].dataType, docs.schema["doc_id"].dataType]
    (item_kind, doc_kind), kinds = [t.simpleString() for t in types], [to_arrow_type(t) for t in types]
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    pairs = frozen(item_terms(items))
    blocks = max(1, -(-pairs.count() // block_pairs))
    whole, totals = None, None
    for block in range(blocks):
        chosen = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        asked: dict = {}
        for item, term in chosen.collect():  # about block_pairs at most
            asked.setdefault(item, set()).add(term.encode())
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
        vectors = frozen(texts.mapInArrow(_vectors(vocabulary), f"doc_id {doc_kind}, n bigint, terms array<int>, tf array<int>"))
        if totals is None:
            totals = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        count, length = totals
        frequency = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # one row a term
        weights = [math.floor(1000 * math.log((2 * count + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(vocabulary))]
        queries = [(item, sorted(vocabulary[t] for t in terms)) for item, terms in asked.items()]
        best = vectors.mapInArrow(_best(queries, weights, count, length, k, kinds),
                                  f"item_id {item_kind}, doc_id {doc_kind}, score bigint")
        best = frozen(best) if blocks > 1 else best
        whole = best if whole is None else whole.unionByName(best)
    return _ranked(whole, k)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY doc_id, term),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weight USING (term), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
