"""Similarity join on word shingles by token-combination prefixes.

Documents link when the Jaccard similarity of their sets of five-word shingles
is at least ``threshold`` per cent.

1. *Postings.*  A batch of documents is shingled in numpy; copies of a set
   within the batch are represented by one.  Postings go, packed, to a bucket
   by token hash.  A token in many documents of a batch is announced once, and
   its postings go to the documents directly.
2. *Frequencies.*  A bucket counts each token's documents and returns those in
   two or more; a token of one document can link nothing.  All tokens are
   ordered by frequency class, then hash, rarest first.  Intersections need
   only these lists, since a shared token is in two documents.
3. *Prefixes.*  Similar sets of n tokens share at least k of their first
   n - ceil(t n) + k.  A document indexes each rare token of its extended
   prefix alone.  Its frequent tokens fall into C classes by hash, k is C + 1,
   and it indexes every pair of tokens within a class: of C + 1 shared tokens
   either one is rare or two fall into one class.  C follows from the size
   class of a document, so a prefix gives pairs in proportion to its length.
4. *Verify.*  Documents under one signature are compared with the one of them
   that has the fewest tokens of its own, and what is linked forms components.  Under signatures whose documents are
   not all in one component, documents of different components are compared
   with each other, too; a pair is left to the first signature that the two are
   known to share.  A bound from sizes and parity bitmaps, which never rejects
   a link, comes before each exact comparison.

So every pair that links is compared or lies in one component.  Tokens are 54
bits of a hash.  Copies of a set (exact duplicates) link by a 128-bit digest.

Null or word-less text: no shingles, linked with nothing.  Fewer than five
words: the whole sequence is one shingle.  doc_id is a whole number.  A null
doc_id links with nothing (component null); such rows pass beside the join.
Rows that repeat a doc_id count as one document with the
union of their shingles, and each gives a row.  An empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import bounded_batches, frozen, text_or_empty
from .components import connected_components

WORDS = 5
THRESHOLD = 75
#: frequency classes are 1..TOP; tokens of a class up to RARE are indexed alone
TOP = 127
RARE = 32
#: prefix tokens for each class of token pairs
PER_CLASS = 16
#: groups of signatures whose least shared one stands for a pair
GROUPS = 4
#: postings of one bucket, about; there are at least 2 ** MIN_BITS buckets
BUCKET_TOKENS = 4_000_000
MIN_BITS = 6
#: words of 64 parity bits for a document; they tell some half of as many differing tokens
PARITY_WORDS = 16
_PARITY = tuple(f"bits{q}" for q in range(PARITY_WORDS))
_SIZE_STEP = math.log(1.34)  # a little over 4/3: linked sets are at most one size class apart
_PACKED = ("bucket int, doc_id bigint, n bigint, digest binary, rep bigint, docs binary, counts binary, "
           "low binary, high binary, hot binary, codes array<bigint>")


def shingle_hashes(text: str):
    """Sorted distinct 54-bit hashes of the text's shingles, A-Z lower-cased."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ w[j:n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(10))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _postings(bits: int):
    """Batches of (doc_id, its distinct texts) to packed postings and a row for each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        kinds = {"bucket": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "rep": pa.int64(),
                 "docs": pa.binary(), "counts": pa.binary(), "low": pa.binary(), "high": pa.binary(), "hot": pa.binary(),
                 "codes": pa.list_(pa.int64())}
        shift = np.uint64(54 - bits)
        for batch in batches:
            rows, least = [], {}
            for doc, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingle_hashes(texts[0]) if len(texts) == 1 else np.unique(np.concatenate([shingle_hashes(t) for t in texts]))
                digest = xxhash.xxh3_128_digest(h.tobytes())
                rows.append({"bucket": xxhash.xxh32_intdigest(str(doc)) % (1 << bits), "doc_id": doc, "n": len(h), "digest": digest})
                if len(h):
                    known = least.get((len(h), digest))
                    least[len(h), digest] = (doc if known is None else min(doc, known[0]), h)
            for row in rows:
                row["rep"] = least.get((row["n"], row["digest"]), (row["doc_id"],))[0]
            docs, sets = [d for d, _ in least.values()], [h for _, h in least.values()]
            if docs:
                tokens = np.concatenate(sets)
                owner = np.repeat(np.arange(len(docs)), [len(s) for s in sets])
                distinct, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
                hot = distinct[count >= TOP]
                if len(hot):  # the most frequent class is known here already
                    is_hot = (count >= TOP)[inverse]
                    codes, whose = tokens[is_hot].astype(np.int64) | (TOP << 54), owner[is_hot]
                    tokens, owner = tokens[~is_hot], owner[~is_hot]
                    for d in np.unique(whose).tolist():
                        rows.append({"bucket": xxhash.xxh32_intdigest(str(docs[d])) % (1 << bits), "doc_id": docs[d],
                                     "codes": codes[whose == d].tolist()})
                hot_bucket = (hot >> shift).astype(np.int64)
                bucket = (tokens >> shift).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, owner, bucket = tokens[order], owner[order], bucket[order]
                ids = np.array(docs, dtype=np.int64)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(bucket)].tolist()):
                    if hi > lo:
                        own, counts = np.unique(owner[lo:hi], return_counts=True)
                        t = tokens[lo:hi]
                        rows.append({"bucket": int(bucket[lo]), "docs": ids[own].tobytes(), "counts": counts.astype("u4").tobytes(),
                                     "low": t.astype("u4").tobytes(), "high": (t >> np.uint64(32)).astype("u4").astype("u2").tobytes()})
                for b in np.unique(hot_bucket).tolist():
                    rows.append({"bucket": b, "hot": hot[hot_bucket == b].tobytes()})
            columns = {k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _frequencies(bits: int):
    """A bucket's postings to (doc_id, codes) of tokens in two documents or more; document rows pass."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        passing = table.filter(_is_document(table))
        passing = passing.select(["doc_id", "n", "digest", "rep", "codes"])

        def joined(name, kind):
            return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype=kind)

        low, high = joined("low", "u4"), joined("high", "u2")
        if not len(low):
            return passing
        bucket = np.uint64(table.column("bucket")[0].as_py())
        docs = np.repeat(joined("docs", "i8"), joined("counts", "u4"))
        # the bucket is the token's high bits; those that the packed 48 bits lack come from it
        tokens = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        mask = np.uint64((1 << 48) - 1)
        tokens |= (bucket << np.uint64(54 - bits)) & ~mask
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[starts, len(tokens)])
        hot = np.unique(joined("hot", "u8"))
        count = count + TOP * np.isin(tokens[starts], hot)
        class_ = np.repeat(np.minimum(count, TOP), np.diff(np.r_[starts, len(tokens)]))
        live = class_ >= 2
        codes = (tokens[live].astype(np.int64)) | (class_[live].astype(np.int64) << 54)
        docs = docs[live]
        order = np.argsort(docs, kind="stable")
        codes, docs = codes[order], docs[order]
        if not len(docs):
            return passing
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        n = len(starts)
        found = pa.table({
            "doc_id": pa.array(docs[starts], pa.int64()), "n": pa.nulls(n, pa.int64()), "digest": pa.nulls(n, pa.binary()),
            "rep": pa.nulls(n, pa.int64()),
            "codes": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(docs)].astype("i4")), pa.array(codes, pa.int64()))})
        return pa.concat_tables([passing, found.cast(passing.schema)])

    return run


def _is_document(table):
    import pyarrow.compute as pc

    return pc.or_(pc.is_valid(table.column("digest")), pc.is_valid(table.column("codes")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))


def _repeated_ids(texts: DataFrame) -> DataFrame:
    """doc_id of several rows, frozen; ids alone are read and counted."""
    return frozen(texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"))


def token_lists(docs: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Per doc_id, not null: n, digest, rep (smallest doc_id of its batch with the same set) and live: its tokens that
    other documents have, by frequency class and hash.  The texts of a repeated doc_id are one document."""
    texts = _texts(docs)
    repeated = _repeated_ids(texts) if repeated is None else repeated
    bounded_batches(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(MIN_BITS, math.ceil(math.log2(max(1.0, size / 6 / BUCKET_TOKENS))))
    known = texts.where("doc_id IS NOT NULL")
    if repeated.isEmpty():
        entries = known.select("doc_id", F.array("text").alias("texts"))
    else:
        again = broadcast_if_small(repeated)
        entries = (known.join(again, "doc_id", "left_anti").select("doc_id", F.array("text").alias("texts"))
                   .unionByName(known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))))
    packed = entries.mapInArrow(_postings(bits), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(
        _frequencies(bits), "doc_id bigint, n bigint, digest binary, rep bigint, codes array<bigint>")
    lists = found.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.max("digest").alias("digest"), F.min("rep").alias("rep"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("live"))
    # a document whose shortest prefix has none but its own tokens is linked with nothing
    own = F.col("n") - F.size("live")
    return lists.withColumn("live", F.when((F.col("n") > 0) & (F.col("rep") == F.col("doc_id")) & (own < _prefix(F.col("n"), 1)), F.col("live")))


def _sizes(batches):
    """Batches of (doc_id, text) to doc_id and the size of the text's set."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(shingle_hashes(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_shingles"])


def _prefix(n, k):
    """How many first tokens of n share at least k with any linked set."""
    return n - F.ceil(n * THRESHOLD / 100) + k


def _parities(batches):
    """Batches of (doc_id, n, live) to the same with the parity words of live: of a token, four bits choose the word
    and six the bit in it."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        live = batch.column(2)
        flat = live.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(live)), np.diff(live.offsets.to_numpy()))
        words = np.zeros(len(live) * PARITY_WORDS, dtype="i8")
        np.bitwise_xor.at(words, rows * PARITY_WORDS + flat % PARITY_WORDS, np.left_shift(1, flat // PARITY_WORDS % 64))
        words = words.reshape(-1, PARITY_WORDS)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(words[:, q]) for q in range(PARITY_WORDS)]],
                                         names=["doc_id", "n", "live", *_PARITY])


def _sets(lists: DataFrame) -> DataFrame:
    """One document per distinct set that may link: doc_id, n, live, and the parity words of its live tokens."""
    return lists.where("live IS NOT NULL").select("doc_id", "n", "live").mapInArrow(
        _parities, "doc_id bigint, n bigint, live array<bigint>, " + ", ".join(f"{q} bigint" for q in _PARITY))


def _signatures(sets: DataFrame) -> DataFrame:
    """doc_id, n, own (its tokens that no other document has) and signature: rare tokens alone, frequent ones in pairs within a class."""
    tagged = sets.select("doc_id", "n", "own", "live", F.explode(F.array(*[
        (F.floor(F.log(F.col("n")) / F.lit(_SIZE_STEP)) + F.lit(up)).cast("int") for up in (0, 1)])).alias("tag"))
    # sets with this tag have fewer than 1.34 ** (tag + 1) tokens, a quarter of them in the prefix
    classes = F.greatest(F.lit(1), F.ceil(F.exp((F.col("tag") + 1) * F.lit(_SIZE_STEP)) / (4 * PER_CLASS))).cast("int")
    tagged = tagged.withColumn("classes", classes)
    reach = _prefix(F.col("n"), F.col("classes") + 1) - F.col("own")
    prefix = tagged.withColumn("prefix", F.slice("live", 1, F.greatest(reach, F.lit(0)).cast("int"))).drop("live")
    rare_code = (RARE + 1) << 54
    rare = prefix.select("doc_id", "n", "own", F.explode(F.filter("prefix", lambda c: c < rare_code)).alias("signature")).distinct()
    frequent = (prefix.select("doc_id", "n", "own", "tag", "classes", F.explode(F.filter("prefix", lambda c: c >= rare_code)).alias("code"))
                .groupBy("doc_id", "n", "own", "tag", F.pmod(F.xxhash64("code"), F.col("classes")).alias("class"))
                .agg(F.sort_array(F.collect_list("code")).alias("codes")).where(F.size("codes") > 1))
    # above all token codes, and positive
    pairs = frequent.select("doc_id", "n", "own", F.explode(F.expr(
        "flatten(transform(codes, (x, i) -> transform(slice(codes, i + 2, size(codes)), y -> (xxhash64(tag, x, y) & 4611686018427387903) | 4611686018427387904)))"
    )).alias("signature"))
    return rare.unionByName(pairs)


def _may_link(a: str, b: str):
    """No linked pair fails it: of the symmetric difference, at most a seventh of both sizes when the
    similarity is 3/4, it counts the tokens no other document has and those the parity words tell."""
    differ = sum((F.bit_count(F.col(f"{a}.{q}").bitwiseXOR(F.col(f"{b}.{q}"))) for q in _PARITY), F.lit(0))
    alone = F.col(f"{a}.own") + F.col(f"{b}.own")
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (alone + differ) * (100 + THRESHOLD) <= both * (100 - THRESHOLD)


_BRIEF = ("doc_id", "n", "own", *_PARITY)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    lists = sets.select("doc_id", "n", "live")
    left = lists.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("live").alias("live_a"))
    right = lists.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("live").alias("live_b"))
    shared = F.size(F.array_intersect("live_a", "live_b"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * shared >= THRESHOLD * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    texts = _texts(docs)
    repeated = _repeated_ids(texts)
    lists = frozen(token_lists(texts, repeated))
    briefs = frozen(_sets(lists).withColumn("own", F.col("n") - F.size("live")))
    digests = lists.where("live IS NOT NULL").select("doc_id", "n", "digest")
    tops = frozen(digests.join(digests.groupBy("n", "digest").agg(F.min("doc_id").alias("top")), ["n", "digest"])
                  .select("doc_id", "top"))
    sets = briefs.join(tops.where("doc_id = top").select("doc_id"), "doc_id", "left_semi")
    signatures = frozen(_signatures(sets))
    # Signatures of one document find nothing; the first of each is compared with the others.  An edit
    # makes tokens of its own, so the document with the fewest is the likeliest origin of the rest.
    firsts = (signatures.groupBy("signature").agg(F.min(F.struct("own", "doc_id"))["doc_id"].alias("a"), F.count("*").alias("m"))
              .where("m > 1").drop("m"))
    brief = sets.select(*_BRIEF)
    star = (signatures.join(firsts, "signature").where("doc_id <> a")
            .select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct())
    links = frozen(_verified(_screened(star, brief), sets))
    labels = connected_components(links)
    # signatures whose documents are in several components: all pairs across them
    labelled = (signatures.join(labels, signatures["doc_id"] == labels["node"], "left")
                .select("signature", "doc_id", F.coalesce("component", "doc_id").alias("label")))
    open_ = (labelled.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .where("low <> high").select("signature"))
    rest = frozen(_with_least(labelled.join(open_, "signature", "left_semi")).join(brief, "doc_id"))
    across = (rest.alias("a").join(rest.alias("b"), "signature")
              .where((F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.label") != F.col("b.label")) & _may_link("a", "b")
                     & ~_met_before("a", "b"))
              .select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct())
    more = frozen(_verified(across, sets))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    found = _with_components(lists, tops, labels)
    if not repeated.isEmpty():  # a row for each of theirs
        again = broadcast_if_small(repeated)
        copies = texts.select("doc_id").join(again, "doc_id", "left_semi")
        found = found.join(again, "doc_id", "left_anti").unionByName(
            copies.join(found.join(again, "doc_id", "left_semi"), "doc_id").select("doc_id", "n_shingles", "component_id"))
    nameless = texts.where("doc_id IS NULL").mapInArrow(_sizes, "doc_id bigint, n_shingles bigint")
    return found.unionByName(nameless.withColumn("component_id", F.lit(None).cast("bigint")))


def _with_least(rows: DataFrame) -> DataFrame:
    """Adds the signature's group and, for each group, the document's least signature in it
    (where it has none, a negative number of its own)."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(GROUPS)).cast("int"))
    none = -F.shiftrightunsigned(F.xxhash64("doc_id"), 2) - 1
    least = rows.groupBy("doc_id").agg(*[
        F.coalesce(F.min(F.when(F.col("part") == g, F.col("signature"))), none).alias(f"least{g}") for g in range(GROUPS)])
    return rows.join(least, "doc_id")


def _met_before(a: str, b: str):
    """Whether two documents surely share a signature before this one (by group, then value), so that
    the pair is left to that one.  The first they share is never passed over."""
    here, now = F.col(f"{a}.part"), F.col("signature")
    met = F.lit(False)
    for g in range(GROUPS):  # few and plain: the join compiles them into its loop
        x = F.col(f"{a}.least{g}")
        met = met | ((x == F.col(f"{b}.least{g}")) & ((here > g) | ((here == g) & (now > x))))
    return met


def _screened(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    a, b = brief.alias("x"), brief.alias("y")
    return (pairs.join(a, pairs["a"] == F.col("x.doc_id")).join(b, pairs["b"] == F.col("y.doc_id"))
            .where(_may_link("x", "y")).select(pairs["a"], pairs["b"]))


def _with_components(lists: DataFrame, tops: DataFrame, labels: DataFrame) -> DataFrame:
    """From a document to its batch's smallest with that set, to the smallest of all, to its component's smallest.
    No more documents share a rep than a batch has."""
    named = (tops.join(labels, tops["top"] == labels["node"], "left")
             .select(F.col("doc_id").alias("rep"), F.coalesce("component", "top").alias("component_id")))
    return (lists.select("doc_id", "n", "rep").join(named, "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""
