"""Merkle manifest of a dataset, by nested-interval labels.

Every row is a leaf: the digest of its fields.  The leaves of a source are
ranked by doc_id; runs of ``fanout`` consecutive nodes become their parent until
one node, the source's subroot, remains; the subroots, ordered by source, give
the root the same way.

A node is labelled by the interval [lo, hi) of leaf ranks it covers.

* *Ancestors* come from one containment join for all levels: a node asks at
  each level for the bucket ``lo div fanout ** level``, which holds the one
  node whose interval contains its own.
* *Siblings* are what the node's interval leaves of its parent's: children
  that end at or before its start stand to the left of it, children that start
  at or after its end to the right.

Ranks come from a range-partitioned ordering, so a source with a third of all
rows is spread like any other; runs have at most ``fanout`` members.  Lineage
is cut by a table a level, and the levels grow with the logarithm of the rows.

Nulls in any field are told apart from empty values; a null source is a source
of its own and comes first; null doc_ids come first within their source and
their text is never tampered with.  Rows that repeat a doc_id are leaves of
their own, ordered by their digest.  A source with one row has that leaf as
subroot; with one source its subroot is the root.  An empty table gives an
empty result.  Only the five fields are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..operators.ordering import SMALL_ROWS, row_numbers
from .common import ascii_lower, frozen

FANOUT = 16
#: fixed values: what a leaf's digest covers, in this order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's fields; ``text`` stands in for the text column."""
    return F.sha2(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def is_tampered() -> Column:
    """Every fifth document, by the CRC of its decimal id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _join(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda c: c["digest"]), "")


def _beside(children: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Digests of the children left and right of [lo, hi): the parent's interval less this one."""
    return (_join(F.filter(children, lambda c: c["hi"] <= lo)).alias("left"),
            _join(F.filter(children, lambda c: c["lo"] >= hi)).alias("right"))


def build_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Inner nodes by level from 1: tree, lo, hi, n (leaves of the tree), digest and children (lo, hi, digest).

    ``leaves`` has tree, rank (from 0), n and digest.  A tree stops at the level at which one node is left.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "digest")
    levels, width = [], 1
    while width < largest:
        runs = (nodes.where(F.col("n") > width)
                .groupBy("tree", F.expr(f"lo div {width * fanout}").alias("run"))
                .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"),
                     F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")))
        nodes = frozen(runs.select("tree", "lo", "hi", "n", F.sha2(_join(F.col("children")), 256).alias("digest"), "children"))
        levels.append(nodes)
        width *= fanout
    return levels


def tree_roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree and digest of the one node that remains of each tree."""
    tops = leaves.where("n = 1").select("tree", "digest")
    for nodes in levels:
        tops = tops.unionByName(nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("tree", "digest"))
    return tops


def leaf_paths(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame | None:
    """For every lowest inner node: tree, lo, hi, children and path, the siblings (left, right) of the node itself,
    then of each ancestor up to below the root.  None where no tree has an inner node."""
    if not levels:
        return None
    lowest = levels[0]
    asked = lowest.select("tree", "lo", "hi")
    steps = None
    if len(levels) > 1:
        above = None
        for level, nodes in enumerate(levels[1:], 2):
            rows = nodes.select(F.lit(level).alias("level"), F.expr(f"lo div {fanout ** level}").alias("bucket"),
                                F.col("tree").alias("t"), F.col("lo").alias("from"), F.col("hi").alias("to"), "children")
            above = rows if above is None else above.unionByName(rows)
        wanted = asked.withColumn("level", F.explode(F.sequence(F.lit(2), F.lit(len(levels)))))
        widths = F.create_map(*[F.lit(x) for level in range(2, len(levels) + 1) for x in (level, fanout ** level)])  # fixed: one entry a level
        wanted = wanted.withColumn("width", widths[F.col("level")]).select(
            "tree", "lo", "hi", F.col("level").alias("at"), F.expr("lo div width").alias("place"))
        contained = ((wanted["at"] == above["level"]) & (wanted["place"] == above["bucket"]) & wanted["tree"].eqNullSafe(above["t"])
                     & (above["from"] <= wanted["lo"]) & (wanted["hi"] <= above["to"]))
        steps = (wanted.join(above, contained)
                 .select("tree", "lo", F.struct("level", *_beside(F.col("children"), F.col("lo"), F.col("hi"))).alias("step"))
                 .groupBy("tree", "lo").agg(F.sort_array(F.collect_list("step")).alias("path"))
                 .select(F.col("tree").alias("t"), F.col("lo").alias("at"), "path"))
    empty = F.array().cast("array<struct<level:int,left:string,right:string>>")
    if steps is None:
        return lowest.select("tree", "lo", "hi", "children", empty.alias("path"))
    joined = lowest.join(steps, lowest["tree"].eqNullSafe(steps["t"]) & (lowest["lo"] == steps["at"]), "left")
    return joined.select("tree", "lo", "hi", "children", F.coalesce("path", empty).alias("path"))


def with_proofs(leaves: DataFrame, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (tree, rank, …) with proof: the siblings (left, right) from the leaf up to below its tree's root."""
    paths = leaf_paths(levels, fanout)
    kind = "array<struct<left:string,right:string>>"
    if paths is None:
        return leaves.withColumn("proof", F.array().cast(kind))
    paths = paths.select(F.col("tree").alias("t"), F.col("lo").alias("from"), F.col("hi").alias("to"), "children", "path",
                         F.expr(f"lo div {fanout}").alias("bucket"))
    on = (leaves["tree"].eqNullSafe(paths["t"]) & (F.expr(f"rank div {fanout}") == paths["bucket"])
          & (paths["from"] <= leaves["rank"]) & (leaves["rank"] < paths["to"]))
    own = F.struct(*_beside(F.col("children"), F.col("rank"), F.col("rank") + 1))
    above = F.transform(F.col("path"), lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    proof = F.when(F.col("children").isNull(), F.array().cast(kind)).otherwise(F.concat(F.array(own), above))
    return leaves.join(paths, on, "left").select(*leaves.columns, proof.alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def dataset_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, rank (in its source), leaf, forged (its digest after the tampering, if any), subroot, root and
    proof (left and right siblings, from the leaf via the subroot to the root) of every row."""
    tampered = F.when(is_tampered(), leaf_digest(ascii_lower(F.col("text").cast("string"))))
    rows = frozen(docs.select("doc_id", F.col("source").alias("tree"), leaf_digest().alias("digest"), tampered.alias("forged")))
    ranked = row_numbers(rows, [F.col("doc_id").asc_nulls_first(), "digest"], partition_by=["tree"], rn="rank", size="n")
    leaves = frozen(ranked.withColumn("rank", F.col("rank") - 1))
    levels = build_levels(leaves, fanout)
    subroots = frozen(tree_roots(leaves, levels))
    order = row_numbers(subroots, [F.col("tree").asc_nulls_first()], rn="rank", small_rows=SMALL_ROWS)
    tops = frozen(order.select(F.col("tree").alias("source"), F.lit(0).alias("tree"), (F.col("rank") - 1).alias("rank"), "digest",
                               subroots.agg(F.count("*")).scalar().alias("n")))
    top_levels = build_levels(tops, fanout)
    root = tree_roots(tops, top_levels).select("digest").scalar()
    sources = frozen(with_proofs(tops, top_levels, fanout).select(
        F.col("source").alias("s"), F.col("digest").alias("subroot"), F.col("proof").alias("onward"), root.alias("root")))
    found = with_proofs(leaves, levels, fanout)
    return found.join(broadcast_if_small(sources), found["tree"].eqNullSafe(sources["s"])).select(
        "doc_id", F.col("tree").alias("source"), "rank", F.col("digest").alias("leaf"), "forged", "subroot", "root",
        F.concat("proof", "onward").alias("proof"))


def verified_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest with the proof's digest, the root recomputed after the tampering, and whether it is the root."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return dataset_manifest(docs, fanout).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("forged", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 5 = 0 AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM d),
nodes(source, level, pos, n, digest) AS (
  SELECT source, 0::BIGINT, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16, n),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0::BIGINT, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
runs AS (SELECT source, level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM tops WHERE n > 1 GROUP BY ALL),
fold(doc_id, source, level, pos, acc, siblings) AS (
  SELECT doc_id, source, 0::BIGINT, pos, coalesce(forged, leaf), '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.source, f.level + 1, f.pos // 16,
         sha256(array_to_string(kids[:f.pos % 16], '') || acc || array_to_string(kids[f.pos % 16 + 2:], '')),
         siblings || array_to_string(kids[:f.pos % 16], '') || array_to_string(kids[f.pos % 16 + 2:], '')
  FROM fold AS f JOIN runs AS r ON r.source IS NOT DISTINCT FROM f.source AND r.level = f.level AND r.run = f.pos // 16),
half AS (
  SELECT f.doc_id, s.digest AS subroot, s.pos, f.acc, f.siblings
  FROM (SELECT *, max(level) OVER (PARTITION BY doc_id) AS last FROM fold) AS f
  JOIN subroots AS s ON s.source IS NOT DISTINCT FROM f.source WHERE level = last),
whole(doc_id, subroot, level, pos, acc, siblings) AS (
  SELECT doc_id, subroot, 0::BIGINT, pos, acc, siblings FROM half
  UNION ALL
  SELECT doc_id, subroot, f.level + 1, f.pos // 16,
         sha256(array_to_string(kids[:f.pos % 16], '') || acc || array_to_string(kids[f.pos % 16 + 2:], '')),
         siblings || array_to_string(kids[:f.pos % 16], '') || array_to_string(kids[f.pos % 16 + 2:], '')
  FROM whole AS f JOIN top_runs AS r ON r.level = f.level AND r.run = f.pos // 16)
SELECT w.doc_id, l.leaf, w.subroot, t.digest AS root, sha256(w.siblings) AS proof_sha256, w.acc AS folded_root, w.acc = t.digest AS verified
FROM whole AS w JOIN leaves AS l USING (doc_id) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) AS t
WHERE w.level = (SELECT max(level) FROM tops)
"""
