"""The Merkle manifest against a tree folded by hand."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from retentio.llm import merkle

from .conftest import TEXTS, frame

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """The root and, for each leaf, its (left, right) siblings up to below it."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at // fanout * fanout
            proofs[k].append((nodes[run:at], nodes[at + 1:run + fanout]))
        place = [at // fanout for at in place]
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by_source = [sorted((r for r in rows if r["source"] == s),
                        key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in sources]
    trees = [tree([leaf(r, r["text"]) for r in rs], fanout) for rs in by_source]
    root, onward = tree([t[0] for t in trees], fanout)
    out = []
    for rs, (subroot, proofs), more in zip(by_source, trees, onward):
        for r, proof in zip(rs, proofs):
            whole = proof + more
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold = leaf(r, r["text"].translate(UPPER) if tampered and r["text"] is not None else r["text"])
            for left, right in whole:
                fold = digest(*left, fold, *right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, digest(*[x for a, b in whole for x in a + b]), fold, fold == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars int, text string")


def rows_of(n, source_of, text_of=lambda i: f"Text {i}"):
    return [{"doc_id": i, "source": source_of(i), "lang": "en" if i % 3 else None, "n_chars": i if i % 4 else None,
             "text": text_of(i)} for i in range(n)]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_of_many_sizes(spark, fanout):
    # one source with a third of all rows, sources of one row, of a full run, and none
    rows = rows_of(140, lambda i: "hot" if i % 3 == 0 else None if i % 17 == 1 else "ß" if i == 1 else "ab"[i % 2] if i % 5 else f"s{i}")
    out = merkle.verified_manifest(table(spark, rows), fanout).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, fanout)
    assert any(not r.verified for r in out) and any(r.verified for r in out)


def test_one_source_one_row_and_no_rows(spark):
    one = rows_of(1, lambda i: "a")
    assert [tuple(r) for r in merkle.verified_manifest(table(spark, one)).collect()] == brute(one, 16)
    single = rows_of(40, lambda i: None)
    assert sorted(map(tuple, merkle.verified_manifest(table(spark, single)).collect()), key=str) == brute(single, 16)
    assert merkle.verified_manifest(table(spark, [])).collect() == []


def test_odd_texts_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = rows_of(len(TEXTS), lambda i: ("x", "", None)[i % 3], lambda i: TEXTS[i])
    rows += [{**rows[3], "doc_id": None}, {**rows[4], "doc_id": None}, rows[5], rows[5], {**rows[5], "text": "other"}]
    df = table(spark, rows)
    for name in ("tree", "rank", "n", "lo", "hi", "digest", "children", "proof", "leaf", "path", "level"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, merkle.verified_manifest(df, 3).collect()), key=str) == brute(rows, 3)


def test_every_change_of_a_field_changes_the_root(spark):
    rows = rows_of(5, lambda i: "a")
    root = brute(rows, 16)[0][3]
    for name, value in (("text", None), ("text", ""), ("lang", "fr"), ("n_chars", 77), ("doc_id", 99)):
        changed = [{**r, name: value} if r["doc_id"] == 2 else r for r in rows]
        out = merkle.verified_manifest(table(spark, changed)).first()
        assert out.root == brute(changed, 16)[0][3] != root


def test_manifest_of_a_frame_without_the_ids_type(spark):
    out = merkle.verified_manifest(frame(spark).withColumn("doc_id", F.col("doc_id").cast("int"))).collect()
    assert len(out) == len(TEXTS) and len({r.root for r in out}) == 1
