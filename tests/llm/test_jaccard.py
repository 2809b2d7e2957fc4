"""The similarity join against all pairs by brute force."""

from __future__ import annotations

import random
import re

import pytest

from retentio.llm import jaccard
from retentio.llm.components import connected_components

from .conftest import TEXTS, by_id, frame

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed):
    """Copies, chains of edits, texts around the threshold, and passages that dissimilar texts share."""
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randint(0, 3000)}" for _ in range(n)]

    passages = [words(60) for _ in range(3)]
    texts = []
    for _ in range(12):
        base = words(rng.choice([3, 5, 6, 9, 30, 80, 300]))
        family = [base]
        for _ in range(rng.randint(1, 14)):
            new = list(rng.choice(family))
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(new) // 40)])):
                new[rng.randrange(len(new))] = f"e{rng.randint(0, 10 ** 6)}"
            family.append(new)
        texts += [" ".join(f) for f in family]
    for _ in range(50):
        texts.append(" ".join(words(rng.randint(5, 120)) + rng.choice(passages) + words(rng.randint(0, 40))))
    texts += [t.upper() for t in texts[:8]] + texts[:5]
    rng.shuffle(texts)
    return TEXTS + texts


@pytest.mark.parametrize("seed,rare,per_class,top", [(1, 32, 16, 127), (2, 2, 2, 5), (3, 1, 3, 3), (4, 1, 16, 127)])
def test_components_equal_brute_force(spark, monkeypatch, seed, rare, per_class, top):
    for name, value in (("RARE", rare), ("PER_CLASS", per_class), ("TOP", top)):
        monkeypatch.setattr(jaccard, name, value)
    texts = corpus(seed)
    out = by_id(jaccard.similar_documents(frame(spark, list(enumerate(texts))).repartition(3)), "n_shingles", "component_id")
    assert out == brute(texts)


def test_small_buckets_keep_tokens_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", 10)  # more buckets than the packed bits need
    texts = corpus(5)[:120]
    assert by_id(jaccard.similar_documents(frame(spark, list(enumerate(texts)))), "n_shingles", "component_id") == brute(texts)


def test_screen_never_rejects_a_link(spark, monkeypatch):
    texts = corpus(6)
    lists = jaccard.token_lists(frame(spark, list(enumerate(texts))))
    from pyspark.sql import functions as F

    briefs = jaccard._sets(lists).withColumn("own", F.col("n") - F.size("live")).cache()
    both = briefs.alias("x").join(briefs.alias("y"), F.col("x.doc_id") < F.col("y.doc_id"))
    passed = {(r.i, r.j) for r in both.where(jaccard._may_link("x", "y")).select(
        F.col("x.doc_id").alias("i"), F.col("y.doc_id").alias("j")).collect()}
    here = {r.doc_id for r in briefs.collect()}
    sets = {i: shingles(texts[i]) for i in here}
    for i in here:
        for j in here:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert (i, j) in passed


def test_repeated_rows_null_ids_and_no_rows(spark, no_docs):
    rows = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.similar_documents(rows).collect() if r.doc_id)
    assert got == [(3, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert sorted(r.n_shingles for r in jaccard.similar_documents(rows).collect() if r.doc_id is None) == [0, 2]
    assert jaccard.similar_documents(no_docs).count() == 0


def test_components_of_chains_stars_and_none(spark):
    rng = random.Random(4)
    nodes = rng.sample(range(10_000), 600)
    chain = list(zip(nodes[:300], nodes[1:300]))
    star = [(nodes[300], n) for n in nodes[301:500]]
    links = spark.createDataFrame([*chain, *star, (nodes[500], nodes[500])], "a bigint, b bigint")
    out = by_id(connected_components(links).withColumnRenamed("node", "doc_id"), "component")
    for group in (nodes[:300], nodes[300:500]):
        assert {out[n] for n in group} == {min(group)}
    assert len(out) == 500
    assert connected_components(links.where("a < 0")).count() == 0


def test_repeated_ids_with_other_texts_are_one_document(spark):
    """Doc 1 is the union of A and B, too unlike either to link with it; equal texts under one id change nothing."""
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 40), ("b", 60)))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a), (4, a), (5, b + " more"), (5, b + " more")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(frame(spark, rows)).collect())
    assert got == [(1, 92, 1), (1, 92, 1), (2, 36, 2), (3, 56, 3), (4, 36, 2), (4, 36, 2), (5, 57, 3), (5, 57, 3)]


def test_many_null_ids(spark):
    rows = [(None, f"w{i % 7} " * 9 + "one two three") for i in range(300)] + [(8, "w1 " * 9 + "one two three"), (9, "w1 " * 9 + "one two three")]
    out = jaccard.similar_documents(frame(spark, rows)).collect()
    assert len(out) == 302 and {r.component_id for r in out if r.doc_id is None} == {None}
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id} == {(8, 8), (9, 8)}
    assert {r.n_shingles for r in out} == {len(shingles(rows[0][1]))}
