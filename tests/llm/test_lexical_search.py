"""Ranked search against scoring every document."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import lexical_search

from .conftest import TEXTS, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    count = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in count), sum(c.total() for _, c in count)
    df = collections.Counter(t for _, c in count for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item].update(terms(text))
    out = []
    for item, ts in wanted.items():
        found = []
        for doc, c in count:
            m = 10 + 90 * c.total() * n_docs // length if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in ts if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("doc_id", F.lit("x")).withColumn("term", F.lit(1))


def ranked(*args, **kwargs):
    return sorted(map(tuple, lexical_search.ranked_search(*args, **kwargs).collect()), key=str)


def test_tree_finds_every_best_document_and_prunes():
    rng = np.random.default_rng(3)
    n, dims = 3000, 400
    # documents of 20 subjects: common words, and words of their subject
    rows = [np.unique(np.r_[rng.integers(0, 200, 30), 200 + 10 * (i % 20) + np.arange(10)]) for i in range(n)]
    ptr = np.r_[0, np.cumsum([len(r) for r in rows])]
    idx = np.concatenate(rows)
    val = rng.integers(500, 1000, len(idx)) * np.where(idx < 200, 1, 40_000_000)
    tree = lexical_search.BallTree(ptr, idx, val, dims)
    dense = np.zeros((n, dims), dtype="i8")
    for i in range(n):
        dense[i, idx[ptr[i]:ptr[i + 1]]] = val[ptr[i]:ptr[i + 1]]
    leaves, visited = sum(x < 0 for x in tree.left), []
    for q in range(20):
        wanted = np.unique(np.r_[rng.integers(0, 200, 4), 200 + 10 * q + rng.integers(0, 10, 5)])
        exact = dense[:, wanted].sum(axis=1)
        bounds = tree.bounds(wanted)
        for node, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
            assert exact[tree.order[lo:hi]].max() <= bounds[node]
        best: list = []

        def offer(docs, scores):
            best.extend(scores.tolist())
            best.sort(reverse=True)
            del best[10:]
            return best[-1] if len(best) == 10 else 1

        visited.append(tree.search(wanted, offer, 1))
        assert best == sorted(exact.tolist(), reverse=True)[:10]
    assert sum(visited) < 0.5 * leaves * len(visited)


@pytest.mark.parametrize("block_pairs,tree_docs", [(10_000, 8192), (3, 4)])
def test_search_ranks_like_scoring_all(spark, monkeypatch, block_pairs, tree_docs):
    monkeypatch.setattr(lexical_search, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(lexical_search, "TREE_ENTRIES", 9 * tree_docs)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(200 + i, "W1 w2, w3;w1") for i in range(14)]  # ties
    docs += [(None, "w1 w2"), (7, "w9 w9 w9"), (7, "w9 w9 w9"), (None, None)]
    items = [(1, "w1 w2 w1"), (2, "nothing of it"), (3, ""), (4, None), (None, "w9"), (5, "w50."), (5, "w51"), (6, " ".join(words))]
    out = ranked(frame(spark, docs), items_of(spark, items), block_pairs=block_pairs)
    assert out == brute(docs, items)


def test_odd_texts_and_other_k(spark):
    items = [(i, t) for i, t in enumerate(TEXTS)]
    assert ranked(frame(spark), items_of(spark, items), k=3) == brute(list(enumerate(TEXTS)), items, 3)


def test_string_ids_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    got = lexical_search.ranked_search(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, None), ("q", 2, "a"), ("q", 3, "b")] or \
        [(r.item_id, r.rank, r.doc_id) for r in got][1:] == [("q", 2, "b"), ("q", 3, None)]
    assert ranked(no_docs, items_of(spark, [(1, "a")])) == []
    assert ranked(frame(spark), items_of(spark, [])) == []
