"""Counts by brute force, gradients by finite differences, probabilities that sum to one, held-out gain."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from retentio.llm import lm_score as M

from .conftest import TEXTS, frame

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    c, n = collections.Counter(), 0
    for i, t in rows:
        if not is_held_out(i):
            c.update([*words(t), None])
            n += len(words(t)) + 1
    out = {}
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens)
        out[i] = (is_held_out(i), len(tokens), sum(c[w] > 0 for w in tokens), n, base)
    return out


def corpus(n=300, seed=2):
    """Words that follow from the one before, so a model of sequences can gain on counts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, text = 0, []
        for _ in range(rng.randint(0, 150)):
            w = (w * 7 + rng.choice([1, 2])) % 60
            text.append(f"w{w}" if rng.random() < 0.95 else f"rare{rng.randint(0, 400)}")
        rows.append((i, " ".join(text)))
    return rows


def check(out, rows):
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        held, n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-8 * max(1, abs(base)) and r.score < 0


def test_counts_and_base_scores(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in corpus(60)]
    check(M.lm_scores(frame(spark, rows), head=20, vocab=10).collect(), rows)
    check(M.lm_scores(frame(spark, rows)).collect(), rows)


def test_held_out_texts_score_better_than_by_counts(spark):
    rows = corpus()
    out = M.lm_scores(frame(spark, rows).coalesce(2), every=1).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # both below 0


def small(classes=4):
    m = M.Gru([30, 20, 9, 9, 5, 3, 1], 4, 6, classes=classes, hidden=5, seed=1)
    rng = np.random.default_rng(5)
    m.p = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in m.p.items()}
    return m


def test_gradients_match_finite_differences():
    m, rng = small(), np.random.default_rng(0)
    x, y = rng.integers(0, 9, (6, 3)), rng.integers(0, 9, (6, 3))
    state = rng.normal(0, 0.3, (3, 5))
    _, g, _ = m.gradients(x, y, state)
    for name, v in m.p.items():
        for _ in range(6):
            at, d = tuple(rng.integers(0, s) for s in v.shape), 1e-5
            old = v[at]
            v[at] = old + d
            up = m.gradients(x, y, state)[0]
            v[at] = old - d
            down = m.gradients(x, y, state)[0]
            v[at] = old
            assert abs((up - down) / (2 * d) - g[name][at]) < 1e-6, name


def test_probabilities_sum_to_one():
    m = small()
    states = np.random.default_rng(3).normal(0, 1, (4, 5))
    for s in states:
        p = np.exp(m.log_probs(np.repeat(s[None], 9, axis=0), np.arange(9)))
        assert abs(p.sum() - 1) < 1e-9
    known = M.Corpus([(b"a", 5), (b"b", 3), (b"c", 1)], n=20, words=7, ends=4, vocab=2)
    counts = [1, 2, 2, 1, 2]  # of the five words outside the vocabulary; "c" and four more
    assert known.outside == sum(c + 1 for c in counts) + 1


def test_state_is_carried_over_windows_and_documents_do_not_mix():
    m, rng = small(), np.random.default_rng(8)
    docs = [rng.integers(0, 8, n) for n in (0, 1, 3, 64, 65, 200, 7)]
    alone = [m.document_log_probs([d], window=1000)[0] for d in docs]
    assert np.allclose(m.document_log_probs(docs, window=8, chunk=50), alone)
    assert np.allclose(m.document_log_probs(docs, window=64), alone)
    d, state, total = np.r_[m.end, docs[4]], np.zeros((1, 5)), 0.0
    for x, y in zip(d, np.r_[docs[4], m.end]):
        state = m.step(m.tables()[[x]], state)[-1]
        total += m.log_probs(state, np.array([y]))[0]
    assert abs(total - alone[4]) < 1e-6
    assert m.document_log_probs([]).shape == (0,)


def test_repeated_rows_null_ids_no_training_and_no_rows(spark, no_docs):
    rows = [(2, "a b zz"), (2, "a b zz"), (2, "other text"), (None, "a q")]
    out = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in M.lm_scores(frame(spark, rows), head=1).collect())
    assert out == [(0, 3, 2), (2, 3, 3), (2, 4, 4), (2, 4, 4)]
    held = next(i for i in range(100) if is_held_out(i))
    (r,) = M.lm_scores(frame(spark, [(held, "a b")])).collect()
    assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and abs(r.base_score) < 1e-9 and r.score < 0
    assert M.lm_scores(no_docs).count() == 0
    assert F


def test_all_learnable_documents_train_by_default(spark):
    rows = corpus()
    out = M.lm_scores(frame(spark, rows).coalesce(2)).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    for i in [i for i in range(20) if not is_held_out(i)][:2]:  # one document, whatever its hash
        docs = frame(spark, [(i, "a b c d " * 300)])
        known = M.learn_corpus(docs, M.word_counts(docs))
        assert not np.array_equal(M.train(docs, known).flat(), known.model().flat())


def test_blocks_are_whole_documents_and_leave_no_short_rest():
    docs = [np.full(n, i) for i, n in enumerate([3, 5, 1, 9, 2, 2, 20, 1])]
    for size in (1, 4, 10, 100):
        out = list(M.blocks(iter(docs), size))
        assert np.array_equal(np.concatenate(out), np.concatenate(docs))
        assert len(out) == 1 or min(map(len, out)) >= size
        assert not any(a[-1] == b[0] for a, b in zip(out, out[1:]))
    assert list(M.blocks(iter([]), 4)) == []


def test_training_in_blocks_goes_on(monkeypatch):
    rng = np.random.default_rng(4)
    tokens = np.concatenate([np.r_[rng.integers(0, 7, n), 8] for n in rng.integers(0, 40, 200)])
    whole, parts = (M.Gru([30, 20, 9, 9, 5, 3, 1], 4, 6, classes=4, hidden=5) for _ in range(2))
    whole.fit(tokens, window=10, streams=1)
    cut = int(np.flatnonzero((tokens == 8) & ((np.arange(len(tokens)) + 1) % 10 == 0))[3]) + 1
    parts.fit(tokens[:cut], window=10, streams=1)
    parts.fit(tokens[cut:], window=10, streams=1)
    assert np.allclose(whole.flat(), parts.flat(), atol=1e-5)


def test_scores_do_not_depend_on_partitions(spark):
    rows = corpus()
    whole, cut = ({r.doc_id: r.score for r in M.lm_scores(frame(spark, rows).repartition(n)).collect()} for n in (1, 16))
    assert whole.keys() == cut.keys() and all(abs(whole[i] - cut[i]) < 1e-4 * abs(whole[i]) for i in whole)


def test_no_token_is_left_out_of_training():
    """A block that the streams don't divide is filled up, not cut."""
    m = small()
    seen = []
    m.gradients = lambda x, y, state: seen.append(y) or (0.0, {k: np.zeros_like(v) for k, v in m.p.items()}, state)
    tokens = np.arange(2007) % 9
    m.fit(tokens, window=5, streams=4)
    streams = np.concatenate(seen)
    assert np.array_equal(streams.T.ravel()[:2007], tokens) and streams.size - 2007 < streams.shape[1]


def test_arrow_words_are_the_words():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS]
    found, owners = M.words_of(pa.array(texts))
    assert found.to_pylist() == [w for t in texts for w in words(t)]
    assert owners.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]


def test_texts_are_split_into_ids_once_for_all_rounds(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in corpus(60)]
    docs = frame(spark, rows)
    known = M.learn_corpus(docs, M.word_counts(docs), head=20, vocab=10)
    table = M.encoded(docs, known)
    at = {w.decode(): i for i, w in enumerate(known.words)}
    for r in table.collect():
        tokens = words(dict(rows)[r.row.doc_id])
        assert np.frombuffer(r.ids, M.id_type(10)).tolist() == [min(at.get(w, 10), 10) for w in tokens]
        assert (r.once.n_words, r.rare) == (len(tokens), [w for w in tokens if w not in at])
    whole = M.train(docs, known, copy_tokens=1000).flat()
    known.words = []  # training meets neither texts nor words
    assert np.allclose(M.train_encoded(table.drop("rare", "once"), known, copy_tokens=1000).flat(), whole, atol=1e-5)


def test_scores_are_made_in_bounded_chunks():
    m, sizes, real = small(), [], M.Gru.log_probs
    m.log_probs = lambda states, *a: sizes.append(len(states)) or real(m, states, *a)
    docs = [np.arange(70) % 7] * 30
    m.document_log_probs(docs, chunk=100)
    assert sum(sizes) == 71 * 30 and max(sizes) < 100 + 30
