"""Gradients by finite differences, table look-up against plain convolution, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from retentio.llm import language_id as L

from .conftest import TEXTS, frame


def model():
    return L.ByteCnn(["a", "b", "c"], seed=3)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (4, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    m = model()
    _, g = m.gradients(x, y)
    for name, v in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in v.shape)
            if name == "embed":
                at = (int(rng.integers(97, 105)), at[1])
            old, d = v[at], 1e-5
            v[at] = old + d
            up = m.gradients(x, y)[0]
            v[at] = old - d
            down = m.gradients(x, y)[0]
            v[at] = old
            assert abs((up - down) / (2 * d) - g[name][at]) < 1e-4, name


def test_look_up_equals_convolution():
    m = model()
    texts = ["", "a", "abc", "Größe und mehr " * 60, "x" * 253, "y" * 254, "z" * 1000]
    langs, scores = L.predictor(m, chunk=3)(texts)
    for text, lang, score in zip(texts, langs, scores):
        x, sizes = L.windows_of(text.encode())
        found = []
        for window in x:
            e = m.p["embed"][window]
            pooled = []
            for w in L.WIDTHS:
                r = [sum(e[p + j] @ m.p[f"filter{w}"][j] for j in range(w)) + m.p[f"bias{w}"]
                     for p in range(L.WINDOW - L.OVERLAP)]
                pooled.append(np.max(r, axis=0))
            z = np.maximum(np.concatenate(pooled), 0) @ m.p["out"] + m.p["out_bias"]
            found.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        p = (np.array(found) * sizes[:, None]).sum(axis=0) / sizes.sum()
        assert lang == m.langs[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_windows_cover_every_run_of_four_bytes():
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 5000):
        data = bytes(i * 7 % 251 + 1 for i in range(n))
        x, sizes = L.windows_of(data)
        seen = b"\n\n\n\n".join(r.tobytes() for r in x)
        assert all(data[i:i + 4] in seen for i in range(max(1, n - 3))) and len(sizes) == len(x)


SYLLABLES = {"en": "th er on an re he in ed".split(), "de": "sch ein ung ver lich ber ß ü".split(), "fr": "eau oi que è é ment tion".split()}


def corpus(n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 300))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_no_peeking(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string")
    out = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 240
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    hidden = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in L.identify(hidden, L.train(hidden)).collect()}
    assert again == {r.doc_id: r.lang_pred for r in out}  # held-out labels change nothing


def test_undetermined_unlabelled_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame(corpus(60), "doc_id bigint, text string, lang string")
    m = L.train(docs)
    rows = {r.doc_id: r for r in L.identify(frame(spark, extra=False), m).collect()}
    for i, t in enumerate(TEXTS):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert L.train(frame(spark)) is None  # every lang is null
    assert {r.lang_pred for r in L.identify(frame(spark), None).collect()} == {"und"}
    assert L.train(no_docs) is None and L.identify(no_docs, m).count() == 0
    twice = spark.createDataFrame([(1, "the", "en"), (1, "the", "en"), (None, "und", None)], "doc_id bigint, text string, lang string")
    assert L.identify(twice, m).count() == 3


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(90), "doc_id bigint, text string, lang string")
    x, langs = L.training_windows(docs, per_lang=5, rows=12)
    assert len(x) == len(langs) <= 12 * L.WINDOWS_PER_DOC and len(set(langs)) == 3


def test_rare_languages_keep_their_places_in_a_large_table(spark):
    lang = F.when(F.col("id") % 25_000 == 7, "rare").when(F.col("id") % 250_000 == 8, "few").otherwise("en")
    docs = spark.range(2_000_000).select(F.col("id").alias("doc_id"), F.concat(lang, F.lit(" text")).alias("text"), lang.alias("lang"))
    counts = {r["lang"]: r.n for r in docs.where(~L.held_out(F.col("doc_id"))).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    _, langs = L.training_windows(docs, per_lang=40, rows=1000)
    assert {k: langs.count(k) for k in counts} == {k: min(n, 40) for k, n in counts.items()}


def test_repeated_rows_take_one_place(spark):
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learned[0], f"the same {k}", "en") for k in range(50)] + [(i, "the other", "en") for i in learned[1:10]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    x, langs = L.training_windows(docs, per_lang=10, rows=100)
    assert langs == ["en"] * 10
    assert sum(bytes(w).startswith(b"the same") for w in x) == 1
