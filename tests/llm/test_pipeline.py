"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from retentio.llm import language_id  # noqa: E402

from .test_jaccard import ASCII, brute  # noqa: E402
from .test_language_id import SYLLABLES  # noqa: E402
from .test_pii import BASE, base_spans, holds  # noqa: E402
from .test_tokenizers import check_packing  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed=1, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(rng.randint(20, 120))]
        if i % 7 == 0:
            words.insert(10, rng.choice(["joe.x@example.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (684) 555-0954"]))
        rows.append([" ".join(words), lang])
    for i in range(20):
        rows.append([rows[i][0].upper() if i % 2 else rows[i][0], rows[i][1]])
    for i in range(20, 40):
        w = rows[i][0].split()
        w[-1] = "changed"
        rows.append([" ".join(w), rows[i][1]])
    rows += [[None, None], ["", "en"], ["123 456", None], ["!!", "de"]]
    return [(i, t, lang, f"s{i % 3}", len(t) if t else None) for i, (t, lang) in enumerate(rows)]


def expected(rows, spark):
    """Texts by doc_id after all filters."""
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs)
    predict = language_id.predictor(model)
    alive = {}
    for doc_id, text, *_ in rows:
        _, (score,) = predict([text or ""])
        if score >= corpus_pipeline.MIN_SCORE and any(c.isalpha() for c in text or ""):
            alive[doc_id] = text
    keep = {}
    for doc_id, text in alive.items():
        keep[text.translate(ASCII)] = max(doc_id, keep.get(text.translate(ASCII), -1))
    alive = {i: alive[i] for i in sorted(keep.values())}
    ids = list(alive)
    groups = brute([alive[i] for i in ids])
    alive = {i: alive[i] for k, i in enumerate(ids) if groups[k][1] == k}
    for i, t in alive.items():
        end, out = 0, ""
        for a, b, kind in sorted((a, b, k) for k, a, b in base_spans(t)):
            if a >= end:
                out += t[end:a] + f"[{kind}]"
            end = max(end, b)
        alive[i] = out + t[end:]
    return alive


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_run_equals_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = expected(rows, spark)
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    final = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in final.items()} == want
    assert all(r.n_chars == len(r.text) for r in final.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(want)
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).count() == len(packed)
    assert BASE and holds("email", "a@b.c") and check_packing


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", norm string, h string, live string, spans string, ends string, row string")
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == empty.columns


def test_stages_with_nulls_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows] + [(None, "the " * 30, None, None, None, "x", "y", "z")],
                                 SCHEMA + ", norm string, rep string, version string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert {r.norm for r in docs.collect()} == {"x"}, name
    assert None in {r.doc_id for r in docs.collect()}
