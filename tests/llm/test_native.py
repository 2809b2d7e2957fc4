"""Exact duplicates and quality rules against brute force."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from retentio.llm import exact_dedup, quality

from .conftest import TEXTS, by_id, frame

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_hash(norm):
    """Every text of one length collides."""
    return F.length(norm).cast("string").cast("binary")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, same_hash])
def test_exact_duplicates(docs, keep, hash_of):
    norm = [(t or "").translate(ASCII) for t in TEXTS]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    out = by_id(exact_dedup.exact_duplicates(docs, keep, hash_of), "keep_id", "group_size", "kept", "text_sha256")
    assert len(out) == len(TEXTS)
    for i, t in enumerate(norm):
        stays = (max if keep == "largest" else min)(groups[t])
        assert out[i] == (stays, len(groups[t]), i == stays, hashlib.sha256(t.encode()).hexdigest())


def test_exact_duplicates_of_repeated_rows_null_ids_and_no_rows(spark, no_docs):
    rows = exact_dedup.exact_duplicates(frame(spark, [(1, "a"), (1, "A"), (None, "a"), (None, "z")])).collect()
    assert len(rows) == 4
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows if r.keep_id) == [
        (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def no_trust(spark):
    return spark.createDataFrame([], "doc_id bigint")


def test_base_rules(spark, docs):
    word = r"[^\x20\x09-\x0D]+"
    out = by_id(quality.quality_rules(docs, no_trust(spark)), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words", "base_failed", "kept")
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(word, t)
        count = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if count[tuple(w[j:j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if re.search(word, x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert out[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                          len(covered), failed, not failed), t[:60]


def test_ratio_tells_trusted_from_junk(spark):
    good = [(i, " ".join(f"{a}{b}tion{i}ed" for a in "abcdefghijklm" for b in "uvwxyz") + f" w{i}") for i in range(30)]
    junk = [(100 + i, " ".join(f"{a}{b}{i}&&&" for a in "pqrs" for b in "xyz") + f" v{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(100, 0, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    out = by_id(quality.quality_rules(frame(spark, good + junk), quality.trusted_sample(labels)), "kept", "llr")
    assert all(out[i][0] for i, _ in good) and not any(out[i][0] for i, _ in junk)
    assert quality.trusted_sample(labels, 3).count() == 3


def test_quality_of_no_rows(spark, no_docs):
    assert quality.quality_rules(no_docs, no_trust(spark)).count() == 0


def test_lines_of_separators_and_of_letters(spark):
    """A line has a word unless it holds separators only; the letters that name them in escapes are words."""
    texts = ["f\nf\nff\nff", "a\n\x0c\n\x0c\nb", "\n".join("bfnrtv" * 2), "x\n \t\x0b\x0c\r\n \t\x0b\x0c\r\nx",
             *[f"a\n{c}\n{c}\na" for c in " \t\x0b\x0c\r"], "\\f\n\\f\nu000c\nu000c"]
    got = by_id(quality.quality_rules(frame(spark, list(enumerate(texts))), no_trust(spark)), "n_dup_lines")
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i] == len(lines) - len(set(lines)), t
