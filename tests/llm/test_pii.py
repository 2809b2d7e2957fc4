"""Personal data against Python's regular expressions, and the bootstrapping on planted contexts."""

from __future__ import annotations

import hashlib
import random
import re

from retentio.llm import pii

from .conftest import TEXTS, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split("."))
            or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15)


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if holds(k, m[0])]


def odd_texts():
    rng = random.Random(11)
    parts = ["a@b.com", "_x@d.org", "@", ".", "1.2.3.4", ".5", "255", "256", "0255", " ", "-", "4111111111111111", "4", "1",
             "4012 8888 8888 1881", "+1", "(684) 555-0954", "+49.30.1234567", "é", "😀", "x", "+", "%", "user.name+tag@sub.host-x.co",
             "..", "@x", "00000000000000000000000000000000000000000000000001.2.3.4", "\n"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(500)] + [
        "9" * 30_000, "a" * 30_000 + "@", "+" + "1(" * 20_000, "1." * 20_000, "a@b.c " * 300, "x@" * 5_000]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark):
    texts = TEXTS + odd_texts()
    out = pii.personal_data(frame(spark, list(enumerate(texts)))).select(
        "doc_id", pii.listed(pii.KINDS[:4]).alias("spans")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.spans == listed(base_spans(texts[r.doc_id])), texts[r.doc_id][:100]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def planted():
    rng = random.Random(2)
    docs = [f"intro {i} my passport no +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} end" for i in range(30)]
    docs += ["his passport no AB1234567 here", "the order of 7654321 items", "ident: 12345-678"]
    docs += [f"ident: joe{i}@example.com" for i in range(12)]
    return docs


def test_confident_contexts_find_unseen_identifiers(spark):
    texts = planted()
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, list(enumerate(texts)))).collect()}
    found = {i: [s.value for s in r.id] for i, r in rows.items() if r.id}
    assert found == {30: ["AB1234567"], 32: ["12345-678"]}
    s = rows[30].id[0]
    assert texts[30][s.start:s.end] == "AB1234567"


def test_found_identifiers_lead_to_further_contexts(spark):
    shared, further = [f"AB{1000000 + i}" for i in range(60)], [f"QQ{2000000 + i}" for i in range(12)]
    texts = [f"his passport no +1 ({300 + i}) 555-{2000 + i} end" for i in range(300)]
    texts += [f"his passport no {v} here" for v in shared]
    # no base value stands in these contexts: the first has values found above, the second some of the first's
    texts += [f"Member ID: {v} ok" for v in [*shared, *further, "ZX7777777"]]
    texts += [f"clerk badge {v} ok" for v in [*further, "YY8888888"]]
    texts += [f"desk ticket {1234567 + i} ok" for i in range(20)]
    rows = pii.personal_data(frame(spark, list(enumerate(texts)))).collect()
    assert {s.value for r in rows for s in r.id} == {*shared, *further, "ZX7777777", "YY8888888"}


def test_contexts_are_whole_words(spark):
    """Long words that differ far to the left are different contexts; a line break before a value is white space."""
    long = "x" * 80
    texts = [f"a{long} b{long} +1 ({300 + i}) 555-{2000 + i}" for i in range(30)]
    texts += [f"c{long} b{long} AB1234567", f"a{long} d{long} AB2345678", f"word a{long}\nb{long}\n AB3456789"]
    rows = {r.doc_id: [s.value for s in r.id] for r in pii.personal_data(frame(spark, list(enumerate(texts)))).collect()}
    assert {i: v for i, v in rows.items() if v} == {32: ["AB3456789"]}


def test_few_seeds_find_nothing(spark):
    texts = ["my passport no +1 (684) 555-0954", "my passport no AB1234567"]
    assert all(not r.id for r in pii.personal_data(frame(spark, list(enumerate(texts)))).collect())


def test_redaction(spark):
    texts = planted() + [None, "", "plain", "é a@b.com,4111111111111111 +378282246310005 z", "10.0.0.1"]
    df = frame(spark, list(enumerate(texts)))
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[30] == "his passport no [id] here" and got[0].endswith("no [phone] end")
    assert got[45] is None and got[46] == "" and got[47] == "plain" and got[49] == "[ip]"
    assert got[48] == "é [email],[card] [phone] z"


def test_repeated_rows_null_ids_and_no_rows(spark, no_docs):
    rows = frame(spark, [(1, "a@b.com"), (1, "a@b.com"), (1, "c 10.0.0.1"), (None, "a@b.com")])
    assert sorted((r.doc_id or 0, len(r.email), len(r.ip)) for r in pii.personal_data(rows).collect()) == [
        (0, 1, 0), (1, 0, 1), (1, 1, 0), (1, 1, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in pii.redact(rows).collect()) == [
        (0, "[email]"), (1, "[email]"), (1, "[email]"), (1, "c [ip]")]
    assert pii.personal_data(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_identifiers_under_null_ids(spark):
    texts = planted()
    rows = frame(spark, [(None if i in (0, 30, 32) else i, t) for i, t in enumerate(texts)])
    found = sorted(s.value for r in pii.personal_data(rows).collect() for s in r.id if r.doc_id is None)
    assert found == ["12345-678", "AB1234567"]
    assert "his passport no [id] here" in {r.text for r in pii.redact(rows).collect() if r.doc_id is None}
