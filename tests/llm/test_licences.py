"""Licence scans against brute force over words."""

from __future__ import annotations

import random
import re

from retentio.llm import licences

from .conftest import TEXTS, frame

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))


def places(t):
    w, out = words(t), []
    for phrase in licences.PHRASES:
        p = phrase.split()
        out += [(i, phrase) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return sorted(out)


def texts():
    rng = random.Random(7)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "nc", "4", "0", "gnu", "x",
             "All Rights Reserved", "licensed under", "General Public License", "die Größe", "version 3"]
    return [*TEXTS, *(" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300))]


def test_places_of_phrases(spark):
    all_texts = texts()
    out = {r.doc_id: r for r in licences.licence_scan(frame(spark, list(enumerate(all_texts)))).collect()}
    for i, t in enumerate(all_texts):
        assert out[i].n_words == len(words(t))
        assert sorted((p.first_word, p.phrase) for p in out[i].places) == places(t)
        assert 0 <= out[i].score <= 1


def test_matching_statistics_are_longest_matches():
    rng = random.Random(3)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = licences.SuffixAutomaton(sequences)
    for _ in range(100):
        file = [rng.randint(0, 4) for _ in range(30)]
        for k, (state, length) in enumerate(automaton.statistics(file)):
            def occurs(n):
                return n == 0 or any(s[i:i + n] == file[k + 1 - n:k + 1] for s in sequences for i in range(len(s) - n + 1))
            longest = max(n for n in range(k + 2) if occurs(n))
            assert length == longest
            for s, end in automaton.ends[state] if length else []:
                assert sequences[s][end + 1 - length:end + 1] == file[k + 1 - length:k + 1]


def test_template_spans():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES, licences.MIN_MATCH, licences.MAX_GAP, licences.COVERED)
    mit = dict(reversed(licences.TEMPLATES))["mit"]
    for label, template in licences.TEMPLATES:
        n, _, spans, score = scanner.scan(f"some words before {template} and after")
        assert label in {s[0] for s in spans} and score == 1.0 and n == len(words(template)) + 5
    long = licences.TEMPLATES[2][1].split()
    edited = " ".join([*long[:10], "some", "other", *long[11:]])
    spans = scanner.scan(f"a b c {edited} d e")[2]
    assert [s[0] for s in spans] == ["mit"] and spans[0][1] == 3 and spans[0][3] < 1
    assert scanner.scan("the rights to use the software")[2] == [] and mit
    assert {s[0] for s in scanner.scan("Licensed under CC BY-NC 4.0.")[2]} == {"cc-by-nc-4.0"}


def test_templates_whole_inside_longer_ones():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES, licences.MIN_MATCH, licences.MAX_GAP, licences.COVERED)
    coded = [(label, words(t)) for label, t in licences.TEMPLATES]
    tails = 0
    for label, t in coded:
        for _, longer in coded:
            for at in range(len(longer) - len(t) + 1):
                if longer[at:at + len(t)] == t and len(longer) > len(t):
                    for more in range(len(longer) - at - len(t) + 1):
                        for start in (0, at):
                            text = ["x", "y", *longer[start:at + len(t) + more], "z"]
                            _, _, spans, score = scanner.scan(" ".join(text))
                            first = 2 + at - start
                            assert any(s[0] == label and s[1] <= first and first + len(t) - 1 <= s[2] for s in spans), text
                            assert score == 1.0
                            tails += 1
    assert tails > 20
    for text in ("Licensed under the Apache License, Version 2.0. The code is fast",
                 'x licensed under the Apache License, Version 2.0 (the "License"). See LICENSE'):
        spans, score = scanner.scan(text)[2:]
        assert [(s[0], s[2] - s[1]) for s in spans] == [("apache-2.0", 7)] and score == 1.0
    a, b = ("a", "p q r s t u"), ("b", "n p q r s t u v w")  # inside, not at the start
    scanner = licences.Scanner({"q": "q"}, [a, b], 4, 12, 0.75)
    assert {s[:3] for s in scanner.scan("n p q r s t u v w")[2]} == {("a", 1, 6), ("b", 0, 8)}


def test_spans_of_a_label_do_not_overlap():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES, licences.MIN_MATCH, licences.MAX_GAP, licences.COVERED)
    notice = "licensed under the Apache License, Version 2.0. The code. "
    for text in (notice * 200, notice * 100 + licences.TEMPLATES[4][1] + " " + notice * 100):
        spans = sorted(s[1:3] for s in scanner.scan(text)[2])
        assert len(spans) >= 200 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_chains_reach_back_over_any_number_of_matches():
    """The best coverage is that of a search over all earlier matches."""
    rng = random.Random(5)
    total, gap = 60, 12
    template = [f"t{i % 7}" for i in range(total)]  # words that recur: each place has many matches
    scanner = licences.Scanner({"q": "q"}, [("t", " ".join(template))], 2, gap, 0.2)
    longest = 0
    for _ in range(30):
        found = sorted({(d := rng.randint(0, 120), u := rng.randint(0, total - 2), rng.randint(2, min(12, total - u)))
                        for _ in range(300)})
        best = []
        for d, u, n in found:
            options = [n]
            for k, (d2, u2, n2) in enumerate(found[:len(best)]):
                over = max(0, d2 + n2 - d, u2 + n2 - u)
                if d2 < d and u2 < u and over < n and d - d2 - n2 <= gap:
                    options.append(best[k] + n - over)
                    longest = max(longest, len(best) - k)
            best.append(max(options))
        spans, score = scanner._chains({0: list(found)})
        assert score == min(max(best) / total, 1.0) and spans
    assert longest > 64


def test_whole_texts_of_licences():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES, licences.MIN_MATCH, licences.MAX_GAP, licences.COVERED)
    for label, whole in licences.TEMPLATES:
        w = words(whole)
        if len(w) < 90:
            continue
        text = "see below x y z. " + " ".join(w).upper() + " end of file"
        spans = scanner.scan(text)[2]
        assert (label, 5, 4 + len(w)) in {s[:3] for s in spans}, label
        # an eighth of its words changed here and there: one span still, by chained matches
        edited = [f"other{i}" if i % 16 in (7, 8) else x for i, x in enumerate(w)]
        spans = [s for s in scanner.scan(" ".join(edited))[2] if s[0] == label]
        assert any(s[2] - s[1] > 0.9 * len(w) and s[3] < 1 for s in spans), label


def test_no_rows(no_docs):
    assert licences.licence_scan(no_docs).count() == 0
