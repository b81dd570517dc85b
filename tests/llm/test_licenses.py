"""Licence scans against a plain version that looks for every string of words in every template."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import licenses, queries
from lodestrata.llm.licenses import COVERED, GAP, LONG, PHRASES, TEMPLATES, Scanner

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def occurrences(part, whole):
    return [i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part]


def plain_scan(text, templates, phrases):
    ws = split(text)
    base = sorted((at, label) for phrase, label in phrases.items() for at in occurrences(split(phrase), ws))
    every = [split(t) for _, t in templates]
    known = {tuple(t[i:j]) for t in [*every, *map(split, phrases)] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stat = [max((k for k in range(1, at + 2) if tuple(ws[at + 1 - k : at + 1]) in known), default=0) for at in range(len(ws))]
    matches = []
    for at, k in enumerate(stat):
        if k and (at + 1 == len(ws) or stat[at + 1] != k + 1):
            part = ws[at + 1 - k : at + 1]
            matches += [(t, at + 1 - k, at + 1, i) for t, own in enumerate(every) if k >= min(LONG, len(own)) for i in occurrences(part, own)]
    return ws, base, matches


def plain(text, templates=TEMPLATES, phrases=PHRASES):
    ws, base, matches = plain_scan(text, templates, phrases)
    best = {}

    def chain(last, covered):
        t, start, end, at = last
        best[t] = max(best.get(t, 0), covered)
        for m in matches:
            if m[0] == t and 0 <= m[1] - end <= GAP and m[3] >= at + end - start:
                chain(m, covered + m[2] - m[1])

    for m in matches:
        chain(m, m[2] - m[1])
    shares = {t: covered / len(split(templates[t][1])) for t, covered in best.items()}
    found = {label for _, label in base}
    labels = found | {templates[t][0] for t, share in shares.items() if share >= COVERED}
    starts = [at for at, _ in base]
    return (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), max(shares.values(), default=0.0))


def run(spark, rows, schema="doc_id long, text string"):
    return [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, schema)).drop("spans").collect()]


def damaged(rng, text, share):
    ws = text.split()
    return " ".join("foreign" if rng.random() < share else w for w in ws)


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    short = {t: s for t, s in texts.items() if len(s or "") < 3000}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] in short} == {t: plain(s) for t, s in short.items()}
    for r in rows:  # base phrases in texts of any length
        at = [i for p in PHRASES for i in occurrences(split(p), split(texts[r["doc_id"]]))]
        assert (r["n_words"], r["n_base"], r["first_word"]) == (len(split(texts[r["doc_id"]])), len(at), min(at, default=None))
    assert {"mit", "apache", "gpl"} <= {x for r in rows for x in r["base_labels"].split(",")}


def test_licence_texts_among_others(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (_, text) in enumerate(TEMPLATES):
        rows += [(10 * k + j, f"intro words {damaged(rng, text, share)} and then MIT License.\n\nApache-License") for j, share in enumerate((0, 0.03, 0.1, 0.3))]
    rows.append((900, " ".join(t for _, t in TEMPLATES)))
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == {k: plain(t) for k, t in rows}
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in got[10 * k][5].split(",") and got[10 * k][6] == 1.0


def test_odd_rows(spark):
    very_long = "x" * 3_000_000 + " general PUBLIC license " + "word " * 300_000 + "mit-license"
    rows = [(1, None), (1, ""), (None, "MIT\tLicense"), (2, "mit license mit license"), (2, "mit license mit license"), (3, "mit license"), (4, "the MIT LİCENSE Apache, license"), (5, very_long)]
    got = run(spark, rows)
    assert got[:7] == [(k, *plain(t)) for k, t in rows[:7]]
    assert got[7] == (5, 300_006, 2, 1, 300_004, "gpl,mit", "gpl,mit", 0.0)
    assert got[2][0] is None and got[5][2] == 0  # a no-break space is part of a word
    assert run(spark, []) == []
    assert run(spark, [(1, "x", "mit license", 2.0)], "doc_id long, labels string, text string, score double") == [(1, *plain("mit license"))]


def test_spans_name_the_words(spark):
    text = "some words before " + TEMPLATES[3][1] + " and behind"
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert ("apache-2.0", 3, 11, 1.0) in [tuple(s) for s in row["spans"]]


word = st.sampled_from(["a", "b", "c", "zz"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(word, min_size=1, max_size=14), min_size=1, max_size=4), st.lists(word, max_size=30))
def test_statistics_of_random_sequences(sequences, text):
    templates = [(f"t{k}", " ".join(s)) for k, s in enumerate(sequences)]
    phrases = {"a b": "x", "b a b": "y", "c": "z"}
    scanner = Scanner(templates, phrases)
    ws, base, matches = plain_scan(" ".join(text), templates, phrases)
    n, got_base, got = scanner.scan(" ".join(text).encode())
    assert n == len(ws) and sorted(got_base) == base
    told = sorted((t, m.start, m.end, place - (m.end - m.start)) for m in got for t, place in m.places if m.end - m.start >= min(LONG, scanner.lengths[t]))
    assert told == sorted(matches)
    assert len(scanner.automaton.link) <= 2 * (sum(map(len, sequences)) + 6) + 1
    assert scanner.judge(" ".join(text).encode())[:7] == pytest.approx(plain(" ".join(text), templates, phrases))
