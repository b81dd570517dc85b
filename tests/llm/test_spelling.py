"""Spelling variants against a plain version that compares all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm import spelling
from lodestrata.llm.common import pieces


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(rows, schema)).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equals_the_comparison_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    letters = list("abéÿz")
    stems = ["".join(rng.choice(letters, size=rng.integers(4, 8))) for _ in range(40)]
    rows = []
    for doc_id in range(400):
        words = []
        for _ in range(60):
            w = list(stems[int(rng.zipf(1.4)) % 40])
            if rng.random() < 0.4:
                at = int(rng.integers(len(w)))
                w = [w[:at] + w[at + 1 :], w[:at] + ["b"] + w[at:], w[:at] + ["z"] + w[at + 1 :]][int(rng.integers(3))]
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((doc_id, "1 ".join(words)))
    want = plain(rows)
    assert any(r[4] > 3 for r in want) and any(r[1] != r[2] and r[1] for r in want)  # crowds, and chains of forms
    assert run(spark, rows) == want


def test_odd_rows(spark):
    long_word = "ab" * 3000
    rows = [(1, None), (1, ""), (None, "Colour colour ÉTUDE étude"), (2, "colour color, COLOR;color-color 12color34"), (2, "colour color, COLOR;color-color 12color34")]
    rows += [(k, f"{long_word} {long_word}x aaaaa aaaaaa {'word ' * 5000}") for k in (3, 4, 5)] + [(7, "étude ÉTUDE étude Étude étude")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, "one two"), (None, None)]) == []
    clashing = [(k, "w", 1, "letter letters", "x") for k in range(4)]
    got = run(spark, clashing, "doc_id long, word string, n int, text string, id string")
    assert got == plain([(k, t) for k, _, _, t, _ in clashing])


def test_ties_go_to_the_smallest_word(spark):
    rows = [(k, "stane stone store stare " + "stone stane " * 3) for k in range(4)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got["stare"][1] == "stane" and got["store"][1] == "stone" and got["stone"][1] is None


@given(st.lists(st.text(alphabet="abé", min_size=5, max_size=5), min_size=1, max_size=20, unique=True))
def test_keys_meet_exactly_where_words_are_near(words):
    points = np.array([[ord(c) for c in w] for w in words], dtype=np.uint32)
    row, place, key = spelling.deletion_keys(points, least=4)
    groups = {}
    for r, p, k in zip(row.tolist(), place.tolist(), key.tolist(), strict=True):
        groups.setdefault(k, []).append((r, p))
    met = {tuple(sorted((a, b))) for k, g in groups.items() if k & 1 for a, _ in g for b, _ in g if a != b}
    assert met == {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if one_edit(words[a], words[b])}


def test_a_collision_joins_nothing():
    members = [(2, "stone", 9), (2, "stane", 5), (2, "plane", 7), (-1, "house", 4)]
    assert sorted(spelling.near_in_run(members[:3], True)) == [(0, 1, 5, "stane"), (1, 1, 9, "stone")]
    assert list(spelling.near_in_run([members[3], (0, "stone", 2)], False)) == []


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_pieces_keep_words_whole(most):
    text = "Zwei wörter, une étude;und-noch 1 eins".encode()
    assert b"".join(pieces(text, most)) == text
    assert [w for p in pieces(text, most) for w in spelling.RUN.findall(p.lower())] == spelling.RUN.findall(text.lower())
