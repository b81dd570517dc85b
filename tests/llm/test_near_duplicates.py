"""The pipeline's near-duplicate stage against brute force at five words and 0.8."""

import random
from itertools import combinations

from test_jaccard import _rows, _shingles

import corpus_pipeline


def _left(rows):
    """The rows that stay: the first of each group of linked rows."""
    sets, root = [_shingles(r[1], 5) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0], k))
            root[y] = x
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    text, other = rng.sample(words, 240), rng.sample(words, 240)
    edited = ["new" if k in (40, 80, 120, 160, 200) else w for k, w in enumerate(other)]
    rows = [(2001, " ".join(text)), (2002, " ".join(text + rng.sample(words, 48))), (2003, " ".join(other)), (2004, " ".join(edited))]
    a, b, c, d = (_shingles(t, 4) for _, t in rows)
    assert all(100 * len(x & y) < 85 * len(x | y) for x, y in ((a, b), (c, d)))  # op9's rule would keep all four
    for seed in (1, 2):
        given = rows + _rows(seed)
        docs = spark.createDataFrame(given, "doc_id long, text string")
        got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
        assert got == sorted(_left(given))
        assert {r[0] for r in got if r[0] > 2000} == {2001, 2003}
