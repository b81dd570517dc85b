import random
from itertools import combinations

import numpy as np
import pytest

from lodestrata.llm import jaccard
from lodestrata.llm.graph import components

RULE = jaccard.Rule()


def _shingles(text, n=4):
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def _brute(rows):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def _rows(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 6, 9, 15, 30, 80, 200, 500]))
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            rows.append((len(rows) * 7 % 1009, " ".join(base)))
            base = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25 + 1)):  # a chain: each copy is an edit of the one before
                k = rng.randrange(len(base) + 1)
                rng.choice([lambda k=k: base.insert(k, rng.choice(vocabulary)), lambda k=k: base.__delitem__(slice(k, k + 1)), lambda k=k: base.__setitem__(slice(k, k + 1), ["NEW"])])()
                base = base or ["x"]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = _rows(seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    want = _brute(rows)
    assert sorted(map(tuple, got)) == want
    assert len({c for _, _, c in want}) < len(want) * 0.8


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É a b c d"), (7, "é a b c d"), (None, "one two"), (8, "a " * 9000), (9, "a a a a a"), (9, "a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as n_shingles")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()]
    assert [x for x in got if x[0] is None] == [(None, 1, 4)]
    got = sorted(x for x in got if x[0] is not None)
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(None, text), (None, text + " x"), (None, "other words"), (None, None), (3, "other words"), (3, text[:80])]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(None, 197, None), (None, 198, None), (None, 1, 3), (None, 0, None), (3, 1, 3), (3, len(_shingles(text[:80])), 3)], key=str)
    linked = [r["component"] for r in got if r["n_shingles"] > 190]
    assert linked[0] == linked[1]


def test_families_below_the_threshold(spark, monkeypatch):
    """Near copies of one text of which few pairs link, in one block and in many."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3])):
            words[k] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    want = _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 5 < len({c for *_, c in want}) < 85
    for block, together in ((jaccard.BLOCK, 8), (7 * jaccard.LEAST_COST, 8), (7 * jaccard.LEAST_COST, 2)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        monkeypatch.setattr(jaccard, "TURN", 4)
        assert sorted(map(tuple, jaccard.join(docs).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_signatures_meet_whenever_sets_link():
    rng, schemes, rest = np.random.default_rng(3), jaccard.Schemes(RULE), 0
    for _ in range(4000):
        n = int(rng.choice([1, 2, 5, 6, 7, 8, 12, 13, 20, 40, 90, 300]))
        pool = rng.integers(0, 2**64, 3 * n + 8, dtype=np.uint64)
        a = np.unique(pool[:n])
        drop = int(rng.integers(0, max(1, int(0.16 * n)) + 1))
        add = int(rng.integers(0, max(1, int(0.16 * n) - drop + 1) + 1))
        b = np.unique(np.concatenate([a[drop:], pool[n : n + add]]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 85 * (len(a) + len(b) - common):
            continue
        (sa, da), (sb, db) = (jaccard.signatures(x, schemes) for x in (a, b))
        rest += len(sa) > 2 * sum(schemes.segments[k] for k in schemes.of(len(a)))
        met = np.intersect1d(sa, sb)
        assert len(met), (len(a), len(b), common)
        # whatever plain segments each of them gives up, one is left
        assert any((met & np.uint64(2)).tolist()) or any((met & np.uint64(1) == k).sum() > da[k] + db[k] for k in (0, 1))
        assert np.bitwise_count(jaccard._sketch(a) ^ jaccard._sketch(b)).sum() <= len(a) + len(b) - 2 * common


def test_deletion_neighbourhoods_find_what_exact_segments_miss():
    """Sets crowded into few segments have too many empty ones; they meet through deletions only."""
    schemes, rng, met = jaccard.Schemes(RULE), np.random.default_rng(4), 0
    for _ in range(600):
        a = np.unique(rng.integers(0, 2**61, 40, dtype=np.uint64))  # the lowest eighth of the universe
        b = np.unique(np.concatenate([a[2:], rng.integers(0, 2**61, 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            met += 1
            assert len(np.intersect1d(jaccard.signatures(a, schemes)[0], jaccard.signatures(b, schemes)[0]))
    assert met > 500


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5 * jaccard.LEAST_COST)
    rows = _rows(5, 120)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == _brute(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
