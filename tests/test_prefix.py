"""Running sums, ranks and Kendall's tau against plain versions; intervals and parts of texts against nested loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evaluation, intervals, prefix, retrieval


def test_running_sums_and_budgets(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), int(rng.integers(-5, 50))) for k in rng.permutation(5000)]
    rows = prefix.running_sum(spark.createDataFrame(data, "k long, v long").repartition(7), ["k"], "v", "before").collect()
    upto, want = 0, {}
    for k, v in sorted(data):
        want[k], upto = upto, upto + v
    assert {r["k"]: r["before"] for r in rows} == want
    kept = prefix.within_budget(spark.createDataFrame([(1, 5), (2, 6), (3, 0), (4, None)], "k int, v int"), ["k"], "v", F.lit(11)).collect()
    assert {r["k"]: r["kept"] for r in kept} == {1: True, 2: True, 3: True, 4: None}
    assert prefix.running_sum(spark.createDataFrame([], "k int, v int"), ["k"], "v", "b").count() == 0


def test_ranks_by_group(spark):
    data = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0), (None, 5.0), ("b", None)]
    got = sorted((str(r["g"]), str(r["v"]), r["rank"]) for r in evaluation.average_rank(spark.createDataFrame(data, "g string, v double"), "v", "rank", ["g"]).collect())
    assert got == [("None", "5.0", 1.5), ("None", "5.0", 1.5), ("a", "1.0", 1.5), ("a", "1.0", 1.5), ("a", "3.0", 3.0), ("b", "2.0", 2.0), ("b", "None", 1.0)]


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 64, 200):
        order, w = rng.permutation(n) * 3 - 5, rng.integers(1, 9, n)
        assert evaluation.inversions(order, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if order[i] > order[j])


@pytest.mark.parametrize(("values", "part"), [((9, 4), 1000), ((300, 300), 7), ((3, 1000), 20), ((1, 5), 2)])
def test_kendall_equals_all_pairs(spark, values, part):
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, v, 400) for v in values)
    y = np.where(rng.random(400) < 0.5, x, y)
    sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    upper = np.triu(np.ones((400, 400), dtype=bool), 1)
    c, d = int((sign[upper] > 0).sum()), int((sign[upper] < 0).sum())
    free = [(np.sign(v[:, None] - v)[upper] != 0).sum() for v in (x, y)]
    row = evaluation.kendall(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x int, y int"), "x", "y", part).first()
    assert (row["concordant"], row["discordant"]) == (c, d)
    assert row["tau"] == pytest.approx((c - d) / np.sqrt(float(free[0]) * free[1]) if free[0] and free[1] else 0.0)


def test_kendall_of_a_million_rows_and_of_none(spark):
    rows = spark.range(1_000_000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") - 3).cast("double").alias("y"))
    began = time.monotonic()
    row = evaluation.kendall(rows, "x", "y").first()
    # an odd row k has the value k - 3: less than the row before it, and as much as the even row k - 3, if there is one
    assert (row["discordant"], row["concordant"]) == (500_000, 1_000_000 * 999_999 // 2 - 499_999 - 500_000) and time.monotonic() - began < 120
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (1.0, None)], "x double, y double")
    assert tuple(evaluation.kendall(odd, "x", "y").first()) == (0, 0, 0.0)


@pytest.mark.parametrize("size", [1, 7, 128])
def test_overlaps_equal_a_nested_loop(spark, size):
    rng = np.random.default_rng(4)
    pick = lambda n: int(rng.integers(-5, n))
    windows = [(k, ["a", "b", None, "hot"][pick(4) % 4], None if pick(9) == 0 else (s := pick(60)), None if pick(9) == 0 else (s if s else 0) + pick(40)) for k in range(80)]
    spans = [("hot" if k % 3 else "ab"[k % 2], s := pick(70), s + pick(30), f"n{k}") for k in range(90)]
    got = intervals.overlaps(spark.createDataFrame(windows, "w int, key string, start int, end int"), spark.createDataFrame(spans, "key string, start_line int, end_line int, name string"), "key", bin_lines=size).collect()
    low, high = -(10**9), 10**9
    want = [
        (w, name) for w, key, s, e in windows for k, a, b, name in spans
        if key == k and a <= b and (low if s is None else s) <= (high if e is None else e) and a <= (high if e is None else e) and b >= (low if s is None else s)
    ]
    assert sorted((r["w"], r["name"]) for r in got) == sorted(want) and len(want) > 100


def test_parts_of_texts(spark):
    texts = ["the quick brown fox", "quick  brown", " a b ", "quick brownie fox", None, "", "a b c quick brown fox jumps"]
    parts = ["quick brown fox", "uick brown f", "quick", " b ", "  ", "", None, "a b c", "brown", "k brownie f", " a b "]
    rows = retrieval.containing(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "t int, text string"), spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "p int, part string")).collect()
    assert sorted((r["t"], r["p"]) for r in rows) == [(t, p) for t, text in enumerate(texts) for p, part in enumerate(parts) if text is not None and part is not None and part in text]
