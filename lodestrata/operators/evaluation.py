"""Statistics of evaluations: intervals, agreement, ranks, correlation, retrieval metrics."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.prefix import running_sum

Z = 1.95996  # fixed value: of the 95 % interval
KENDALL_PART = 1 << 18
DIFFICULTIES = ("lookup", "explanation", "cross-file")  # fixed values
LEAST_PAIRS, LEAST_RHO, LEAST_TAU = 15, 0.60, 0.80  # fixed values: of the protocol for ratings


def wilson(good: Column, total: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share; (0, 0) for an empty total."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = good / n
    middle, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    bound = lambda v: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / (1 + Z * Z / n)))).otherwise(F.lit(0.0))
    return bound(middle - half), bound(middle + half)


def confusion(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(group, label) -> counts, precision with its interval, recall and F1 (null without false negatives), by group and overall.

    Labels are TP, FP, AMBIGUOUS or FN in any case and with any blanks; others aren't counted.
    """
    rows = rows.withColumn("_l", F.upper(F.trim(label))).filter(F.col("_l").isin("TP", "FP", "AMBIGUOUS", "FN"))
    counted = rows.rollup(group).agg(*[F.count_if(F.col("_l") == x).alias(x.lower()) for x in ("TP", "FP", "AMBIGUOUS", "FN")], F.grouping(group).cast("int").alias("overall"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = tp / F.nullif(tp + fp, F.lit(0))
    recall = F.when(fn > 0, tp / (tp + fn))
    low, high = wilson(tp, tp + fp)
    f1 = F.when(fn > 0, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))
    return counted.withColumns({"precision": precision, "low": low, "high": high, "recall": recall, "f1": f1})


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two sets' intersection and differences, Jaccard and Dice; 1 for two empty sets. One shuffle of both sides."""
    tagged = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    each = tagged.groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    both, only_a, only_b = (F.count_if(F.col("_s") == k) for k in (3, 1, 2))
    share = lambda x, n: F.round(F.coalesce(x / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(1.0)), 9)
    return each.agg(both.alias("both_"), only_a.alias("only_a"), only_b.alias("only_b"), share(both, both + only_a + only_b).alias("jaccard"), share(2 * both, 2 * both + only_a + only_b).alias("dice"))


def average_rank(rows: DataFrame, value: str, name: str, group: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged. Ranks come from running sums of counts of distinct values, so equal values don't meet in one
    task, and neither do all distinct ones or those of one group."""
    group = group or []
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_n"))
    summed = running_sum(counts, [*group, value], "_n", "_upto")
    if group:
        start = summed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min("_upto").alias("_first"))
        summed = summed.join(start, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]).withColumn("_upto", F.col("_upto") - F.col("_first"))
    ranks = summed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, value])], (F.col("_upto") + (F.col("_n") + 1) / 2.0).alias(name))
    return rows.join(ranks, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*group, value])]).select(*rows.columns, name)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of average ranks; 0 for fewer than two rows or no variance."""
    ranked = average_rank(average_rank(rows.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.coalesce(F.nanvl(F.corr("_rx", "_ry"), F.lit(0.0)), F.lit(0.0)).alias("rho"), F.count("*").alias("n"))


def inversions(order: np.ndarray, weight: np.ndarray) -> int:
    """The weight of pairs i < j with order[i] > order[j], of distinct whole numbers: digit by digit of their binary places."""
    place = np.empty(len(order), dtype=np.int64)
    place[np.argsort(order, kind="stable")] = np.arange(len(order))
    total = 0
    for bit in range(max(0, len(order) - 1).bit_length()):
        # among numbers that agree in their higher digits, in order of i: a 1 before a 0 is an inversion
        turn = np.argsort(place >> (bit + 1), kind="stable")
        group, high, w = place[turn] >> (bit + 1), (place[turn] >> bit) & 1, weight[turn]
        ones = np.cumsum(w * high) - w * high
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, dtype=bool)
        base = np.maximum.accumulate(np.where(first, ones, 0))
        total += int(((ones - base) * w * (1 - high)).sum())
    return total


def kendall(rows: DataFrame, x: str, y: str, part: int = KENDALL_PART) -> DataFrame:
    """Kendall's tau-b of raw values, without pairs.

    Distinct (x, y) are numbered in the order of (x, y) and in that of (y, x), by distributed running sums; a discordant pair is an
    inversion of the two numbers. Numbers are cut into parts of ``part``: inversions inside a part of the first order are counted in one
    task, those between parts inside a part of the second order in another, and those that differ in both parts follow from the counts of the
    grid of parts. Null and NaN values take no part. Weights must sum up to less than 3 x 10^9 in a part.
    """
    number = lambda c: F.col(c).cast("double") if dict(rows.dtypes)[c] in ("float", "double") else F.col(c)
    cells = rows.groupBy(number(x).alias("x"), number(y).alias("y")).agg(F.count("*").alias("n")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    one = running_sum(running_sum(cells.withColumn("_1", F.lit(1)), ["x", "y"], "_1", "a"), ["y", "x"], "_1", "b").select("x", "y", "n", "a", "b", F.floor(F.col("a") / part).alias("p"), F.floor(F.col("b") / part).alias("q"))
    one = one.checkpoint()

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        return pd.DataFrame({"d": [inversions(pdf["b"].to_numpy(), pdf["n"].to_numpy())]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        own = sum(inversions(g["b"].to_numpy(), g["n"].to_numpy()) for _, g in pdf.groupby("p"))
        return pd.DataFrame({"d": [inversions(pdf["b"].to_numpy(), pdf["n"].to_numpy()) - own]})

    narrow = one.select("a", "b", "n", "p", "q")
    counted = narrow.groupBy("p").applyInPandas(inside, "d long").unionByName(narrow.groupBy("q").applyInPandas(between, "d long"))
    grid = narrow.groupBy("p", "q").agg(F.sum("n").alias("n"))
    # of a grid's cell: the weight in earlier parts of the first order and later ones of the second
    after = grid.groupBy("p").agg(F.collect_list(F.struct("q", "n")).alias("row"))

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        total, seen = 0, Counter()
        for row in pdf.sort_values("p")["row"]:
            keys = sorted(seen)
            tail = np.cumsum([seen[k] for k in keys][::-1])[::-1] if keys else np.zeros(0, dtype=np.int64)
            total += sum(int(tail[k]) * int(c["n"]) for c in row if (k := bisect_right(keys, c["q"])) < len(keys))
            for c in row:
                seen[c["q"]] += c["n"]
        return pd.DataFrame({"d": [total]})

    counted = counted.unionByName(after.groupBy().applyInPandas(cross, "d long"))  # parts squared, not rows
    big = lambda c: c.cast("decimal(38,0)")
    pairs = lambda n: F.sum(big(n) * (n - 1) / 2)
    d = counted.agg(F.coalesce(F.sum(big(F.col("d"))), F.lit(0)).alias("d"))
    ties = lambda c: one.groupBy(c).agg(F.sum("n").alias("m")).agg(F.coalesce(pairs(F.col("m")), F.lit(0)).alias(f"t{c}"))
    both = one.agg(F.coalesce(pairs(F.col("n")), F.lit(0)).alias("txy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    row = d.join(F.broadcast(ties("x"))).join(F.broadcast(ties("y"))).join(F.broadcast(both))  # one row each
    whole = big(F.col("n")) * (F.col("n") - 1) / 2
    row = row.withColumn("all_", whole).withColumn("c", F.col("all_") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d"))
    scale = F.sqrt((F.col("all_") - F.col("tx")).cast("double")) * F.sqrt((F.col("all_") - F.col("ty")).cast("double"))
    tau = (F.col("c") - F.col("d")).cast("double") / F.nullif(scale, F.lit(0.0))
    return row.select(F.col("c").cast("long").alias("concordant"), F.col("d").cast("long").alias("discordant"), F.coalesce(tau, F.lit(0.0)).alias("tau"))


def exclusive_quantile(values: Column, q: float) -> Column:
    """The quantile at q (n + 1) by interpolation, of an array; its largest value below 20."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = F.lit(q) * (F.size(s) + 1)
    k = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), F.size(s) - 1))
    low, high = F.get(s, k - 1), F.get(s, k)
    return F.when(F.size(s) >= 20, low + (at - k) * (high - low)).otherwise(F.array_max(s))


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, item, rank) against (query, item): hit, recall and reciprocal rank at k of each query that has a truth."""
    wanted = truth.select(query, item).distinct()
    sizes = wanted.groupBy(query).agg(F.count("*").alias("wanted"))
    found = ranked.filter(F.col("rank") <= k).join(wanted, [query, item]).groupBy(query).agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    rows = sizes.join(found, query, "left")
    n = F.coalesce("found", F.lit(0))
    return rows.select(query, (n > 0).cast("int").alias("hit"), (n / F.col("wanted")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_report(results: DataFrame, ks: tuple[int, ...], group: list[str]) -> DataFrame:
    """(group, difficulty, paraphrase, unanswerable, top1_score, reciprocal_rank, hit_k and recall_k of each k; null: nothing found) -> a row for each
    group and one over all (``overall`` has a bit for each column of ``group`` that is summed up).

    Metrics are means over the answerable questions, by difficulty and by paraphrase as well; a breakdown without questions is null. The best scores
    are told apart by whether the first answer was a hit; unanswerable questions have their number and best scores only.
    """
    un = F.coalesce("unanswerable", F.lit(False))
    zero = lambda c: F.when(~un, F.coalesce(F.col(c), F.lit(0.0)))
    top, hit = F.col("top1_score"), F.coalesce(F.col("hit_1"), F.lit(0)) == 1
    mean = lambda c, where, name: F.avg(F.when(where, c)).alias(name)
    cut = [f(F.when(where, top)).alias(f"{name}_{x}") for where, name in ((~un, "top1"), (un, "unanswerable_top1")) for f, x in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))]
    sets = [group, *([group[:1]] if len(group) > 1 else []), []]
    return results.groupingSets(sets, *group).agg(
        F.grouping_id(*group).cast("int").alias("overall"), F.count_if(~un).alias("answerable"), F.count_if(un).alias("unanswerable"),
        *[F.avg(zero(f"{m}_{k}")).alias(f"{m}_{k}") for k in ks for m in ("hit", "recall")], F.avg(zero("reciprocal_rank")).alias("mrr"),
        *[mean(zero("reciprocal_rank"), F.col("difficulty") == d, f"mrr_{d.replace('-', '_')}") for d in DIFFICULTIES],
        *[mean(zero("reciprocal_rank"), F.col("paraphrase") == p, name) for p, name in ((True, "mrr_paraphrase"), (False, "mrr_plain"))],
        mean(top, ~un & hit, "top1_hit_mean"), mean(top, ~un & ~hit, "top1_miss_mean"), *cut,
    )


def review_state(reviewed: Column, total: Column) -> Column:
    """Validated once every row is reviewed, not validated while none is."""
    return F.when(reviewed == 0, "NOT VALIDATED").when((reviewed == total) & (total > 0), "VALIDATED").otherwise("INCOMPLETE")


def quorum(pairs: Column, rho: Column, tau: Column, total: Column, excluded: Column) -> list[Column]:
    """What a correlation of ratings shows: state, validated, and whether rho and tau reach their bars; below 15 pairs nothing is shown."""
    enough = pairs >= LEAST_PAIRS
    state = F.when(~enough | (pairs < total), "INCOMPLETE").otherwise("VALIDATED")
    meets = lambda v, bar: F.coalesce(enough & (v >= bar), F.lit(False))
    return [state.alias("state"), (enough & (pairs == total) & (excluded == 0)).alias("validated"), meets(rho, LEAST_RHO).alias("meets_rho"), meets(tau, LEAST_TAU).alias("meets_tau")]


def answer_report(answers: DataFrame, group: str) -> DataFrame:
    """(group, state, answerable, unanswerable, cited, expected, refused) -> a row for each group and one over all.

    ``state`` is success, failed or skipped; ``cited`` is the file of each citation, ``expected`` the files that hold the answer.
    Precision counts citations, recall distinct files; an answer without citations has 0 for both. A question is answerable if it
    says so or doesn't say that it is unanswerable.
    """
    ok = F.col("state") == "success"
    answerable = F.coalesce("answerable", F.lit(False)) | ~F.coalesce("unanswerable", F.lit(False))
    cited, wanted = F.coalesce("cited", F.array().cast("array<string>")), F.array_distinct(F.coalesce("expected", F.array().cast("array<string>")))
    good = F.size(F.filter(cited, lambda c: F.array_contains(wanted, c)))
    both = F.size(F.array_intersect(cited, wanted))
    none = F.size(cited) == 0
    precision = F.when(none, 0.0).otherwise(good / F.nullif(F.size(cited), F.lit(0)))
    recall = F.when(none, 0.0).when(F.size(wanted) == 0, 1.0).otherwise(both / F.nullif(F.size(wanted), F.lit(0)))
    rows = answers.select(group, "state", answerable.alias("_a"), "refused", F.when(ok & answerable, precision).alias("_p"), F.when(ok & answerable, recall).alias("_r"))
    asked = ok & ~F.col("_a")
    counted = rows.rollup(group).agg(
        F.grouping(group).cast("int").alias("overall"), F.count("*").alias("total"), F.count_if(ok).alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.round(F.avg("_p"), 4).alias("precision"), F.round(F.avg("_r"), 4).alias("recall"),
        F.count_if(asked).alias("_u"), F.count_if(asked & F.col("refused")).alias("_ur"),
    )
    tried, n, failed, skipped = F.col("succeeded") + F.col("failed"), F.col("succeeded"), F.col("failed"), F.col("skipped")
    state = F.when(tried == 0, "BLOCKED").when(n == F.col("total"), "COMPLETED").when((n > 0) & (failed + skipped > 0), "PARTIAL").when(n == 0, "FAILED").otherwise("BLOCKED")
    return counted.select(
        "*", F.round(100.0 * n / F.nullif(F.col("total"), F.lit(0)), 1).alias("coverage"),
        F.round(1 - F.col("_ur") / F.nullif(F.col("_u"), F.lit(0)), 4).alias("hallucination"), state.alias("state"),
    ).drop("_u", "_ur")
