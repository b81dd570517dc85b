"""The weighted health score: sub-scores from analyzer rows, combined over what is available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of complexity ranks, penalties of severities, component weights.
RANK_POINTS = {"A": 100, "B": 85, "C": 70, "D": 50, "E": 30, "F": 10}
SECURITY_PENALTY = {"HIGH": 15, "MEDIUM": 7, "LOW": 2}
SAST_PENALTY = {"HIGH": 15, "ERROR": 15, "WARNING": 7, "MEDIUM": 7, "INFO": 2, "LOW": 2}
WEIGHTS = {"complexity": 0.25, "maintainability": 0.25, "security": 0.20, "sast": 0.15, "secrets": 0.10, "vulnerabilities": 0.05}
LEGACY_WEIGHTS = {"complexity": 0.35, "maintainability": 0.35, "security": 0.30}
STATUSES = ("success", "partial", "failed", "unsupported", "unavailable")  # fixed values: of a component's analysis


def _mapped(value: Column, values: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, n in values.items():
        out = F.when(value == name, F.lit(n)).otherwise(out)
    return out


def rank_points(rank: Column) -> Column:
    """A missing rank counts as C, an unknown one as 50."""
    return _mapped(F.coalesce(rank, F.lit("C")), RANK_POINTS, 50)


def complexity_points(cc: Column) -> Column:
    """Points of a cyclomatic complexity where no rank is given."""
    return F.when(cc <= 5, 100).when(cc <= 10, 85).when(cc <= 20, 70).when(cc <= 30, 50).when(cc <= 40, 30).otherwise(10)


def security_penalty(severity: Column) -> Column:
    """Severities count in any case; others, and a missing one, cost 2."""
    return _mapped(F.upper(severity), SECURITY_PENALTY, 2)


def sast_penalty(severity: Column) -> Column:
    """Severities count in any case, a missing one as INFO; others cost 5."""
    return _mapped(F.upper(F.coalesce(severity, F.lit("INFO"))), SAST_PENALTY, 5)


def half_even(value: Column, digits: int) -> Column:
    """Rounded to so many digits, halves to the even side."""
    return F.rint(value * 10**digits) / 10**digits


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sub_scores(results: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, cc, mi, severity, level, secret, vulnerable) -> a row of sub-scores for each run; one aggregation, combined on the map side."""
    left = lambda penalty: F.greatest(F.lit(0.0), 100.0 - F.sum(penalty).cast("double"))
    return results.groupBy(key).agg(
        F.avg(complexity_points(F.col("cc"))).alias("complexity"),
        F.avg(clamp(F.col("mi"))).alias("maintainability"),
        left(security_penalty(F.col("severity"))).alias("security"),
        left(sast_penalty(F.col("level"))).alias("sast"),
        left(F.when(F.col("secret"), 25).otherwise(0)).alias("secrets"),
        left(F.when(F.col("vulnerable"), 20).otherwise(0)).alias("vulnerabilities"),
    )


def composite(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``composite`` (null without any component), ``components`` and ``weight_total`` over the components that aren't null."""
    weights = weights or WEIGHTS
    has = {c: F.col(c).isNotNull() for c in weights}
    total = sum((F.when(has[c], F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    summed = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    out = scores.withColumn("components", sum((has[c].cast("int") for c in weights), F.lit(0))).withColumn("weight_total", total)
    return out.withColumn("composite", F.when(F.col("components") > 0, summed / F.nullif(total, F.lit(0.0))))


def explain(scores: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """A row for each available component: its renormalised weight and contribution."""
    weights = weights or WEIGHTS
    rows = scores.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("score"), F.lit(w).alias("weight")) for c, w in weights.items()])).alias("x"))
    rows = rows.select(key, "x.*").filter("score is not null")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(key))
    return rows.withColumn("effective_weight", share).withColumn("contribution", share * F.col("score"))


def sensitivity(scores: DataFrame, key: str, by: float = 0.2, weights: dict[str, float] | None = None) -> DataFrame:
    """The largest drift of the composite when one weight moves by -/+ ``by`` and the rest are renormalised, ranked within each key. A missing
    component has no weight to move."""
    weights = weights or WEIGHTS
    base = composite(scores, weights)

    def moved(component: str, factor: float) -> Column:
        new = {c: w * factor if c == component else w for c, w in weights.items()}
        total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in new.items()), F.lit(0.0))
        return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in new.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))

    rows = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("position"), F.lit(c).alias("component"), F.greatest(*[F.abs(moved(c, f) - F.col("composite")) for f in (1 - by, 1 + by)]).alias("drift")))
        for k, c in enumerate(weights)
    ]
    out = base.select(key, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(key, "x.*").filter("drift is not null")
    order = Window.partitionBy(key).orderBy(F.round("drift", 9).desc(), "position")
    return out.withColumn("place", F.row_number().over(order)).drop("position")


def status_fold(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """success if all went well, failed if nothing did, else partial."""
    good = F.count_if(ok)
    return rows.groupBy(key).agg(
        F.when(good == F.count("*"), "success").when(good == 0, "failed").otherwise("partial").alias("status"), good.alias("good"), F.count("*").alias("total")
    )


def overall_status(components: DataFrame, key: str) -> DataFrame:
    """(key, status, has_score) -> key, status: failed where no component has a score, complete where all are a success, else partial.

    An unknown status is an error.
    """
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))).cast("string"))
    counted = components.select(key, known.alias("status"), "has_score").groupBy(key).agg(F.coalesce(F.bool_or("has_score"), F.lit(False)).alias("any"), F.bool_and(F.col("status") == "success").alias("all"))
    return counted.select(key, F.when(~F.col("any"), "failed").when(F.col("all"), "complete").otherwise("partial").alias("status"))


def _usable(status: Column) -> Column:
    return status.isin("success", "partial")


def score_document(blocks: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, component, status) and (run, component, rank, cc, mi, severity) -> the score of each run.

    Components are those of ``WEIGHTS`` and ``lizard``, an informational count of complexities that stands in for ``complexity`` where that
    is neither a success nor partial; its status then counts as complexity's. A component that ran and found nothing has 100, one that
    failed, is unsupported or unavailable (or has no row) has no sub-score: it is missing, and the weights of the others are renormalised.
    A run without any of the three newer components is scored by ``LEGACY_WEIGHTS``. A run is failed without a sub-score, complete
    if all its components are a success, else partial. An unknown status is an error.

    Sub-scores and the composite have two digits, weights four. Results are aggregated once, on the map side first.
    """
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))).cast("string"))
    of = lambda c, value: F.max(F.when(F.col("component") == c, value))
    parts = [*WEIGHTS, "lizard"]
    states = blocks.withColumn("status", known).groupBy(key).agg(*[F.coalesce(of(c, F.col("status")), F.lit("unavailable")).alias(f"s_{c}") for c in parts], F.bool_or(F.col("component").isin("sast", "secrets", "vulnerabilities")).alias("newer"))
    own = lambda c, value: F.when(F.col("component") == c, value)
    found = results.groupBy(key).agg(
        F.avg(own("complexity", rank_points(F.col("rank")))).alias("complexity"),
        F.avg(own("lizard", complexity_points(F.coalesce("cc", F.lit(1))))).alias("lizard"),
        F.avg(own("maintainability", clamp(F.coalesce("mi", F.lit(100.0))))).alias("maintainability"),
        *[F.sum(own(c, penalty)).alias(c) for c, penalty in (("security", security_penalty(F.col("severity"))), ("sast", sast_penalty(F.col("severity"))), ("secrets", F.lit(25)), ("vulnerabilities", F.lit(20)))],
    )
    rows = states.join(found, key, "left")
    stands_in = ~_usable(F.col("s_complexity")) & _usable(F.col("s_lizard"))
    full = lambda c: half_even(F.coalesce(c, F.lit(100.0)), 2)
    left = lambda c: half_even(F.greatest(F.lit(0.0), 100.0 - F.coalesce(c, F.lit(0))), 2)
    score = {c: F.when(_usable(F.col(f"s_{c}")), full(c) if c in ("complexity", "maintainability") else left(c)) for c in WEIGHTS}
    score["complexity"] = F.when(stands_in, full("lizard")).otherwise(score["complexity"])
    score |= {c: F.when(F.col("newer"), v) for c, v in score.items() if c not in LEGACY_WEIGHTS}
    status = {c: F.col(f"s_{c}") for c in WEIGHTS} | {"complexity": F.when(stands_in, F.col("s_lizard")).otherwise(F.col("s_complexity"))}
    rows = rows.select(key, "newer", *[score[c].alias(c) for c in WEIGHTS], *[status[c].alias(f"{c}_status") for c in WEIGHTS])
    weight = {c: F.when(F.col(c).isNotNull(), F.when(F.col("newer"), w).otherwise(LEGACY_WEIGHTS.get(c, 0.0))) for c, w in WEIGHTS.items()}
    # in hundredths, as whole numbers, so that halves are exact
    weight = {c: F.rint(w * 100) for c, w in weight.items()}
    total = sum((F.coalesce(w, F.lit(0.0)) for w in weight.values()), F.lit(0.0))
    summed = sum((F.coalesce(F.rint(F.col(c) * 100) * w, F.lit(0.0)) for c, w in weight.items()), F.lit(0.0))
    expected = F.when(F.col("newer"), F.array(*map(F.lit, WEIGHTS))).otherwise(F.array(*map(F.lit, LEGACY_WEIGHTS)))
    scored = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in WEIGHTS]))
    fine = lambda names: F.forall(F.array(*[F.col(f"{c}_status") for c in names]), lambda s: s == "success")
    rows = rows.withColumns({"_total": total, "_summed": summed, "_expected": expected, "components_scored": scored})
    rows = rows.withColumn("missing_components", F.array_except("_expected", "components_scored"))
    few, n = F.size("missing_components") > 0, lambda c: F.size(c).cast("string")
    reduced = F.concat(F.lit("Score computed from a reduced component set: "), n("components_scored"), F.lit(" of "), n("_expected"), F.lit(" components (missing: "), F.array_join("missing_components", ", "), F.lit("); weights renormalized over the components scored. "))
    none = F.size("components_scored") == 0
    return rows.select(
        key, F.when(~none, F.rint(F.col("_summed") / F.nullif(F.col("_total"), F.lit(0.0))) / 100).alias("composite"),
        F.when(none, "failed").when(F.when(F.col("newer"), fine(WEIGHTS)).otherwise(fine(LEGACY_WEIGHTS)), "complete").otherwise("partial").alias("status"),
        *WEIGHTS, *[F.col(f"{c}_status") for c in WEIGHTS],
        *[F.when(F.col(c).isNotNull(), half_even(weight[c] / F.nullif(F.col("_total"), F.lit(0.0)), 4)).alias(f"{c}_weight") for c in WEIGHTS],
        "components_scored", "missing_components", few.alias("reduced"), F.when(few & ~none, reduced).otherwise("").alias("reduced_note"),
    )
