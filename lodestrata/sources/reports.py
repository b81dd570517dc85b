"""Analyzer reports (JSON text, one a row) as tables of findings. Schemas name only what is kept, so a secret's text never enters a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BANDIT = "struct<results:array<struct<filename:string,line_number:int,issue_text:string,issue_severity:string,issue_confidence:string,test_id:string>>>"
_SEMGREP = (
    "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,"
    "extra:struct<message:string,severity:string,metadata:struct<cwe:string>>>>>"
)
_GITLEAKS = "array<struct<RuleID:string,File:string,StartLine:int,StartColumn:int,Description:string,Entropy:double,Fingerprint:string>>"
_OSV = (
    "struct<id:string,summary:string,severity:array<struct<score:string>>,"
    "affected:array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>"
)


def bandit(reports: DataFrame) -> DataFrame:
    """(report) -> file, line, message, severity, confidence, rule_id."""
    rows = reports.select(F.explode(F.from_json("report", _BANDIT)["results"]).alias("r"))
    return rows.select(
        F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), F.col("r.issue_text").alias("message"),
        F.upper("r.issue_severity").alias("severity"), F.upper("r.issue_confidence").alias("confidence"), F.col("r.test_id").alias("rule_id"),
    )


def _string_or_list(raw: Column) -> Column:
    """A JSON value that is a string or a list of strings, as a list."""
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def semgrep(reports: DataFrame) -> DataFrame:
    """(report) -> rule_id, file, line, col, message, severity (upper case), cwe (always a list)."""
    rows = reports.select(F.explode(F.from_json("report", _SEMGREP)["results"]).alias("r"))
    return rows.select(
        F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.start.col").alias("col"),
        F.col("r.extra.message").alias("message"), F.upper("r.extra.severity").alias("severity"), _string_or_list(F.col("r.extra.metadata.cwe")).alias("cwe"),
    )


def gitleaks(reports: DataFrame, files: DataFrame) -> DataFrame:
    """(report), (file) -> rule_id, file, line, col, message, severity, entropy, fingerprint, of the given files only."""
    rows = reports.select(F.explode(F.from_json("report", _GITLEAKS)).alias("r"))
    found = rows.select(
        F.col("r.RuleID").alias("rule_id"), F.col("r.File").alias("file"), F.col("r.StartLine").alias("line"), F.col("r.StartColumn").alias("col"),
        F.col("r.Description").alias("message"), F.lit("HIGH").alias("severity"), F.col("r.Entropy").alias("entropy"), F.col("r.Fingerprint").alias("fingerprint"),
    )
    return found.join(files.select("file"), "file", "left_semi")


def osv(dependencies: DataFrame, results: DataFrame, details: DataFrame) -> DataFrame:
    """Dependencies (position, package, version), batch results (position, ids) and details (detail) -> a row for each
    dependency and vulnerability: package, version, vulnerability_id, summary, severity, affected_ranges, fixed_versions."""
    d = details.select(F.from_json("detail", _OSV).alias("v")).select("v.id", "v.summary", "v.severity", "v.affected")
    events = F.flatten(F.flatten(F.transform(F.coalesce("affected", F.array().cast(dict(d.dtypes)["affected"])), lambda a: F.transform(a.ranges, lambda r: r.events))))
    texts = F.transform("events", lambda e: F.when(e.introduced.isNotNull(), F.concat(F.lit(">= "), e.introduced)).when(e.fixed.isNotNull(), F.concat(F.lit("< "), e.fixed)))
    d = d.withColumn("events", events).select(
        F.col("id").alias("vulnerability_id"), "summary", F.element_at(F.transform("severity", lambda s: s.score), 1).alias("severity"),
        F.array_compact(texts).alias("affected_ranges"), F.array_compact(F.transform("events", lambda e: e.fixed)).alias("fixed_versions"),
    )
    hit = results.select("position", F.explode("ids").alias("vulnerability_id"))
    return dependencies.join(hit, "position").join(d, "vulnerability_id", "left").drop("position")
