import json

from lodestrata.sources import reports


def _frame(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "report string")


def test_bandit_and_semgrep(spark):
    rows = reports.bandit(_frame(spark, {"results": [{"filename": "a.py", "line_number": 3, "issue_text": "t", "issue_severity": "high", "issue_confidence": "Low", "test_id": "B1"}]}, "broken")).collect()
    assert [tuple(r) for r in rows] == [("a.py", 3, "t", "HIGH", "LOW", "B1")]
    result = lambda cwe: {"check_id": "r", "path": "p", "start": {"line": 1, "col": 2}, "extra": {"message": "m", "severity": "warning", "metadata": {"cwe": cwe}}}
    rows = reports.semgrep(_frame(spark, {"results": [result("CWE-1"), result(["CWE-1", "CWE-2"]), result(None)]})).collect()
    assert [r["cwe"] for r in rows] == [["CWE-1"], ["CWE-1", "CWE-2"], []] and {r["severity"] for r in rows} == {"WARNING"}


def test_gitleaks_keeps_no_secret(spark):
    found = [{"RuleID": "k", "File": f, "StartLine": 1, "StartColumn": 2, "Description": "d", "Secret": "hunter2", "Match": "hunter2", "Entropy": 3.5, "Fingerprint": "x"} for f in ("a", "b")]
    rows = reports.gitleaks(_frame(spark, found), spark.createDataFrame([("a",)], "file string")).collect()
    assert [r["file"] for r in rows] == ["a"] and "hunter2" not in str(rows)


def test_osv_by_position(spark):
    deps = spark.createDataFrame([(0, "p", "1"), (1, "q", "2")], "position int, package string, version string")
    results = spark.createDataFrame([(0, []), (1, ["V1", "V2"])], "position int, ids array<string>")
    detail = {"id": "V1", "summary": "s", "severity": [{"score": "9"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "3"}]}]}]}
    details = spark.createDataFrame([(json.dumps(detail),), (json.dumps({"id": "V2"}),)], "detail string")
    rows = {r["vulnerability_id"]: r for r in reports.osv(deps, results, details).collect()}
    assert rows["V1"]["package"] == "q" and rows["V1"]["affected_ranges"] == [">= 0", "< 3"] and rows["V1"]["fixed_versions"] == ["3"]
    assert rows["V2"]["affected_ranges"] == []
