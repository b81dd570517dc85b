"""The code-analytics tables, derived from the driver's tables by a fixed projection. ``CTE`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), "text", "lang", "source")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", "file_path", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines of 40 characters or more, named by the first word of their first line."""
    from lodestrata.operators.chunking import islands

    runs = islands(lines(spark, d).filter("length(line) >= 40"), ["doc_id", "file_path"], "i", {"first_line": F.min_by("line", "i")})
    return runs.select("doc_id", "file_path", "start_line", "end_line", F.element_at(F.split("first_line", " "), 1).alias("name"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").count()
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("finding_id"),
        F.col("event_type").alias("analyzer"),
        (F.col("event_id") % docs).alias("doc_id"),
        F.when(k > 0, k).alias("line"),
        F.concat(F.lit("rule_"), (F.col("user_id") % 10).cast("string")).alias("rule_id"),
        F.expr("case when value >= 75 then 'HIGH' when value >= 25 then 'MEDIUM' else 'LOW' end").alias("severity"),
        F.col("ts").alias("at"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("repo_id"),
        F.expr("case o_orderstatus when 'F' then 'complete' when 'O' then 'partial' else 'failed' end").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("version"),
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """A row of analyzer output for each line item."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("number"),
        F.expr("case l_returnflag when 'R' then 'HIGH' when 'A' then 'MEDIUM' else 'LOW' end").alias("severity"),
        F.col("l_quantity").alias("cc"), (F.col("l_extendedprice") / 1000).alias("mi"),
        F.expr("case l_linestatus when 'F' then 'ERROR' else 'INFO' end").alias("level"),
        (F.col("l_tax") == 0.08).alias("secret"),
    )


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("_"), (F.col("p_partkey") % 41).cast("string")).alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("class_name"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(call_id, caller, file, name): each line item calls a symbol by name."""
    s, n = symbols(spark, d), table(spark, d, "part").count()
    target = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % n
    made = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("call_id"), F.col("l_partkey").alias("caller"), target.alias("target"))
    named = made.join(s.select(F.col("id").alias("target"), "name"), "target")
    return named.join(s.select(F.col("id").alias("caller"), "file"), "caller").select("call_id", "caller", "file", "name")


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, doc_id): documents that contain the text of a benchmark item; looked for once, as metrics read it several times."""
    from lodestrata.operators.graph import checkpoint_dir
    from lodestrata.operators.retrieval import containing

    checkpoint_dir(spark)

    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("part"))
    return containing(files(spark, d).select("doc_id", "text"), items).select("item_id", "doc_id").checkpoint()


CTE = {
    "files": "files as (select doc_id, source || '/' || cast(doc_id as varchar) as file_path, text, lang, source from documents)",
    "lines": "lines as (select doc_id, file_path, unnest(range(1, len(a) + 1))::int as i, unnest(a) as line from (select *, string_split(text, chr(10)) as a from files))",
    "entities": """entities as (select doc_id, file_path, min(i) as start_line, max(i) as end_line, string_split(min_by(line, i), ' ')[1] as name
      from (select *, i - row_number() over (partition by doc_id order by i) as g from lines where length(line) >= 40) group by doc_id, file_path, g)""",
    "findings": """findings as (select event_id as finding_id, event_type as analyzer, event_id % (select count(*) from documents) as doc_id,
      case when json_extract_string(props, '$.k')::int > 0 then json_extract_string(props, '$.k')::int end as line,
      'rule_' || cast(user_id % 10 as varchar) as rule_id, case when value >= 75 then 'HIGH' when value >= 25 then 'MEDIUM' else 'LOW' end as severity, ts as at from events)""",
    "runs": """runs as (select o_orderkey as run_id, o_custkey as repo_id, case o_orderstatus when 'F' then 'complete' when 'O' then 'partial' else 'failed' end as status,
      o_orderdate as created_at, o_orderpriority as version from orders)""",
    "results": """results as (select l_orderkey as run_id, l_linenumber as number, case l_returnflag when 'R' then 'HIGH' when 'A' then 'MEDIUM' else 'LOW' end as severity,
      l_quantity as cc, l_extendedprice / 1000 as mi, case l_linestatus when 'F' then 'ERROR' else 'INFO' end as level, l_tax = 0.08 as secret from lineitem)""",
    "symbols": "symbols as (select p_partkey as id, p_name || '_' || p_partkey % 41 as name, p_brand as file, p_type as class_name from part)",
    "calls": """calls as (select l_orderkey || ':' || l_linenumber as call_id, l_partkey as caller, c.file, t.name from lineitem
      join symbols t on t.id = (l_partkey * 7 + l_linenumber) % (select count(*) from part) join symbols c on c.id = l_partkey)""",
    "truth": "truth as (select item_id, doc_id from documents d join benchmark b on contains(d.text, b.text))",
}
_NEEDS = {"lines": ["files"], "entities": ["files", "lines"], "calls": ["symbols"]}


def sql(*names: str, recursive: bool = False) -> str:
    """``with`` and the definitions of these views and those that they need, without a closing comma."""
    order: list[str] = []
    for name in names:
        for x in [*_NEEDS.get(name, []), name]:
            if x not in order:
                order.append(x)
    return f"with {'recursive ' * recursive}" + ",\n".join(CTE[x] for x in order)
