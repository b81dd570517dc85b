"""Questions answered from evidence, with embedding and language models as named extension points.

A provider is a function without arguments that makes, once in a task, an object with a method for a batch of texts: ``embed`` (lists of
numbers) or ``generate`` (answers). Texts reach it in batches of ``BATCH``; a batch that fails becomes rows with an error, not a failed job, and
a stage whose rows have errors is failed as a whole.

An answer goes through these steps: a blank question and one without evidence are refused; one about an unknown run says so; the others get a prompt
of numbered evidence, a model's answer, and the citations of it that exist; an empty answer, or one that calls the evidence insufficient, is refused.

Defined results: null questions are blank; white space around a question goes; a failed model's answer is null with its error; no questions, no answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import retrieval

BATCH = 32
_embedders: dict[str, Callable] = {}
_models: dict[str, Callable] = {}


def register_embedder(name: str, make: Callable) -> None:
    _embedders[name] = make


def register_model(name: str, make: Callable) -> None:
    _models[name] = make


def _in_batches(rows: DataFrame, text: str, make: Callable, method: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``rows`` with ``value`` and ``error``: what the provider says to each ``text``."""
    names, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, broken = None, None
        try:
            provider = make()
        except Exception as e:  # a provider that can't be made fails every batch
            broken = f"{type(e).__name__}: {e}"
        for batch in batches:
            values: list = []
            errors: list = []
            for texts in batched(batch.column(at).to_pylist(), BATCH):
                error, found = broken, []
                if provider is not None:
                    try:
                        found = list(getattr(provider, method)(list(texts)))
                        error = None if len(found) == len(texts) else f"{len(found)} values for {len(texts)} texts"
                    except Exception as e:  # anything a provider raises is its batch's error
                        error = f"{type(e).__name__}: {e}"
                values += found if error is None else [None] * len(texts)
                errors += [error] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow), pa.array(errors, pa.string())], [*names, "value", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, value {kind}, error string")


def embed(chunks: DataFrame, provider: str, text: str = "chunk_text") -> DataFrame:
    """Chunks with ``vector``, ``dimension``, ``model_name`` and ``error``."""
    out = _in_batches(chunks, text, _embedders[provider], "embed", "array<double>", pa.list_(pa.float64()))
    return out.withColumnRenamed("value", "vector").withColumns({"dimension": F.size("vector"), "model_name": F.lit(provider)})


def stage_status(embedded: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, error) of an embedding stage, (run_id) -> run_id, status, total_embeddings, error: a run with any error has failed and keeps no vector;
    a run without chunks is completed."""
    told = embedded.groupBy("run_id").agg(F.count("*").alias("n"), F.max("error").alias("error"))
    rows = runs.select("run_id").distinct().join(told, "run_id", "left")
    failed = F.col("error").isNotNull()
    return rows.select("run_id", F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).alias("total_embeddings"), "error")


def prompt_of(question: Column, evidence: Column) -> Column:
    return F.concat(F.lit("User Question: "), question, F.lit("\n\nRepository Evidence:\n"), evidence, F.lit("\n\nAnswer from this evidence alone and cite its tags."))


def echo_model(prompt: Column) -> Column:
    """A model without chance, for tests: it repeats the question's first line and cites every tag of the prompt."""
    tags = F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\[(E\d+)\]"), F.lit(1)))
    question = F.trim(F.regexp_extract(prompt, r"(?i)Question:\s*(.+)", 1))
    cited = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), "")
    answer = F.concat(F.lit("Based on the repository evidence, "), question, F.lit(" is implemented as shown in the source code "), cited, F.lit("."))
    return F.when((F.size(tags) == 0) | F.contains(prompt, F.lit("INSUFFICIENT_EVIDENCE_TEST")), retrieval.INSUFFICIENT).otherwise(answer)


def ask(questions: DataFrame, runs: DataFrame, evidence: DataFrame, model: str | None = None, budget: int = 12_000) -> DataFrame:
    """(query_id, run_id, question), (run_id), (query_id, rank, chunk_id, path, first, last, lang, entity, sha, text) -> query_id, answer, citations
    (chunk ids), retrieved, error. ``model``: a registered model; without one, ``echo_model``."""
    asked = questions.withColumn("question", F.regexp_replace(F.coalesce("question", F.lit("")), r"^\s+|\s+$", ""))
    asked = asked.join(runs.select("run_id").distinct().withColumn("_known", F.lit(True)), "run_id", "left")
    fields = F.struct("rank", F.struct("chunk_id", "path", "first", "last", "lang", "entity", "sha", "text").alias("c"))
    listed = evidence.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["c"]).alias("chunks"))  # k chunks a question
    rows = asked.join(listed, "query_id", "left").withColumn("blocks", retrieval.labelled_evidence(F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType)), budget))
    context = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    ready = (F.col("question") != "") & F.col("_known") & (F.size("blocks") > 0)
    rows = rows.withColumn("prompt", F.when(ready, prompt_of(F.col("question"), context)))
    if model is None:
        rows = rows.withColumn("value", echo_model(F.col("prompt"))).withColumn("error", F.lit(None).cast("string"))
    else:
        said = _in_batches(rows.filter("prompt is not null").select("query_id", "prompt"), "prompt", _models[model], "generate", "string", pa.string()).select("query_id", "value", "error")
        rows = rows.join(said, "query_id", "left")
    known = F.transform("blocks", lambda b: b["label"])
    good, _, clean = retrieval.citations(F.coalesce("value", F.lit("")), known)
    answer, cited = retrieval.settle(clean, good)
    chunk = lambda tag: F.filter("blocks", lambda b: b["label"] == tag)[0]["chunk_id"]
    lost = F.concat(F.lit("Analysis run '"), F.coalesce("run_id", F.lit("")), F.lit("' not found."))
    final = F.when(F.col("question") == "", retrieval.INSUFFICIENT).when(F.col("_known").isNull(), lost).when(F.size("blocks") == 0, retrieval.INSUFFICIENT).when(F.col("error").isNull(), answer)
    none = F.array().cast("array<string>")
    return rows.select("query_id", final.alias("answer"), F.when(ready & F.col("error").isNull(), F.transform(cited, chunk)).otherwise(none).alias("citations"), F.when(ready, F.size("chunks")).otherwise(0).alias("retrieved"), "error")
