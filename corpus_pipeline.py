"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again for the next, so a lost executor costs one stage's tasks at
most. A document is named by its id and a hash of its text, so rows that share an id, or have none, are told apart.

Defined results: null texts and texts without a letter have no language and go; very long texts are judged whole; of rows that
repeat id and text one stays; a null id counts after all ids; ties keep what the stages' operators define; an empty table
gives no rows; extra columns, whatever their names, stay with their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import jaccard, langid, mixing, packing, quality
from lodestrata.llm.common import bound_batches, discard, few, materialize, only_result, table

#: Below this probability of its best language a text is in none of them.
LEAST_LANGUAGE_SCORE = 0.5
#: Near duplicates share four fifths of their shingles of five words. (op9's contract has numbers of its own.)
NEAR_WORDS, NEAR = 5, jaccard.Rule(80, 100)
#: Bytes of words that a worker keeps in the last stage, in each of two generations; executors hold what earlier stages took as well.
WORD_CACHE = 32 << 20


def _only_text(docs: DataFrame) -> DataFrame:
    """The same rows with every column but ``text`` under a name that can't clash with a result's."""
    return docs.toDF(*[c if c == "text" else f"_in{i}" for i, c in enumerate(docs.columns)])


def _named(docs: DataFrame, names: DataFrame):
    """Joins rows of ``docs`` with their (_id, _key) in ``names``."""
    return docs["doc_id"].eqNullSafe(names["_id"]) & (F.xxhash64(docs["text"]) == names["_key"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: ``und``, or no language likely enough."""
    langs, p = langid.train(docs)
    told = langid.identify(_only_text(docs), langs, p)
    kept = told.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier takes for bad; it learns from labelled documents among those given."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(_only_text(docs), weights)
    return scored.filter(F.col("score") >= quality.THRESHOLD).drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; documents without words all stay."""
    found = jaccard.join(docs, NEAR_WORDS, NEAR).filter("component is not null")
    found = found.groupBy("component", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("_n"))
    found = materialize(spark, found, "near-duplicates")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("first"))
    stays = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_key") == F.col("first._key"))
    told = materialize(spark, found.join(first, "component").select("_id", "_key", "_n", stays.alias("_stays")), "near-duplicates-told")
    gone = few(told.filter("not _stays"))
    kept = docs.join(gone, _named(docs, gone), "left_anti")
    twice = few(told.filter("_stays and _n > 1"))  # rows that repeat id and text
    again = docs.join(twice, _named(docs, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, _named(docs, twice), "left_anti").unionByName(again).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go."""
    sizes = materialize(spark, mixing.word_sizes(docs, F.xxhash64("text").alias("_key")), "mixture-sizes")
    copies = mixing.mix(sizes, carry=("_key",)).filter("epochs > 0").groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.max("epochs").alias("_epochs"))
    copies = few(materialize(spark, copies, "mixture-copies"))
    repeated = docs.join(copies, _named(docs, copies), "inner")
    return repeated.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies["_epochs"])).alias("_copy")).toDF(*docs.columns, "_copy").drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, cache_bytes=WORD_CACHE)


def _bounded(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", _bounded(language)),
    ("quality", _bounded(good_quality)),
    ("near_duplicates", _bounded(near_duplicates)),
    ("mixture", _bounded(mixture)),
    ("packed", _bounded(packed)),
]

#: The language model, the classifier and the tokenizer are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only_result(spark) as result:
            before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
            result.append(docs)
        if hasattr(before, "written_to"):  # the next stage has read it
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
