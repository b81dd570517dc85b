"""An inverted index that is written once, with the largest impact of each term, and exact BM25 that reads only lists and blocks that can matter.

Documents are dealt to slots of about ``SLOT`` by a hash of their id. A block has the postings of one term in one slot, and the largest
impact among them (the score that a posting adds, without the term's weight). Blocks are written sorted by term and slot.

A search first sums up what the terms that can add most give to documents, a share ``FIRST`` of what all terms can add together; the k-th best of these
sums is a score that the answer can't fall below. Lists of further terms are read until what the rest - the common terms, whose lists are long -
can add together is less than a share ``REST`` of that bound: a document of the answer has one of the terms that were read, and a good part of its
score comes from them. Documents that can still reach the bound are few; of the terms not yet read only the blocks of their slots are read, and
they are scored in full. Parts of a score are added in the order of terms, so equal documents score equally, and scores are ranked as they are.

Defined results: null texts have no terms; they count as documents, but not for the mean length; a term that a query has twice counts twice; documents without a term of
the query fill an answer up with a score of 0, smallest ids first; rows that repeat an id are one document; no documents, no answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

K1, B = 1.5, 0.75  # fixed values of BM25
#: Documents of a slot, about; the share of a query's largest score that the first terms add; the share of the bound that unread terms may add.
SLOT, FIRST, REST = 4, 0.7, 0.6


class PostingIndex:
    """Blocks, counts of terms and sizes of documents under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def build(self, documents: DataFrame, only: DataFrame | None = None, terms=T.terms) -> PostingIndex:
        """(id, text) -> the index, from one pass over the texts; with ``only`` (term), of these terms."""
        tokens = documents.select("id", terms(F.col("text")).alias("t"))
        rows = tokens.select("id", F.size("t").alias("length"), F.explode_outer("t").alias("term"))
        if only is not None:
            rows = rows.join(only.withColumn("_in", F.lit(True)), "term", "left").withColumn("term", F.when(F.col("_in"), F.col("term")))
        counted = rows.groupBy("id", "term").agg(F.max("length").alias("length"), F.count("*").cast("int").alias("tf"))
        postings = self._written(counted, "postings")
        # a document has a row for each of its terms, or one without a term
        self.sizes = self._written(postings.groupBy("id").agg(F.max("length").alias("length")), "sizes")
        whole = self.sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        self.n, self.mean = whole["n"], whole["mean"] or 1.0
        self.slots = max(1, -(-self.n // SLOT))
        slot = F.pmod(F.xxhash64("id"), F.lit(self.slots)).alias("slot")
        posting = F.struct("id", "tf", "length")
        blocks = postings.filter("term is not null").select("term", slot, posting.alias("p"), self._impact(F.col("tf"), F.col("length")).alias("impact"))
        blocks = blocks.groupBy("term", "slot").agg(F.max("impact").alias("top"), F.collect_list("p").alias("postings"))  # about SLOT at most
        self.blocks = self._written(blocks.repartitionByRange("term", "slot").sortWithinPartitions("term", "slot"), "blocks")
        self.terms = self._written(self.blocks.groupBy("term").agg(F.sum(F.size("postings")).alias("df"), F.max("top").alias("most")), "terms")
        return self

    def _impact(self, tf: Column, length: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(self.mean))))

    def search(self, queries: DataFrame, k: int, terms=T.terms) -> DataFrame:
        """(query_id, text) -> query_id, id, score, rank: the k best documents of each query, ties by id."""
        asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = asked.join(self.terms, "term").select("query_id", "term", idf.alias("idf"), "times", (idf * F.col("times") * F.col("most")).alias("most"))
        # what the terms up to and with this one can add, the largest first, and what all can
        by_most = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term")  # a query's terms
        whole = F.sum("most").over(Window.partitionBy("query_id"))
        asked = asked.withColumn("all_", whole).withColumn("left_", F.col("all_") - F.sum("most").over(by_most))
        asked = self._written(asked, f"asked-{_unique()}")

        first = F.col("left_") + F.col("most") > (1 - FIRST) * F.col("all_")
        seeds = asked.filter(first).join(self.blocks, "term")
        parts = self._written(self._parts(seeds), f"parts-{_unique()}")
        least = self._kth(_sums(parts), k)
        others = asked.filter(~first).join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        reads = F.col("left_") + F.col("most") >= REST * F.col("least")
        more = others.filter(reads).join(self.blocks, "term")
        parts = parts.unionByName(self._written(self._parts(more), f"parts-{_unique()}"))
        sums = self._written(_sums(parts), f"sums-{_unique()}")
        unread = self._written(others.filter(~reads).select("query_id", "term", "idf", "times", "most"), f"unread-{_unique()}")
        rest = unread.groupBy("query_id").agg(F.sum("most").alias("rest"))
        better = self._kth(sums, k).withColumnRenamed("least", "better")
        bound = least.join(better, "query_id", "full").select("query_id", F.greatest("least", "better").alias("least"))
        sums = sums.join(rest, "query_id", "left").join(bound, "query_id", "left")
        able = sums.filter(F.col("least").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("least"))).select("query_id", "id", F.pmod(F.xxhash64("id"), F.lit(self.slots)).alias("slot"))
        self.able = self._written(able, f"able-{_unique()}")
        looked_up = unread.join(self.able.select("query_id", "slot").distinct(), "query_id").join(self.blocks, ["term", "slot"])
        self.read = (asked, seeds, more, looked_up)
        whole_parts = parts.unionByName(self._parts(looked_up)).join(self.able.select("query_id", "id"), ["query_id", "id"])
        listed = F.array_sort(F.collect_list(F.struct("term", "part")))  # a query's terms
        scored = whole_parts.groupBy("query_id", "id").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))
        return self._filled(_top(scored, k), queries, k)

    def _parts(self, met: DataFrame) -> DataFrame:
        rows = met.select("query_id", "term", "idf", "times", F.explode("postings").alias("p"))
        return rows.select("query_id", F.col("p.id").alias("id"), "term", (F.col("idf") * self._impact(F.col("p.tf"), F.col("p.length")) * F.col("times")).alias("part"))

    def _kth(self, sums: DataFrame, k: int) -> DataFrame:
        """A little less than the k-th best sum, as parts are added up in any order here."""
        return _top(sums, k).filter(F.col("rank") == k).select("query_id", (F.col("score") * (1 - 1e-9)).alias("least"))

    def _filled(self, best: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Of the first 2 k ids at most k are hits, so the rest are enough to fill up an answer."""
        first = self.sizes.select("id").orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("ids"))
        hits = best.groupBy("query_id").agg(F.collect_set("id").alias("hits"))
        short = queries.select("query_id").distinct().join(hits, "query_id", "left").filter(F.coalesce(F.size("hits"), F.lit(0)) < k)
        rest = short.join(F.broadcast(first)).select("query_id", F.explode(F.array_except("ids", F.coalesce("hits", F.slice("ids", 1, 0)))).alias("id"), F.lit(0.0).alias("score"))
        return _top(best.drop("rank").unionByName(rest), k)

    def postings_read(self) -> tuple[int, int]:
        """Postings that the last search has read, and those of its terms altogether, counted for each query."""
        asked, *met = self.read
        sized = self.blocks.select("term", F.size("postings").alias("n"))
        return sum(m.agg(F.sum(F.size("postings"))).first()[0] or 0 for m in met), asked.join(sized, "term").agg(F.sum("n")).first()[0] or 0


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex
