"""The corpus pipeline: clean documents from ``documents``, packed into training sequences.

Each stage takes what the one before it kept, written as Parquet and read again. None of them shuffles whole texts for a
decision as long as the list of documents concerned is small enough to be sent to all executors.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from sparkgrove.llm.common import stored, stored_small, table
from sparkgrove.llm.queries import WORD_BPE


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the documents whose doc_id is among ids (doc_id)."""
    return docs.join(ngram_join.limited(ids.select(F.col("doc_id").alias("_gone")).distinct()), F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines within two edits of each other the first stays; a document of which only blank lines are left goes."""
    cleaned = line_dedup.dedup_lines(docs.withColumn("_had_text", F.col("text").isNotNull()), threshold=2)
    kept = cleaned.where(F.col("text").isNotNull() | ~F.col("_had_text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by their word 5-grams that with the smallest doc_id stays, once.

    A document without an id stays unless it is a copy of one that has an id. Each text of an id counts as a document of its
    own; those beside the text with the least hash come after all ids.
    """
    again = stored_small(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return _without_near_copies(docs)
    mark = F.xxhash64("text")
    texts = stored(docs.join(ngram_join.limited(again), "doc_id", "left_semi").select("doc_id", mark.alias("_mark")).distinct())
    others = texts.join(texts.groupBy("doc_id").agg(F.min("_mark").alias("_least")), "doc_id").where("_mark <> _least")
    last = docs.agg(F.max("doc_id")).first()[0]
    others = stored(others.select(F.col("doc_id").alias("_id"), "_mark", (F.monotonically_increasing_id() + (last + 1)).alias("_new")))
    told = docs.join(ngram_join.limited(others), (F.col("doc_id") == F.col("_id")) & (mark == F.col("_mark")), "left")
    told = told.withColumn("_own", F.col("doc_id")).withColumn("doc_id", F.coalesce("_new", "doc_id"))
    return _without_near_copies(told.drop("_id", "_mark", "_new")).withColumn("doc_id", F.col("_own")).select(*docs.columns)


def _without_near_copies(docs: DataFrame) -> DataFrame:
    """The same for documents whose equal ids have equal texts."""
    found = stored_small(ngram_join.ngram_components(docs, words=5, percent=80))
    kept = without(docs, found.where("component_id <> doc_id").select("doc_id"))
    if found.where("doc_id IS NULL AND component_id IS NOT NULL").limit(1).count():
        copies = docs.where("doc_id IS NULL").select("text").distinct().join(docs.where("doc_id IS NOT NULL").select("text").distinct(), "text", "left_semi")
        kept = kept.join(copies.select(F.col("text").alias("_copy")), F.col("doc_id").isNull() & (F.col("text") == F.col("_copy")), "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():
        ids = ngram_join.limited(repeated.select(F.col("doc_id").alias("_again")))
        kept = without(kept, repeated).unionByName(kept.join(ids, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id"]))
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go, whatever their ids: the search knows them by their texts' hashes."""
    # stored first, so that the filter on it isn't worked out within the search
    gone = stored_small(decontamination.contaminated_marks(docs, table(spark, sf_dir, "benchmark"), n=10).select(F.col("mark").alias("_gone")))
    return docs.join(ngram_join.limited(gone), decontamination.mark_of(F.col("text")) == F.col("_gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens at most."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), end=1, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Its stages are a trained classifier, an edit join and a tokenizer; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
