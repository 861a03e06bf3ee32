"""From raw documents to token ids: quality, shared lines, near duplicates, benchmark text, encoding.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents. A stage's rows are written to the shared
folder before the next one reads them, so a lost executor repeats tasks of one stage at most; what only that
stage has read or written on the way is deleted then.

Defined cases: null texts count as empty; rows without doc_id go through the stages that look at a text by itself (quality,
encoding) and stay in the others; rows that repeat a doc_id are judged each by its own text, but by benchmark
text together; columns of any name are carried along; empty tables give an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from sessionloom.llm.common import discard, free_name, settled, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return quality.with_scores(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that it shares with two or more others (the largest doc_id keeps them)."""
    aside = {c: free_name(docs.columns, c) for c in ("n_lines", "n_dropped") if c in docs.columns}
    cut = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped").withColumnsRenamed({b: a for a, b in aside.items()})
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone"]) & (near_dedup.text_hash(docs["text"]) == gone["text_hash"]), "left_anti")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("bpe", encode_texts),
]

#: SQL cannot express the classifier; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir))
        if k:  # the first stage's are the table
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
