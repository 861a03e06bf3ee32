"""Exact dedup: a log-structured merge index of text digests.

Each task's rows are a memtable: it is flushed as one file, sorted by digest (:func:`flush`). Compaction
(:func:`compact`) merges runs, or levels made by it before, into one entry a digest: the row that stays, its length, and
the number of rows. The entries of more than one row get a filter (:func:`filter_of`): 64-bit blocks with three bits an
entry, at most ``FILTER_BLOCKS`` of them, so that its broadcast is bounded; a fuller filter lets more rows through, and no
result depends on it. Rows that the filter turns away stay as they are; they meet no exchange and their texts are never moved.
The others look their entry up by a join, where the rows of a digest with more than ``SALT_ROWS`` are dealt by a salt.

Every hit is verified by its bytes: of each digest the smallest and the largest text must be the same. They are
found by partial aggregation before the exchange, so a group of any size moves one text from a task. Where they differ,
the rows are grouped again by their whole text.

Texts are equal when they are identical without the characters ``[\x20\x09-\x0D]``. The row with the most
code points in its original text stays, then the smallest doc_id.

Defined cases: null counts as empty, and all empty texts are equal; rows that repeat a doc_id and text
share one decision, each counts in group_size; a row without doc_id stays only if none with one is as long;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, stored, table

#: Rows of one digest that one task looks up, about.
SALT_ROWS = 1_000
FILTER_BLOCKS = 1 << 20
#: Digests of more than SALT_ROWS rows that are broadcast; beyond that Spark chooses the join.
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", "")


def digest_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def flush(docs: DataFrame) -> DataFrame:
    """Sorted digest runs, one file a task: doc_id, digest, n (code points of the original)."""
    rows = docs.select("doc_id", digest_of(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return stored(rows.sortWithinPartitions("digest"))


def compact(*levels: DataFrame) -> DataFrame:
    """One entry a digest: digest, doc_id (of the row that stays), n (its length), size (rows); from runs, which count 1 a row, and from results of this."""
    entries = reduce(DataFrame.unionByName, [x.select("digest", "doc_id", "n", (F.col("size") if "size" in x.columns else F.lit(1)).cast("long").alias("size")) for x in levels])
    best = F.min(F.struct((-F.col("n")).alias("short"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    merged = entries.groupBy("digest").agg(best.alias("best"), F.sum("size").alias("size"))
    return stored(merged.select("digest", F.col("best.id").alias("doc_id"), (-F.col("best.short")).alias("n"), "size").sortWithinPartitions("digest"))


def _bits(digest: str) -> Column:
    """Three of 64 bits, as one long."""
    h = F.xxhash64(F.lit(3), digest)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def filter_of(entries: DataFrame) -> tuple[DataFrame, int]:
    """(block, bits) of a filter for the digests of ``entries``, and its number of blocks: 16 bits an entry up to FILTER_BLOCKS."""
    n_blocks = min(FILTER_BLOCKS, entries.count() // 4 + 1)
    blocks = entries.select(F.pmod(F.xxhash64("digest"), F.lit(n_blocks)).alias("block"), _bits("digest").alias("bits"))
    return stored(blocks.groupBy("block").agg(F.bit_or("bits").alias("bits"))), n_blocks


def with_pass(rows: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` (digest) with ``may``: whether the filter may hold the digest."""
    asked = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(n_blocks)))
    met = asked.join(F.broadcast(bloom), "block", "left")
    return met.withColumn("may", F.coalesce(F.col("bits").bitwiseAND(_bits("digest")) == _bits("digest"), F.lit(False))).drop("block", "bits")


def _looked_up(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest) with keep_id and size of their entry, null without one; the rows of large entries are dealt by a salt."""
    large = stored(entries.where(F.col("size") > SALT_ROWS).select("digest", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts")))
    hint = F.broadcast if large.count() <= BROADCAST_ROWS else (lambda df: df)
    salted = rows.join(hint(large), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "salts"), F.lit(0)).cast("int")).drop("salts")
    dealt = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > SALT_ROWS, F.ceil(F.col("size") / SALT_ROWS)).otherwise(1).cast("int") - 1)))
    return salted.join(dealt.select("digest", "salt", F.col("doc_id").alias("keep_id"), "size"), ["digest", "salt"], "left").drop("salt")


def unequal(docs: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The digests that more than one text has, of those that the filter lets through."""
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of(F.col("norm")))
    hits = with_pass(texts, bloom, n_blocks).where("may")
    return stored(hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest"))


def _by_text(docs: DataFrame, wrong: DataFrame) -> DataFrame:
    """digest, doc_id, n, and keep_id and size by whole text, of the rows whose digest is wrong."""
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of(F.col("norm")))
    rows = stored(texts.join(wrong, "digest", "left_semi"))
    best = F.min(F.struct((-F.col("n")).alias("short"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = rows.groupBy("norm").agg(best.alias("best"), F.count("*").alias("size"))
    return rows.join(groups, "norm").select("doc_id", "n", "digest", F.col("best.id").alias("keep_id"), "size")


def dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = flush(docs)
    repeated = stored(compact(runs).where("size > 1"))
    bloom, n_blocks = filter_of(repeated)
    wrong = unequal(docs, bloom, n_blocks)
    asked = with_pass(runs, bloom, n_blocks)
    alone = asked.where("not may").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    found = _looked_up(asked.where("may").select("doc_id", "n", "digest"), repeated)
    if not wrong.isEmpty():  # two texts with one digest
        found = found.join(wrong, "digest", "left_anti").unionByName(_by_text(docs, wrong))
    found = found.select("doc_id", "digest", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("size"))
    return alone.unionByName(found).select("doc_id", "keep_id", F.col("size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
