"""Line dedup: lines that many documents share stay in one of them.

Lines are cut at ``\\n``; a line's key is the line without white space at both ends, A-Z lower-cased.
Keys go through the plan as 128-bit hashes: each document's hashes are made distinct,
an aggregation counts the documents of each hash (partial sums before the exchange, safe for hot lines), a join returns the frequent hashes to the
positions that hold them. A second join brings each document its positions, which moves the texts once; they are put together again from their lines.

Defined cases: null or empty text is one empty line, which is never dropped; a key repeated inside one
document counts once; rows that repeat a doc_id are one document for the count, and all of them
keep the line if that doc_id is the largest; rows without doc_id count for no line and lose none; an empty table gives an
empty result; other columns are carried along untouched by :func:`dedup_lines`, but for those named n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, numbered, stored, table


def _raw() -> Column:
    return F.coalesce("text", F.lit(""))


def _keys() -> Column:
    return F.transform(F.split(_raw(), "\n"), lambda x: ascii_lower(F.btrim(x, F.lit(WS_CHARS))))


def _hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, pos): lines to drop. A key of ``min_chars`` code points in ``min_docs`` documents stays in the largest doc_id."""
    docs = docs.where("doc_id is not null")
    lines = docs.select("doc_id", F.xxhash64(_raw()).alias("text_hash"), F.posexplode(_keys()).alias("pos", "key")).where(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", *_hashes("key"))
    per_doc = docs.select("doc_id", F.explode(F.array_distinct(F.filter(_keys(), lambda k: F.length(k) >= min_chars))).alias("key")).select("doc_id", *_hashes("key"))
    # written first: then both sides of the join are exchanged by themselves, and Spark can split a hot key's partition
    frequent = stored(per_doc.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs))
    return lines.join(frequent, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "text_hash", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the shared lines gone from ``text``, and ``n_lines`` (before) and ``n_dropped`` added."""
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))
    own, back = numbered(docs, ("text", "n_lines", "n_dropped"))
    rows = docs.select(*own, "doc_id", "text", F.xxhash64(_raw()).alias("text_hash"))
    joined = rows.join(drops, ["doc_id", "text_hash"], "left").withColumn("lines", F.split(_raw(), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), _raw()).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = joined.select(*(c for c in joined.columns if c.startswith("_")), text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
    return out.select(*back, "text", "n_lines", "n_dropped").select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB. ``{docs}`` is the relation with doc_id and text.
SQL_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {docs}),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM m GROUP BY doc_id
"""
SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({SQL_LINES.format(docs='documents')})"
