"""Target-distribution importance resampling over hashed n-grams.

Features of a text are its runs of 1 to ``order`` consecutive words, hashed by the CRC-32 of the words joined by one space. The
CRC of every word is computed once; that of a longer run follows from it, as appending bytes to a text shifts its CRC by a
linear map over GF(2) that depends on their number alone: crc(A + B) = shift(crc(A), len(B)) ^ crc(B). The maps of the
lengths that occur are kept as tables for each byte of a CRC, so n-grams are composed in numpy and never exist as strings.

1. Each task adds up the buckets of its rows; one aggregation adds up the tasks. Only ``buckets`` numbers reach the driver, at any input size.
2. A bucket's gain is the logarithm of its share in the target over its share in the corpus, both smoothed by one. The gains are broadcast
   (8 bytes for each bucket) and summed over the features of each document.
3. The score adds Gumbel noise drawn from doc_id, so the highest scores are a sample without replacement in
   proportion to the weights. Rows are sorted by range and numbered in each partition; the partitions' counts make the numbers ranks.

Defined cases: null and empty texts have no features and weight 0; of rows that repeat a doc_id all are scored, and in a tie of both score and
doc_id any order is right; rows without doc_id have no noise, so neither score nor rank, and do not count among the rows
drawn from; an empty corpus or target gives gains from the smoothing alone; long texts are cut at spaces on the way, words of any length
stay whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, settled, ship, stored, table
from .words import texts_of

ORDER, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
PIECE = 1 << 20
#: Words whose CRC a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 20

#: Bytes of words as they are with A-Z lower-cased, all others as a space: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


class _Crcs(dict):
    """CRC-32 by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        crc = self[word] = zlib.crc32(word)
        return crc


def word_crcs(text: bytes, known: _Crcs) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length in bytes of each word of ``text``."""
    text = text.translate(_BYTES)
    crcs, lengths, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        words = text[at : end if end >= 0 else len(text)].split()
        crcs.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        at = end if end >= 0 else len(text)
    return np.concatenate(crcs), np.concatenate(lengths)


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """GF(2) products: ``matrix`` holds the images of the 32 bits."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def _doubled(k: int) -> np.ndarray:
    """Images of the 32 bits of a CRC when 2 ** k zero bytes follow."""
    if k:
        half = _doubled(k - 1)
        return _times(half, half)
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)  # one zero bit: shift right, and the polynomial for a bit that falls out
    step = np.where(one & np.uint32(1), np.uint32(0xEDB88320), one >> np.uint32(1)).astype(np.uint32)
    for _ in range(3):
        step = _times(step, step)
    return step


@cache
def shift_table(length: int) -> np.ndarray:
    """4 x 256 values: by byte of a CRC, what it adds to the CRC after ``length`` bytes more."""
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(length.bit_length()):
        if length >> k & 1:
            matrix = _times(_doubled(k), matrix)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, values << np.uint32(8 * b)) for b in range(4)])


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its length in bytes: the CRC of A + B is ``shifted(crc(A), len(B)) ^ crc(B)``."""
    distinct, which = np.unique(lengths, return_inverse=True)
    out = np.zeros_like(crcs)
    tables = np.stack([shift_table(int(n)) for n in distinct]) if len(distinct) else np.zeros((0, 4, 256), np.uint32)
    for b in range(4):
        out ^= tables[which, b, crcs >> np.uint32(8 * b) & np.uint32(255)]
    return out


def feature_crcs(crcs: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``order`` words joined by one space, shorter runs first."""
    out, longer = [crcs], crcs
    if order > 1 and len(crcs) > 1:
        spaced = shifted(np.full_like(crcs, zlib.crc32(b" ")), lengths) ^ crcs  # of a space and the word
        for n in range(1, min(order, len(crcs))):
            longer = shifted(longer[:-1], lengths[n:] + 1) ^ spaced[n:]
            out.append(longer)
    return np.concatenate(out)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``text`` fall into each bucket."""
    ship(texts.sparkSession)

    def run(batches):
        total, known = np.zeros(buckets, np.int64), _Crcs()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                total += np.bincount(feature_crcs(*word_crcs(text, known), order) % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in ``target`` over that in ``corpus``) of each bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of the gains of the features) of each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        gain, known = shared.value, _Crcs()
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("text")):
                crcs, lengths = word_crcs(text, known)
                features = feature_crcs(crcs, lengths, order) % np.uint32(len(gain))
                rows.append((len(crcs), len(features), int(gain[features].sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the SHA-256 of ``seed:doc_id``; null for a null doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _in_order(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows`` sorted by range, with ``part`` and ``place`` (from 0) in it; parts follow each other in the order ``by``."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(n, n + b.num_rows))], names=schema.names)
            n += b.num_rows

    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row; ``percent`` of the rows of ``min_words`` words and more have a rank."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))

    def sorted_rows() -> DataFrame:
        # written first: sorting by range reads its rows twice
        scored = stored(weighted(docs, gain, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
        rows = scored.withColumn("drawn_from", F.col("score").isNotNull() & (F.col("n_words") >= min_words))
        return _in_order(rows, [F.desc("drawn_from"), F.desc("score"), F.asc("doc_id")])

    rows = settled(sorted_rows)
    parts = rows.groupBy("part").agg(F.count("*").alias("rows"), F.count_if("drawn_from").alias("n")).orderBy("part").toArrow()
    size, before = sum(parts.column("n").to_pylist()), np.cumsum([0, *parts.column("rows").to_pylist()])
    first = rows.sparkSession.createDataFrame([(p, int(n)) for p, n in zip(parts.column("part").to_pylist(), before, strict=False)], "part int, before long")
    place = F.col("before") + F.col("place")
    rank = F.when(F.col("drawn_from") & (place < percent * size // 100), place + 1)
    # one row for each partition of the sort
    return rows.join(F.broadcast(first), "part").select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB. The CRC of each distinct word is computed once here too.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS word FROM d), fb AS (SELECT unnest(w) AS word FROM b),
k AS (SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM f UNION SELECT word FROM fb)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s, (SELECT count(*) FROM fb)::DOUBLE AS t),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1) * (n.s + {BUCKETS}) / ((s.s + 1) * (n.t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM c WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN place END AS rank FROM c LEFT JOIN r USING (doc_id)
"""
