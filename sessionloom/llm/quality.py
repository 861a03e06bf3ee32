"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms are pairs of neighbouring bytes by class (letters, upper case, digits, punctuation, accents), which
show script, case and layout in any language; a randomised SVD of the labelled rows' term matrix gives the
latent space, to which the share of distinct words in a window and of distinct lines is appended.
The labelled vectors are broadcast; every document's exact cosine with all of them is a blocked matrix
product, and its ``NEIGHBOURS`` nearest vote with weight similarity ** ``SHARPNESS``.

``MAX_LABELLED`` bounds the labelled rows that are used (the first by a hash of doc_id), and with them the
broadcast: MAX_LABELLED * (LATENT + 2) + TERMS * LATENT floats, under 3 MB, at any input size.

Defined cases: null and empty texts are scored like any other (their latent part is zero); labels that are
null or belong to no document are left out; of several labels of a doc_id the smallest counts, of several texts the first in
order; without any label every score is 0.5; repeated rows get equal scores; rows without doc_id are scored and not held out;
an empty table gives an empty result; other columns are carried along by :func:`with_scores`, which replaces one of the score's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table
from .words import texts_of

MAX_LABELLED, LATENT, NEIGHBOURS, SHARPNESS = 4_000, 32, 15, 8
CLASSES = 64
TERMS = CLASSES * CLASSES
WINDOW = 64


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        if "a" <= c <= "z":
            out[i] = i - 96
        elif "A" <= c <= "Z":
            out[i] = 27
        elif "0" <= c <= "9":
            out[i] = 28
        elif c in " \n\t\r\v\f":
            out[i] = 30 if c == "\n" else 29
        elif i >= 0xC0:
            out[i] = 31
        elif i >= 0x80:
            out[i] = 32 + (i - 0x80) // 8
        else:
            out[i] = 40 + i % 24  # control and punctuation
    return out


_CLASS = _byte_classes()


def terms(text: bytes) -> tuple[np.ndarray, list[float]]:
    """Root of the relative frequency of each term; distinct share of words by window and of lines, each less 1."""
    c = _CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
    f = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=TERMS).astype(np.float32) / max(len(c) - 1, 1))
    words, lines = text.split(), text.split(b"\n")
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / max(len(words), 1) if words else 1.0
    return f, [distinct - 1.0, len(set(lines)) / len(lines) - 1.0]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Neighbours:
    """Projection, labelled vectors and their labels."""

    def __init__(self, matrix: np.ndarray, extra: np.ndarray, labels: np.ndarray):
        rng = np.random.default_rng(7)
        k = min(LATENT, *matrix.shape)
        q = np.linalg.qr(matrix @ rng.standard_normal((matrix.shape[1], k + 8)).astype(np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(matrix @ (matrix.T @ q))[0]
        self.axes = np.linalg.svd(q.T @ matrix, full_matrices=False)[2][:k].T.astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self.embed(matrix, extra)

    def embed(self, matrix: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return _unit(np.concatenate([_unit(matrix @ self.axes), extra.astype(np.float32)], 1))

    def score(self, texts: list[bytes], block: int = 500) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), block):
            rows = [terms(t) for t in texts[i : i + block]]
            cosine = self.embed(np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.take_along_axis(cosine, near, 1).clip(1e-6).astype(np.float64) ** SHARPNESS
            out[i : i + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out.clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Neighbours | None:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1, ``max_labelled`` at most."""
    spark = docs.sparkSession
    ship(spark)
    learn = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    chosen = learn.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                made = [terms(t) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([m[0].astype(np.float16).tobytes() for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.float64())), part.column("label"), part.column("doc_id")], names=["m", "extra", "label", "doc_id"])

    schema = T.StructType([T.StructField("m", T.BinaryType()), T.StructField("extra", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    got = rows.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    matrix = np.frombuffer(b"".join(got.column("m").to_pylist()), np.float16).reshape(got.num_rows, TERMS).astype(np.float32)
    return Neighbours(matrix, np.array(got.column("extra").to_pylist()), np.array(got.column("label").to_pylist()))


def with_scores(docs: DataFrame, model: Neighbours | None, name: str = "score") -> DataFrame:
    """``docs`` with the probability-like ``name`` (double) of label 1."""
    spark = docs.sparkSession
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(texts_of(b.column("text"))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
