"""Settings from Spark's configuration, with defaults and range checks (OPS-2, SRC-14), and embedding models (SRC-15)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "spark.sessionloom."

# Known embedding models (name, dimensions, provider, quality).
MODELS = [
    ("mxbai-embed-large", 1024, "ollama", "high"),
    ("nomic-embed-text", 768, "ollama", "medium"),
    ("all-minilm", 384, "ollama", "low"),
    ("snowflake-arctic-embed", 1024, "ollama", "high"),
    ("Xenova/all-MiniLM-L6-v2", 384, "transformers", "low"),
    ("Xenova/all-mpnet-base-v2", 768, "transformers", "medium"),
    ("Xenova/bge-small-en-v1.5", 384, "transformers", "low"),
    ("Xenova/bge-base-en-v1.5", 768, "transformers", "medium"),
    ("text-embedding-3-small", 1536, "openai", "highest"),
    ("text-embedding-3-large", 3072, "openai", "highest"),
    ("text-embedding-ada-002", 1536, "openai", "high"),
]


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 450
    chunk_overlap: float = 0.1
    chunk_strategy: str = "sentence"
    vector_weight: float = 0.7
    rrf_k: int = 60
    expansion: bool = False

    @property
    def fts_weight(self) -> float:
        return 1 - self.vector_weight


def settings(spark: SparkSession) -> Settings:
    """Settings of a session; a value out of range leaves the default."""
    base = Settings()

    def value(name: str, kind, ok):
        raw = spark.conf.get(PREFIX + name, None)
        try:
            v = kind(raw) if raw is not None else None
        except ValueError:
            v = None
        return v if v is not None and ok(v) else getattr(base, name)

    return Settings(
        value("chunk_tokens", int, lambda v: v > 0),
        value("chunk_overlap", float, lambda v: 0 <= v < 1),
        value("chunk_strategy", str, lambda v: v in ("sentence", "sliding_window", "paragraph")),
        value("vector_weight", float, lambda v: 0 <= v <= 1),
        value("rrf_k", int, lambda v: v > 0),
        value("expansion", lambda x: x.lower() == "true", lambda v: True),
    )


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, dimensions int, provider string, quality string")


def model(spark: SparkSession, name: str) -> DataFrame:
    """The model of that name, else the first whose name holds it or is held by it; no row for an empty name."""
    known = spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "at int, name string, dimensions int, provider string, quality string")
    hit = F.lit(bool(name.strip())) & (F.contains(F.lit(name), F.col("name")) | F.contains(F.col("name"), F.lit(name)))
    return known.where(hit).orderBy(F.desc(F.col("name") == name), "at").limit(1).drop("at")


def recommended(spark: SparkSession, provider: str) -> DataFrame:
    """The provider's best model: highest, high, medium, else its first."""
    known = spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "at int, name string, dimensions int, provider string, quality string")
    rank = F.when(F.col("quality") == "highest", 0).when(F.col("quality") == "high", 1).when(F.col("quality") == "medium", 2).otherwise(3)
    return known.where(F.col("provider") == provider).orderBy(rank, "at").limit(1).drop("at")
