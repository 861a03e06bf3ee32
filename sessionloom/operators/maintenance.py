"""Upkeep of the stores: statistics, orphans, topics to forget, health (AGG-6, JN-14, SET-3, AGG-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T

from . import relational as R
from . import search as S


def storage_stats(**frames: DataFrame) -> DataFrame:
    """Rows, first creation, last update, and bytes of the files of each table (AGG-6)."""
    out = None
    for name, df in frames.items():
        lo = F.min("created_at") if "created_at" in df.columns else F.lit(None).cast("long")
        hi = F.max("updated_at") if "updated_at" in df.columns else F.lit(None).cast("long")
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), lo.alias("oldest"), hi.alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


def advice(stats: DataFrame, large: int = 100 << 20, many: int = 10_000) -> DataFrame:
    """What to do about tables (table, n, bytes) that have grown large (AGG-6)."""
    size = F.when(F.col("bytes") > large, F.concat(F.col("table"), F.lit(" takes "), T.human_bytes("bytes"), F.lit(": clean up stale rows and compact it")))
    count = F.when((F.col("table") == "embeddings") & (F.col("n") > many), F.lit("many embeddings: clean up those without a message"))
    return stats.select(F.explode(F.array_compact(F.array(size, count))).alias("advice"))


def about(messages: DataFrame, topic: str) -> DataFrame:
    """Distinct conversations that a topic's words occur in (SET-3)."""
    return messages.where(S.match_any("content", topic)).select("conversation_id").distinct()


def orphan_counts(tags: DataFrame, item_tags: DataFrame, embeddings: DataFrame, messages: DataFrame) -> DataFrame:
    """Tags without items and embeddings without a message (cleanup_orphans, preview)."""
    unused = R.orphans(tags.withColumnRenamed("id", "tag_id"), item_tags, "tag_id", "tag_id")
    lost = R.orphans(embeddings, messages, "message_id")
    return R.counts(unused_tags=unused, lost_embeddings=lost)


def merge_duplicates(items: DataFrame, item_tags: DataFrame, keep_id, merge_ids: list, kind: str, value: str = "value", strategy: str = "keep_content") -> tuple[DataFrame, DataFrame]:
    """Items and tag links after items are merged into one: their links move to it, and with ``merge_content`` their other texts are added to its own (merge_duplicates)."""
    ids = [i for i in merge_ids if i != keep_id]
    kept = items.where(~F.col("id").isin(ids))
    if strategy == "merge_content":
        texts = items.where(F.col("id").isin([keep_id, *ids])).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((F.col("id") != keep_id).alias("o"), "id", F.col(value).alias("v")))), lambda x: x["v"])), "\n").alias("_all"))
        kept = kept.crossJoin(F.broadcast(texts)).withColumn(value, F.when(F.col("id") == keep_id, F.col("_all")).otherwise(F.col(value))).drop("_all")
    moved = item_tags.withColumn("item_id", F.when((F.col("item_type") == kind) & F.col("item_id").isin(ids), F.lit(keep_id)).otherwise(F.col("item_id")))
    return kept, moved.groupBy("tag_id", "item_type", "item_id").agg(F.min("created_at").alias("created_at"))


def cleanup_stale(items: DataFrame, now: int, days: int = 90, action: str = "preview", most: int = 100, keep_pinned: bool = True, keep_important: bool = True) -> DataFrame:
    """Items not touched for ``days``, the oldest ``most``: listed, or all items with them archived or deleted (cleanup_stale)."""
    from . import memory as M

    base = items if keep_pinned else items.withColumn("pinned", F.lit(False))
    found = M.stale(base, now, days, ("critical", "high") if keep_important else ("",)).orderBy("updated_at", "id").limit(most)
    if action == "preview":
        return found
    hit = items.join(F.broadcast(found.select("id", F.lit(True).alias("_hit"))), "id", "left")
    if action == "delete":
        return hit.where("_hit is null").select(items.columns)
    return hit.withColumn("archived", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("archived"))).select(items.columns)


def log_row(spark, task: str, now: int, rows: int, detail: str = "") -> DataFrame:
    """One row of the maintenance history (run_maintenance, get_maintenance_history)."""
    return spark.createDataFrame([(f"{now}-{task}", task, now, rows, detail)], "id string, task string, at long, rows long, detail string")


def expired(memory: DataFrame, now: int) -> DataFrame:
    return memory.where(~P.live(now))
