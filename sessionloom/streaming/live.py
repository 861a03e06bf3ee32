"""Live session logs with Structured Streaming (STR-1 to STR-7, SRC-16).

New log files are a file stream; records go through the live extraction rules in each micro-batch and are
merged into the working memory by key, so a replayed batch changes nothing. A writer that appends to one file
rotates it into new files, as a file stream reads each file once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionloom.operators.extract import facts
from sessionloom.sources.store import Tables

RECORD = "type string, role string, content string, timestamp long, name string, input struct<file_path: string, command: string>, tool_use_id string, is_error boolean, session_id string"
DAY = 86_400
#: Seconds that live facts are remembered (STR-4).
TTL = {"decision": 7 * DAY, "file": DAY, "error": 3 * DAY}


def records(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Live records of new ``*.jsonl`` files; broken lines are left out."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return lines.select(F.from_json("value", RECORD).alias("r"), F.xxhash64("value").alias("message_id")).where("r.type is not null").select("message_id", "r.*")


def live_facts(batch: DataFrame) -> DataFrame:
    """(key, value, ttl, kind) of one batch."""
    talk = batch.where("type = 'message' and content is not null")
    d = facts.live_decisions(talk).select(F.concat(F.lit("decision_"), F.xxhash64(F.lower("text")).cast("string")).alias("key"), F.col("text").alias("value"), F.lit("decision").alias("kind"))
    ops = facts.live_file_ops(batch.where("type = 'tool_use'").select(F.col("message_id").alias("id"), "name", "input.file_path", "input.command"))
    f = ops.select(F.concat(F.lit("file_"), F.regexp_replace("path", "[^a-zA-Z0-9]", "_")).alias("key"), F.concat("action", F.lit(" "), "path").alias("value"), F.lit("file").alias("kind"))
    errors = batch.where("is_error or type = 'message'").select(F.explode(facts.live_errors("content")).alias("value"))
    e = errors.select(F.concat(F.lit("error_"), F.xxhash64("value").cast("string")).alias("key"), "value", F.lit("error").alias("kind"))
    rows = d.unionByName(f).unionByName(e).dropDuplicates(["key"])
    ttl = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in TTL.items()])
    return rows.withColumn("ttl", ttl)


def batch_metrics(batch: DataFrame, number: int, now: int) -> DataFrame:
    """One row of what a micro-batch held: messages, tool calls, errors, and facts by kind (STR-5)."""
    n = batch.agg(F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("type") == "tool_use").alias("tool_uses"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("failed"))
    kinds = live_facts(batch).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in TTL])
    return n.crossJoin(F.broadcast(kinds)).select(F.lit(number).cast("long").alias("batch"), F.lit(now).alias("at"), "*")


def remember_live(spark: SparkSession, folder: str, store: str, checkpoint: str, project: str, now: int | Callable[[], int] | None = None, once: bool = True) -> StreamingQuery:
    """Run the stream into the table working_memory of ``store``. Facts are dated by ``now``: a fixed time, or a clock that each batch reads (that of the machine, unless another is given)."""
    clock = now if callable(now) else (lambda: int(time.time() * 1000)) if now is None else (lambda: now)

    def sink(batch: DataFrame, number: int) -> None:
        now = clock()
        rows = live_facts(batch)
        fresh = rows.select(F.lit(project).alias("project_path"), "key", "value", F.array("kind").alias("tags"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), (F.lit(now) + F.col("ttl") * 1000).cast("long").alias("expires_at"))
        tables = Tables(spark, store)
        tables.upsert("working_memory", fresh)
        tables.upsert("live_metrics", batch_metrics(batch, number, now), ["batch"])

    q = records(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="1 second")).start()


def rested(changes: DataFrame, key: str = "path", quiet_ms: int = 1_000, cooldown_ms: int = 0) -> DataFrame:
    """Keys (files) of a stream of changes that have rested: (key, changes), once for each burst, ``quiet_ms`` after its last change (STR-2, STR-6).

    Each key has a timer of its own, which every change sets anew, in the state store: it survives a restart. With ``cooldown_ms`` a key that was
    given out is not given out again before that time is over; what changes meanwhile waits for it.
    """

    def wait(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        seen, given = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            if seen:
                yield pd.DataFrame({key: [name[0]], "changes": [seen]})
            if seen and cooldown_ms:
                state.update((0, now))
                state.setTimeoutDuration(cooldown_ms)
            else:
                state.remove()
            return
        seen += sum(len(b) for b in batches)
        state.update((seen, given))
        state.setTimeoutDuration(max(quiet_ms, given + cooldown_ms - now if given else 0))

    return changes.groupBy(key).applyInPandasWithState(wait, f"{key} string, changes long", "seen long, given long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, for batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
