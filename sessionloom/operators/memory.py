"""Working memory, tags, quality, hand-off and context (MEM, TAG, QLT, HND, CTX, AGG-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T

# Levels in order.
CONFIDENCE = ["uncertain", "likely", "confirmed", "verified"]
IMPORTANCE = ["low", "normal", "high", "critical"]


def level(c: str, order: list[str]) -> Column:
    """Place of a level in its order, null for others (SRT-5)."""
    out = F.when(F.col(c) == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(F.col(c) == v, i)
    return out


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Last writer wins by key; columns in ``keep`` keep their old value (SNK-2 to SNK-11, MEM-1)."""
    prior = old.select(*keys, *[F.col(k).alias(f"_{k}") for k in keep])
    fresh = new.join(prior, keys, "left").withColumns({k: F.coalesce(F.col(f"_{k}"), F.col(k)) for k in keep}).select(*new.columns)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def fresh(items: DataFrame, now: int) -> DataFrame:
    """Items (project_path, key, value, ttl seconds, ...) as rows of the memory. A TTL of 0 never expires, a negative one already has."""
    return items.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now)).withColumn("expires_at", F.when(F.coalesce("ttl", F.lit(0)) != 0, F.lit(now) + F.col("ttl") * 1000)).drop("ttl")


def remember(memory: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """Upsert items (MEM-1)."""
    return merge(memory, fresh(items, now), ["project_path", "key"])


def recall(memory: DataFrame, now: int, project: str | None = None, key: str | None = None, tags: list[str] | None = None, session: str | None = None) -> DataFrame:
    """Live items by filters, newest first (MEM-2); tags filter before any page is cut."""
    where = P.all_of({"project_path": project, "key": key, "session_id": session}, P.live(now), P.any_tag("tags", tags) if tags else None)
    return memory.where(where).orderBy(F.desc("updated_at"), "key")


def forget(memory: DataFrame, keys: DataFrame) -> DataFrame:
    return memory.join(keys, keys.columns, "left_anti")


def sweep(memory: DataFrame, now: int) -> DataFrame:
    """Without expired items (MEM-4)."""
    return memory.where(P.live(now))


def search_quality(memory: DataFrame, confidence: list[str] | None = None, importance: list[str] | None = None, text: str | None = None, archived: bool = False, pinned: bool | None = None) -> DataFrame:
    """Items by quality, most important first (QLT-2, SRT-5)."""
    parts = [F.col("confidence").isin(confidence) if confidence else None, F.col("importance").isin(importance) if importance else None, P.contains_any(["key", "value", "context"], text) if text else None, None if archived else P.unset("archived"), F.col("pinned") == pinned if pinned is not None else None]
    return memory.where(P.all_of(None, *parts)).orderBy(F.desc_nulls_last(level("importance", IMPORTANCE)), F.desc_nulls_last(level("confidence", CONFIDENCE)), F.desc("updated_at"), "key")


def set_quality(memory: DataFrame, match: Column, now: int, **values) -> DataFrame:
    """Rows that match with new confidence, importance, pinned or archived values (QLT-1); confirmed and verified rows get verified_at."""
    out = memory.withColumns({k: F.when(match, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
    if values.get("confidence") in ("confirmed", "verified"):
        out = out.withColumn("verified_at", F.when(match, F.lit(now)).otherwise(F.col("verified_at")))
    return out.withColumn("updated_at", F.when(match, F.lit(now)).otherwise(F.col("updated_at")))


def memory_stats(memory: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Totals of a memory in one pass (AGG-5)."""
    soon = (F.col("expires_at") > now) & (F.col("expires_at") <= now + days * 86_400_000)
    return memory.agg(
        F.count("*").alias("total"),
        F.count_if(P.unset("archived")).alias("active"),
        F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"),
        F.count_if(F.coalesce("pinned", F.lit(False))).alias("pinned"),
        F.count_if(F.col("expires_at") <= now).alias("expired"),
        F.count_if(soon).alias("expiring_soon"),
    )


def histogram(memory: DataFrame, c: str, order: list[str], default: str) -> DataFrame:
    """Rows of each level, 0 for those without any (AGG-5)."""
    spark = memory.sparkSession
    buckets = spark.createDataFrame([(v,) for v in order], "bucket string")
    got = memory.groupBy(F.coalesce(F.col(c), F.lit(default)).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(got, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stale(items: DataFrame, now: int, days: int, importance_kept: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """Unpinned, unarchived items not touched for ``days``; an unknown importance is left out, as SQL does (FLT-10)."""
    old = F.col("updated_at") < now - days * 86_400_000
    return items.where(old & P.unset("pinned") & P.unset("archived") & ~F.col("importance").isin(*importance_kept)).withColumn("days_stale", T.days_between(now, "updated_at"))


# tags --------------------------------------------------------------------------------------------------------------


def tagged(item_tags: DataFrame, tags: DataFrame, names: list[str], every: bool) -> DataFrame:
    """Items with any or all of the distinct tag names, and the names that match (TAG-2)."""
    names = sorted(set(names))
    hit = item_tags.join(F.broadcast(tags.where(F.col("name").isin(names)).select(F.col("id").alias("tag_id"), "name")), "tag_id")
    g = hit.groupBy("item_type", "item_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("matched"), F.countDistinct("name").alias("n_matched"))
    return g.where(F.col("n_matched") == len(names)) if every else g


def merge_tags(item_tags: DataFrame, sources: list[int], target: int) -> DataFrame:
    """Items of the source tags under the target, once each (SET-6, TAG-3)."""
    moved = item_tags.withColumn("tag_id", F.when(F.col("tag_id").isin(sources), F.lit(target)).otherwise(F.col("tag_id")))
    return moved.groupBy("tag_id", "item_type", "item_id").agg(F.min("created_at").alias("created_at"))


def tag_breakdown(found: DataFrame, matched: str = "matched") -> DataFrame:
    """How many of the found items each tag name is on (AGG-12, TAG-2); ``matched`` holds the names joined by commas."""
    return found.select(F.explode(F.split(matched, ",")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def tag_items(item_tags: DataFrame, items: DataFrame, tags: list[int], now: int) -> DataFrame:
    """``items`` (item_type, item_id) under each of the tags as well; links that exist keep their time (TAG-3)."""
    fresh = items.select("item_type", "item_id").distinct().select(F.explode(F.array(*[F.lit(t).cast("long") for t in tags])).alias("tag_id"), "item_type", "item_id", F.lit(now).cast("long").alias("created_at"))
    return item_tags.select("tag_id", "item_type", "item_id", "created_at").unionByName(fresh).groupBy("tag_id", "item_type", "item_id").agg(F.min("created_at").alias("created_at"))


def untag_items(item_tags: DataFrame, items: DataFrame, tags: list[int] | None = None) -> DataFrame:
    """Without the links of ``items`` to the tags, or to any tag (TAG-3)."""
    gone = items.select("item_type", "item_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & (F.col("tag_id").isin(tags) if tags is not None else F.lit(True))
    return item_tags.join(gone, ["item_type", "item_id"], "left").where(~hit).select(item_tags.columns)


def rename_tag(tags: DataFrame, item_tags: DataFrame, old: str, new: str, now: int, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tags and links after a tag is renamed in a project (None: global tags); if the new name exists there, the old tag's links move to it (TAG-3)."""
    scope = F.col("project_path").isNull() if project is None else F.col("project_path") == project
    ids = {r["name"]: r["id"] for r in tags.where(scope & F.col("name").isin(old, new)).select("id", "name").collect()}
    if old not in ids:
        return tags, item_tags
    if new in ids and new != old:
        return tags.where(F.col("id") != ids[old]), merge_tags(item_tags, [ids[old]], ids[new])
    hit = F.col("id") == ids[old]
    return tags.withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name"))).withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))), item_tags


def delete_tag(tags: DataFrame, item_tags: DataFrame, tag: int, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tags and links without a tag; one that is in use goes only with ``force`` (TAG-3)."""
    used = not item_tags.where(F.col("tag_id") == tag).isEmpty()
    if used and not force:
        raise ValueError(f"tag {tag} is in use")
    return tags.where(F.col("id") != tag), item_tags.where(F.col("tag_id") != tag)


def recall_relevant(memory: DataFrame, query: str, now: int, limit: int = 10, project: str | None = None, session: str | None = None) -> DataFrame:
    """Live items in scope by relevance to a query (MEM-3)."""
    from sessionloom.operators import search

    live = memory.where(P.all_of({"project_path": project, "session_id": session}, P.live(now)))
    said = live.select(F.struct("project_path", "key").alias("id"), F.concat_ws(" ", *[c for c in ("key", "value", "context") if c in memory.columns]).alias("text"))
    best = search.bm25(said, query, limit)
    return live.join(F.broadcast(best.select("id.project_path", "id.key", "score")), ["project_path", "key"]).orderBy(F.desc("score"), "key")


# hand-off and context ----------------------------------------------------------------------------------------------


def active_files(tool_uses: DataFrame, path: Column, last: int = 50, first: int = 20) -> DataFrame:
    """Latest action of each file among the last tool uses (WIN-6)."""
    recent = tool_uses.withColumn("file_path", path).where(F.col("file_path").isNotNull()).orderBy(F.desc("timestamp"), F.desc("id")).limit(last)
    w = Window.partitionBy("file_path").orderBy(F.desc("timestamp"), F.desc("id"))
    one = recent.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.orderBy(F.desc("timestamp"), F.desc("id")).limit(first)


#: Tags that make a memory item a task; an item's status is the first of them that it has, a mere task is pending.
TASK_TAGS = ("blocked", "in_progress", "pending", "task")


def pending_tasks(memory: DataFrame, now: int, project: str | None = None) -> DataFrame:
    """Live items that are tagged as tasks, with their status (HND-1)."""
    has = lambda tag: F.array_contains("tags", tag)
    status = F.when(has("blocked"), "blocked").when(has("in_progress"), "in_progress").otherwise("pending")
    return recall(memory, now, project, tags=list(TASK_TAGS)).withColumn("status", status)


def handoff(decisions: DataFrame, files: DataFrame, tasks: DataFrame, memory: DataFrame, k: int = 20) -> DataFrame:
    """One row with the parts of a hand-off: recent decisions, active files, pending tasks, memory (HND-1)."""

    def pack(df: DataFrame, columns: list[str], by: str) -> DataFrame:
        there = [c for c in columns if c in df.columns]
        return df.orderBy(F.desc(by), columns[0]).limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("o"), *there))).alias("x"))

    d, f = pack(decisions, ["decision_text", "rationale", "context"], "timestamp"), pack(files, ["file_path", "action"], "timestamp")
    t, m = pack(tasks, ["key", "value", "status"], "updated_at"), pack(memory, ["key", "value", "tags"], "updated_at")
    names = ("decisions", "files", "tasks", "memory")
    out = None
    for n, df in zip(names, (d, f, t, m), strict=True):
        one = df.select(F.lit(1).alias("_j"), F.col("x").alias(n))
        out = one if out is None else out.join(one, "_j")
    return out.drop("_j")


def handoff_summary() -> Column:
    """What a hand-off (columns of :func:`handoff`) holds, in a line (HND-1)."""
    told = lambda n, noun, rest=None: F.when(F.size(n) > 0, F.concat(F.size(n).cast("string"), F.lit(noun), *([rest] if rest is not None else [])))
    some = lambda n, sep, text: F.concat(F.lit(": "), F.array_join(F.transform(F.slice(n, 1, 3), text), sep))
    parts = [
        told("decisions", " decision(s)", some("decisions", "; ", lambda e: F.substring(e["decision_text"], 1, 50))),
        told("files", " file(s) active", some("files", ", ", lambda e: F.substring_index(e["file_path"], "/", -1))),
        told("tasks", " pending task(s)"),
        told("memory", " memory item(s)"),
    ]
    line = F.concat_ws(". ", *parts)
    return F.when(line == "", "Empty handoff.").otherwise(F.concat(line, F.lit(".")))


def handoff_row(parts: DataFrame, project: str, session: str, now: int) -> DataFrame:
    """The parts of a hand-off as a row of the table: its id, and its data as JSON with a summary (HND-1)."""
    kept = [F.transform(n, lambda e: e.dropFields("o")).alias(n) for n in ("decisions", "files", "tasks", "memory")]
    data = F.to_json(F.struct(*kept, handoff_summary().alias("summary")))
    key = F.sha2(F.concat_ws("|", F.lit(project), F.lit(session), F.lit(now)), 256)
    unset = F.lit(None)
    return parts.select(key.alias("id"), F.lit(session).alias("from_session_id"), F.lit(project).alias("project_path"), F.lit(now).cast("long").alias("created_at"), data.alias("handoff_data"), unset.cast("string").alias("resumed_by_session_id"), unset.cast("long").alias("resumed_at"))


def list_handoffs(handoffs: DataFrame, project: str | None = None, resumed: bool = False, limit: int = 10) -> DataFrame:
    """Hand-offs of a project with their summaries, the latest first; those that somebody has resumed only if asked for (HND-3)."""
    rows = handoffs.where(P.all_of({"project_path": project}, None if resumed else F.col("resumed_by_session_id").isNull()))
    rows = rows.orderBy(F.desc("created_at"), "id").limit(limit)
    return rows.select("id", "from_session_id", "project_path", "created_at", "resumed_by_session_id", "resumed_at", F.get_json_object("handoff_data", "$.summary").alias("summary"))


def within_budget(items: DataFrame, max_tokens: int, priority: str = "priority", ts: str = "timestamp", tokens: str = "tokens", tie: str = "id") -> DataFrame:
    """Items in order of priority and recency until the first that overflows the budget (WIN-7, CTX-1); items without tokens cost nothing.

    Items that cost something are cut to those that a running sum can reach, the first ``max_tokens``; only they meet in one task. An
    item without tokens stays if no item before it overflows, and gets the sum before it, by a range join with the running sums.
    """
    order = [F.asc(priority), F.desc(ts), F.asc(tie)]
    cost = F.coalesce(F.col(tokens), F.lit(0))
    top = items.where(cost > 0).orderBy(*order).limit(max_tokens + 1)
    run = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = top.withColumn("used", run)
    place = F.struct(F.col(priority).alias("p"), (-F.col(ts)).alias("t"), F.col(tie).alias("i"))
    ends = summed.select(place.alias("at"), "used").agg(F.array_sort(F.collect_list(F.struct("at", "used"))).alias("_ends"))  # max_tokens + 1 rows at most
    free = items.where(cost == 0).crossJoin(F.broadcast(ends)).withColumn("used", F.coalesce(F.array_max(F.transform(F.filter("_ends", lambda e: e["at"] < place), lambda e: e["used"])), F.lit(0))).drop("_ends")
    return summed.unionByName(free).where(F.col("used") <= max_tokens)


def resume(handoffs: DataFrame, project: str, handoff_id: str | None = None) -> DataFrame:
    """The hand-off of an id, or the latest of a project that nobody has resumed (HND-2)."""
    rows = handoffs.where(F.col("id") == handoff_id) if handoff_id else handoffs.where((F.col("project_path") == project) & F.col("resumed_by_session_id").isNull())
    return rows.orderBy(F.desc("created_at"), "id").limit(1)


def mark_resumed(handoffs: DataFrame, taken: DataFrame, session: str, now: int) -> DataFrame:
    """Hand-offs with the taken ones (id) marked as resumed by a session (HND-2)."""
    hit = F.broadcast(taken.select("id", F.lit(True).alias("_hit")))
    out = handoffs.join(hit, "id", "left")
    mark = lambda c, v: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c))
    return out.withColumn("resumed_by_session_id", mark("resumed_by_session_id", session)).withColumn("resumed_at", mark("resumed_at", now)).select(handoffs.columns)


#: Hand-off data that is put back into the working memory.
HANDOFF = "memory array<struct<key:string,value:string,tags:array<string>>>"


def handed_over(taken: DataFrame) -> DataFrame:
    """Memory items of hand-offs (project_path, handoff_data as JSON) (HND-2)."""
    items = taken.select("project_path", F.explode(F.from_json("handoff_data", HANDOFF)["memory"]).alias("m")).select("project_path", "m.key", "m.value", "m.tags", F.lit(0).alias("ttl"))
    return items.where("key is not null").dropDuplicates(["project_path", "key"])


def injected(memory: DataFrame, taken: DataFrame, now: int) -> DataFrame:
    """The working memory with the items of resumed hand-offs (HND-2)."""
    return remember(memory, handed_over(taken), now)
