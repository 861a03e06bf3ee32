"""Query tools that put the other operators together (TOOL rows, TAG-1, EXT-G2, SNK-13 preview, discovery of old projects)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T
from sessionloom.operators import relational as R
from sessionloom.operators import search as S
from sessionloom.operators.extract import facts as X


def latest_session(conversations: DataFrame, project: str | None = None, source: str | None = None) -> DataFrame:
    """The conversation with the latest message (WIN-4)."""
    return conversations.where(P.all_of({"project_path": project, "source_type": source})).orderBy(F.desc("last_message_at"), F.asc("id")).limit(1)


def session_summary(session: DataFrame, messages: DataFrame, uses: DataFrame, results: DataFrame, last: int = 20, chars: int = 280) -> DataFrame:
    """(part, rank, text) of the latest session: three messages a role, five tools by use, five errors (WIN-4)."""
    recent = messages.join(F.broadcast(session.select(F.col("id").alias("conversation_id"))), "conversation_id", "left_semi").orderBy(F.desc("timestamp"), F.desc("id")).limit(last)
    talk = recent.where("content is not null and role in ('user', 'assistant')")
    said = talk.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("timestamp"), F.desc("id")))).where("rank <= 3").select(F.col("role").alias("part"), "rank", T.preview("content", chars).alias("text"))
    own = uses.join(recent.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    tools = own.groupBy("tool_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_name").limit(5)
    tools = tools.select(F.lit("tool").alias("part"), F.row_number().over(Window.orderBy(F.desc("n"), "tool_name")).alias("rank"), F.concat("tool_name", F.lit(" x "), F.col("n").cast("string")).alias("text"))
    bad = results.where("is_error").join(own.select(F.col("id").alias("tool_use_id"), F.col("timestamp").alias("_t")), "tool_use_id").orderBy(F.desc("_t"), F.desc("id")).limit(5)
    errors = bad.select(F.lit("error").alias("part"), F.row_number().over(Window.orderBy(F.desc("_t"), F.desc("id"))).alias("rank"), T.preview("content", chars).alias("text"))
    return said.unionByName(tools).unionByName(errors)


def about_file(path: str, k: int, decisions: DataFrame, mistakes: DataFrame, messages: DataFrame) -> DataFrame:
    """The latest decisions, mistakes and messages that mention a path, ``k`` of each (search_by_file, check_before_modify)."""
    part = lambda df, kind, text: df.where(P.contains(text, path)).orderBy(F.desc("timestamp"), F.asc("id")).limit(k).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "timestamp", F.col(text).alias("text"))
    return part(decisions, "decision", "decision_text").unionByName(part(mistakes, "mistake", "what_went_wrong")).unionByName(part(messages, "message", "content"))


def list_tags(tags: DataFrame, items: DataFrame, project: str | None = None, scope: str = "all", sort: str = "usage_count", unused: bool = True) -> DataFrame:
    """Tags with use, by scope (project, global, all) and order (usage_count, name, last_used) (TAG-1)."""
    own = tags.where(F.col("project_path") == project) if scope == "project" else tags.where("project_path is null") if scope == "global" else tags
    stats = R.tag_stats(own, items)
    stats = stats if unused else stats.where("usage_count > 0")
    return stats.orderBy(*{"name": [F.asc("name")], "last_used": [F.desc_nulls_last("last_used"), F.asc("name")]}.get(sort, [F.desc("usage_count"), F.asc("name")]))


def facts_matching(facts: DataFrame, text: str | None, columns: list[str], order: str, limit: int, *where: Column) -> DataFrame:
    """Facts by phrase prefix over ``columns``; without a match the phrase is dropped and the latest come (get_methodologies and the like)."""
    base = facts.where(P.all_of(None, *where))
    rows = base
    if text:
        joined = F.concat_ws(" ", *columns)
        rows = S.first_nonempty(base.where(S.match_phrase_prefix(joined, text)), base)
    return rows.orderBy(F.desc(order), F.asc("id")).limit(limit)


def per_source(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits by source type, zero where there are none (search_all_conversations)."""
    n = hits.groupBy("source_type").agg(F.count("*").alias("n"))
    return sources.select("source_type").distinct().join(n, "source_type", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hits_page(hits: DataFrame, conversations: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, source: str | None = None) -> DataFrame:
    """A page of the hits (conversation_id and more) of all projects: project, branch and source type of each, how many hits its source has, and whether there is a next page (search_all_conversations, get_all_decisions, search_all_mistakes).

    The source filter comes before the page is cut and before hits are counted.
    """
    own = conversations.where(P.all_of({"source_type": source}))
    told = [c for c in ("project_path", "git_branch", "source_type") if c not in hits.columns]
    all_of = hits.join(own.select(F.col("id").alias("conversation_id"), *told), "conversation_id")
    n = all_of.groupBy("source_type").agg(F.count("*").alias("n_in_source")).withColumnRenamed("source_type", "_s")
    page = R.page(all_of, order, limit, offset)
    return page.join(n, page["source_type"].eqNullSafe(n["_s"])).drop("_s").orderBy(*order)


def before_change(k: int, edits: DataFrame, commits: DataFrame | None, decisions: DataFrame, mistakes: DataFrame, path: str) -> DataFrame:
    """(kind, ref, timestamp, detail): the latest ``k`` edits and commits of a file, decisions and mistakes that name it (check_before_modify)."""

    def part(df: DataFrame, kind: str, ref: str, text: str, where: Column) -> DataFrame:
        return df.where(where).orderBy(F.desc("timestamp"), ref).limit(k).select(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), "timestamp", F.col(text).alias("detail"))

    parts = [
        part(edits, "edit", "id", "file_path", F.lower("file_path") == path.lower()),
        part(decisions, "decision", "id", "decision_text", P.contains_any(["decision_text", "rationale"], path)),
        part(mistakes, "mistake", "id", "what_went_wrong", P.contains_any(["what_went_wrong", "correction"], path)),
    ]
    if commits is not None:
        touched = F.exists("files_changed", lambda f: (F.length(f) > 0) & F.lit(path.lower()).endswith(F.lower(f)))
        parts.append(part(commits, "commit", "hash", "message", touched))
    return R.timeline(*parts)


def old_projects(folders: DataFrame, current: str, least: float = 50.0) -> DataFrame:
    """Folders (path, folder, has_db, n_files) that may be an older place of ``current``, best first (discover_old_conversations)."""
    here, name = F.lit(current), F.lit(current.replace("/", "-"))
    score = T.path_likeness(here, F.col("path"))
    parts = lambda c: F.regexp_replace(c, "-", "/")
    rows = folders.withColumn("path_score", score).withColumn("folder_score", T.path_likeness(parts(name), parts(F.col("folder"))))
    return rows.withColumn("score", T.migration_score("path_score", "folder_score", "has_db", "n_files")).where(F.col("score") >= least).orderBy(F.desc("score"), "path")


def methodologies(messages: DataFrame, uses: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """Segments with problem, approach, tools, files, the first ``most`` steps in order, what failed, what worked and the outcome (EXT-G2)."""
    key = ["conversation_id", "segment"]
    at = X.in_segments(messages.select("conversation_id", "message_id", "role", "content", "timestamp"))
    order = F.struct("timestamp", "message_id")
    rows = F.array_sort(F.collect_list(F.struct("timestamp", "message_id", "content")))
    text = lambda a: F.array_join(F.transform(a, lambda r: r["content"]), "\n")
    g = at.groupBy(*key).agg(F.count("*").cast("int").alias("n_messages"), F.min(order)["message_id"].alias("start_message_id"), F.max(order)["message_id"].alias("end_message_id"), text(rows).alias("_all"), text(F.slice(rows, F.greatest(F.size(rows) - 2, F.lit(1)), F.lit(3))).alias("_end"), F.min_by("content", F.when(F.col("role") == "user", order)).alias("_first"), F.max_by("content", F.when(F.col("good"), order)).alias("_good"))
    g = g.where("n_messages >= 2")
    r = results.groupBy("tool_use_id").agg(F.max("is_error").alias("is_error"))
    steps = uses.join(r, uses["id"] == r["tool_use_id"], "left").drop("tool_use_id").join(at.select("message_id", *key), "message_id")
    steps = steps.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("timestamp", "id")))
    named = lambda c: F.transform(F.array_sort(F.collect_list(F.when((F.col("_n") <= most) & c, F.struct("_n", "tool_name")))), lambda x: x["tool_name"])
    used = steps.groupBy(*key).agg(F.array_sort(F.collect_set("tool_name")).alias("tools_used"), F.count("*").alias("n_steps"), F.count_if("is_error").alias("n_failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_n") <= most, T.paths_in("tool_input")))))).alias("files_involved"), named(F.lit(True)).alias("steps"), named(F.coalesce("is_error", F.lit(False))).alias("what_failed"))
    out = g.join(used, key, "left")
    none = F.array().cast("array<string>")
    empty = [F.coalesce(c, none).alias(c) for c in ("tools_used", "files_involved", "steps", "what_failed")]
    out = out.select("conversation_id", "start_message_id", "end_message_id", "n_messages", X.problem_of("_first").alias("problem_statement"), X.approach("_all").alias("approach"), X.outcome("_end").alias("outcome"), *empty, F.substring("_good", 1, 300).alias("what_worked"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
    return out.where("problem_statement is not null")
