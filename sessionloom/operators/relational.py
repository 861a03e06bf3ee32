"""Joins, roll-ups, windows and set operations over session entities (JN, AGG, WIN, SRT, SET).

Frames follow :mod:`sessionloom.schemas`. Every function is a lazy composition of DataFrame operations; each
sort before a limit ends in a unique column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as T


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page and, on each row, whether there is a next one (SRT-2). A limit of 0 means the default of 20."""
    limit = limit or 20
    probe = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = Window.orderBy(*order)
    return probe.withColumn("_n", F.row_number().over(n)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in ``order`` (WIN-4, WIN-6, WIN-10)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_by_signature(df: DataFrame, signature: list[Column], order: list[Column]) -> DataFrame:
    """First row of each signature (SET-4)."""
    cols = [f"_s{i}" for i in range(len(signature))]
    return latest(df.withColumns(dict(zip(cols, signature, strict=True))), cols, order).drop(*cols)


def tool_history(uses: DataFrame, results: DataFrame, name: str | None = None, since: int | None = None, until: int | None = None, text: str | None = None, errors_only: bool = False, content_chars: int = 500) -> DataFrame:
    """Tool uses with their results, newest first (JN-7, PRJ-11); filters reach the scan."""
    from sessionloom.functions import predicates as P

    u = uses.where(P.all_of({"tool_name": name}, P.between_ms("timestamp", since, until), P.contains("tool_input", text) if text else None))
    r = results.select("tool_use_id", F.col("id").alias("result_id"), "is_error", T.truncated("content", content_chars).alias("content"))
    j = u.join(r, u["id"] == r["tool_use_id"], "left").drop("tool_use_id")
    return j.where(F.col("is_error")) if errors_only else j


def session_previews(conversations: DataFrame, messages: DataFrame, chars: int = 80) -> DataFrame:
    """Each conversation with its message count and the start of its first message (WIN-3)."""
    first = F.min_by("content", F.struct("timestamp", "id"))
    m = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), T.preview(first, chars).alias("preview"))
    return conversations.join(m, conversations["id"] == m["conversation_id"], "left").drop("conversation_id").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def timeline(*frames: DataFrame) -> DataFrame:
    """Events of all kinds (kind, ref, timestamp, detail), newest first (SET-5, SRT-8)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy(F.desc("timestamp"), "kind", "ref")


def file_changes(edits: DataFrame, limit: int) -> DataFrame:
    """Conversations, last change and their ids by file, most recent first (AGG-4). Ids are gathered for the ``limit`` files only."""
    pairs = edits.groupBy("file_path", "conversation_id").agg(F.max("timestamp").alias("t"))
    top = pairs.groupBy("file_path").agg(F.count("conversation_id").alias("n_conversations"), F.max("t").alias("last_change")).orderBy(F.desc("last_change"), "file_path").limit(limit)
    ids = edits.join(F.broadcast(top.select("file_path")), "file_path", "left_semi").groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_set("conversation_id")), lambda x: x.cast("string")), ",").alias("conversations"))
    return top.join(ids, "file_path").select("file_path", "n_conversations", "last_change", "conversations").orderBy(F.desc("last_change"), "file_path")


def registry_stats(sources: DataFrame) -> DataFrame:
    """Projects, sources by type and summed counters (AGG-2)."""
    return sources.agg(
        F.countDistinct("project_id").alias("projects"),
        F.sum(F.when(F.col("source_type") == "primary", 1).otherwise(0)).alias("primary_sources"),
        F.sum(F.when(F.col("source_type") == "secondary", 1).otherwise(0)).alias("secondary_sources"),
        F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"),
        F.coalesce(F.sum("conversation_count"), F.lit(0)).cast("long").alias("conversations"),
    )


def counts(**frames: DataFrame) -> DataFrame:
    """Rows of each frame by name (AGG-1)."""
    return reduce(lambda a, b: a.unionByName(b), [f.agg(F.lit(n).alias("entity"), F.count("*").alias("n")) for n, f in frames.items()])


def tag_stats(tags: DataFrame, items: DataFrame) -> DataFrame:
    """Uses, last use and item kinds of each tag, unused ones included (AGG-3, JN-9)."""
    t = tags.select(F.col("id").alias("tag_id"), "name")
    kinds = F.array_join(F.sort_array(F.collect_set("item_type")), ",")
    g = items.groupBy("tag_id").agg(F.count("*").alias("usage_count"), F.max("created_at").alias("last_used"), kinds.alias("used_in"))
    return t.join(g, "tag_id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0))).withColumn("used_in", F.coalesce("used_in", F.lit("")))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children without a parent (JN-14), or rows not indexed yet (JN-15)."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def parents_resolved(messages: DataFrame) -> DataFrame:
    """parent_message_id from the parent's external id in the same conversation (JN-16)."""
    p = messages.select("conversation_id", F.col("external_id").alias("parent_external_id"), F.col("id").alias("parent_message_id"))
    return messages.drop("parent_message_id").join(p, ["conversation_id", "parent_external_id"], "left")


def mode(df: DataFrame, value: str, position: str) -> DataFrame:
    """The most frequent value, the one seen first among equals (AGG-11)."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first_seen")).orderBy(F.desc("n"), F.asc("first_seen")).limit(1)


def duplicate_groups(items: DataFrame, id_col: str, value: str, importance: str, created: str) -> DataFrame:
    """Groups of items with one normalised value; the item to keep is the most important, then the newest (AGG-10, WIN-9)."""
    rows = items.select(F.lower(F.trim(F.col(value))).alias("norm"), _rank(id_col, importance, created).alias("r"))
    g = rows.groupBy("norm").agg(F.count("*").alias("n"), F.min("r")["id"].alias("keep_id"))
    return g.where(F.col("n") > 1)


def duplicate_members(items: DataFrame, id_col: str, value: str, importance: str, created: str) -> DataFrame:
    """norm, id, rank of each item of a group of duplicates, 1 for the item to keep (AGG-10)."""
    rows = items.select(F.lower(F.trim(F.col(value))).alias("norm"), _rank(id_col, importance, created).alias("r"))
    w = Window.partitionBy("norm")
    ranked = rows.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("r")))
    return ranked.where("n > 1").select("norm", F.col("r.id").alias("id"), "rank")


def _rank(id_col: str, importance: str, created: str) -> Column:
    level = F.when(F.col(importance) == "critical", 4).when(F.col(importance) == "high", 3).when(F.col(importance) == "normal", 2).otherwise(1)
    return F.struct((-level).alias("a"), (-F.col(created)).alias("b"), F.col(id_col).alias("id"))


def monthly(df: DataFrame, ts: str) -> DataFrame:
    """Events by month (AGG-15)."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def module_of(c) -> Column:
    """Directory of a path (AGG-14)."""
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"^(.*?)/[^/]*$", 1)


def ancestors(c) -> Column:
    """The directories that hold a path, the outermost first; none for a path without one."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, "/")
    above = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.filter(above, lambda p: p != "")


def contained(modules: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of ``files`` with each ``module`` (a directory) that holds them at any depth (JN-20): every path meets its own directories by equality, so no
    path is compared with a module that does not hold it. A path has as many rows as modules hold it."""
    return files.withColumn("module", F.explode(ancestors(path))).join(modules.select("module").distinct(), "module")


def nested_rollup(modules: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files and distinct paths below each module at any depth, 0 for one that holds none (JN-20). Paths are counted before they are exploded."""
    by_path = files.groupBy(path).agg(F.count("*").alias("n"))
    held = contained(modules, by_path, path).groupBy("module").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_paths"))
    return modules.select("module").distinct().join(held, "module", "left").na.fill(0, ["n_rows", "n_paths"])


def module_rollup(files: DataFrame, decisions: DataFrame, mistakes: DataFrame, requirements: DataFrame | None = None, edits: DataFrame | None = None) -> DataFrame:
    """Files, decisions, mistakes, and if given requirements and edits, by directory (AGG-14). Paths are cut to their directory, so the
    joins are on equality; :func:`busiest_first` orders the result."""
    parts = {"n_decisions": decisions, "n_mistakes": mistakes, "n_requirements": requirements, "n_changes": edits}
    out = files.groupBy(module_of("file_path").alias("module")).agg(F.count("*").alias("n_files"))
    for name, df in parts.items():
        if df is not None:
            out = out.join(df.groupBy(module_of("file_path").alias("module")).agg(F.count("*").alias(name)), "module", "left").na.fill(0, [name])
    return out.withColumn("complexity", F.least((F.col("n_decisions") + F.col("n_mistakes")) / F.col("n_files"), F.lit(10.0)))


def busiest_first(modules: DataFrame, limit: int) -> DataFrame:
    """The modules with the most decisions and mistakes."""
    return modules.orderBy(F.desc(F.col("n_decisions") + F.col("n_mistakes")), "module").limit(limit)


def documentation_stats(modules: DataFrame) -> DataFrame:
    """Totals over modules and their mean complexity, to one decimal (AGG-20)."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c.replace("n_", "total_")) for c in ("n_files", "n_decisions", "n_mistakes")]
    return modules.agg(F.count("*").alias("modules"), *totals, F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 1).alias("average_complexity"))


def cross_references(modules: DataFrame, files: DataFrame, decisions: DataFrame, mistakes: DataFrame) -> DataFrame:
    """Modules with a name, a description, and their first decision and mistake (REP-3). decisions, mistakes: file_path, text, timestamp."""
    first = lambda df, name: df.groupBy(module_of("file_path").alias("module")).agg(F.min_by("text", F.struct("timestamp", "text")).alias(name))
    lead = files.groupBy(module_of("file_path").alias("module")).agg(F.min("file_path").alias("first_file"))
    name = F.coalesce(F.regexp_extract("module", r"([^/]+)$", 1), F.lit(""))
    out = modules.join(lead, "module", "left").join(first(decisions, "first_decision"), "module", "left").join(first(mistakes, "first_mistake"), "module", "left")
    about = F.concat(name, F.lit(": "), F.col("n_files").cast("string"), F.lit(" files, "), F.col("n_decisions").cast("string"), F.lit(" decisions, "), F.col("n_mistakes").cast("string"), F.lit(" mistakes"))
    return out.withColumn("name", name).withColumn("description", about)


def mistake_summary(mistakes: DataFrame, lessons: int = 10) -> DataFrame:
    """Mistakes, distinct lessons and the first of them by kind, in order of time (AGG-13)."""
    each = mistakes.where("correction is not null").groupBy("mistake_type", "correction").agg(F.min("timestamp").alias("t"))
    w = Window.partitionBy("mistake_type").orderBy("t", "correction")
    firsts = each.withColumn("_n", F.row_number().over(w))
    said = firsts.groupBy("mistake_type").agg(F.count("*").alias("lessons"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= lessons, F.struct("_n", "correction")))), lambda x: x["correction"]).alias("first_lessons"))
    n = mistakes.groupBy("mistake_type").agg(F.count("*").alias("n"))
    return n.join(said, "mistake_type", "left").withColumn("lessons", F.coalesce("lessons", F.lit(0))).withColumn("first_lessons", F.coalesce("first_lessons", F.array().cast("array<string>")))


def critical_mistakes(mistakes: DataFrame, least: int = 5, limit: int = 10) -> DataFrame:
    """The gravest mistakes of a severity of ``least`` or more (AGG-13)."""
    return mistakes.where(F.col("severity") >= least).orderBy(F.desc("severity"), F.desc("timestamp"), "id").limit(limit)


def with_source(facts: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Facts with project and branch of their conversation and role and time of their message; facts that have lost either are left out (JN-2, JN-3, JN-5)."""
    c = conversations.select(F.col("id").alias("conversation_id"), "project_path", "git_branch")
    m = messages.select(F.col("id").alias("message_id"), F.col("role").alias("message_role"), F.col("timestamp").alias("message_timestamp"))
    return facts.join(c, "conversation_id").join(m, "message_id")


def commits_with_talk(commits: DataFrame, conversations: DataFrame, messages: DataFrame, project: str | None = None) -> DataFrame:
    """Commits with the conversation they are linked to and its first message; unlinked ones stay unless a project is asked for (JN-6)."""
    c = conversations.select(F.col("id").alias("conversation_id"), "project_path", F.col("first_message_at").alias("conversation_start"))
    m = messages.groupBy("conversation_id").agg(F.min_by("content", F.struct("timestamp", "id")).alias("first_message"))
    out = commits.join(c, "conversation_id", "left").join(m, "conversation_id", "left")
    return out if project is None else out.where(F.col("project_path") == project)


def project_ids(paths: DataFrame, projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each path with its project: by canonical path, else by alias, else a new one whose id is the path's hash (SNK-1, JN-19).

    projects: id, canonical_path; aliases: alias_path, project_id.
    """
    p = projects.select(F.col("canonical_path").alias("project_path"), F.col("id").alias("_own"))
    a = aliases.groupBy(F.col("alias_path").alias("project_path")).agg(F.min("project_id").alias("_alias"))
    found = paths.join(p, "project_path", "left").join(a, "project_path", "left")
    how = F.when(F.col("_own").isNotNull(), "canonical").when(F.col("_alias").isNotNull(), "alias").otherwise("new")
    return found.withColumn("project_id", F.coalesce("_own", "_alias", F.sha2("project_path", 256))).withColumn("found_by", how).drop("_own", "_alias")


def health(checks: DataFrame) -> DataFrame:
    """Score of (check, status) rows (AGG-16)."""
    n = checks.agg(F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"))
    score = F.when(F.col("failed") > 0, F.greatest(F.lit(0), 50 - 25 * F.col("failed"))).when(F.col("warned") > 1, F.greatest(F.lit(50), 100 - 15 * F.col("warned"))).otherwise(100 - 10 * F.col("warned"))
    return n.withColumn("score", score)


def link_commits(commits: DataFrame, conversations: DataFrame, hour_ms: int = 3_600_000, five_ms: int = 300_000, least: float = 0.3) -> DataFrame:
    """Best conversation of each commit (JN-17, WIN-10).

    commits: commit_id, timestamp, files, branch, message. conversations: conv_id, first_at, last_at, files, branch, keywords.
    A link needs more than 0.3 of 1, which time or a shared file must give. Near in time: an equi-join on the hours that a
    conversation (and an hour around it) touches. Away from it a conversation counts by files, branch and keywords only, so those that
    have the same ones are one class, for which the first in order stands; shared files are summed by commit and class. Scores
    are computed where rows meet and reduced to the best by partial aggregation: no pair is joined back to its rows.
    """
    branch = F.when(F.col("c_branch") == F.col("branch"), 1.0).otherwise(0.0)
    words = F.size(F.filter("keywords", lambda k: F.lower(F.col("message")).contains(F.lower(k))))
    score = lambda time, files: (time + files + branch + 2.0 * F.least(words, F.lit(3)) / 3) / 10
    c = commits.withColumnsRenamed({"files": "c_files", "branch": "c_branch"})
    hours = F.explode(F.sequence(F.floor((F.col("first_at") - hour_ms) / hour_ms), F.floor((F.col("last_at") + hour_ms) / hour_ms)))
    near = c.withColumn("h", F.floor(F.col("timestamp") / hour_ms)).join(conversations.withColumn("h", hours), "h")
    gap = F.least(F.abs(F.col("timestamp") - F.col("first_at")), F.abs(F.col("timestamp") - F.col("last_at")))
    time = F.when((F.col("timestamp") >= F.col("first_at")) & (F.col("timestamp") <= F.col("last_at")), 3.0).when(gap < five_ms, 2.0).when(gap < hour_ms, 1.0).otherwise(0.0)
    both = F.size(F.array_intersect("c_files", "files"))
    share = F.when((F.size("c_files") > 0) & (F.size("files") > 0), 4.0 * both / F.greatest(F.size("c_files"), F.size("files"))).otherwise(0.0)
    by_time = near.select("commit_id", "conv_id", score(time, share).alias("confidence"))
    classes = conversations.where(F.size("files") > 0).groupBy("files", "branch", "keywords").agg(F.min("conv_id").alias("conv_id"))
    asked = c.select("commit_id", "c_branch", "message", F.size("c_files").alias("c_size"), F.explode(F.array_distinct("c_files")).alias("f"))
    held = classes.select("conv_id", "branch", "keywords", F.size("files").alias("size"), F.explode(F.array_distinct("files")).alias("f"))
    met = asked.join(held, "f").select("commit_id", "conv_id", branch.alias("b"), words.alias("w"), F.greatest("c_size", "size").alias("most"))
    summed = met.groupBy("commit_id", "conv_id", "b", "w", "most").agg(F.count("*").alias("n"))
    by_file = summed.select("commit_id", "conv_id", ((F.lit(0.0) + 4.0 * F.col("n") / F.col("most") + F.col("b") + 2.0 * F.least(F.col("w"), F.lit(3)) / 3) / 10).alias("confidence"))
    best = by_time.unionByName(by_file).where(F.col("confidence") > least).groupBy("commit_id").agg(F.min(F.struct((-F.col("confidence")).alias("below"), F.col("conv_id").alias("id"))).alias("best"))
    return best.select("commit_id", F.col("best.id").alias("conv_id"), (-F.col("best.below")).alias("confidence"))
