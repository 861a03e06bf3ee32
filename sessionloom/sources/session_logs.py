"""Session logs in two JSONL dialects to entity frames (SRC-1 to SRC-9, PRJ-1 to PRJ-9).

A log is read whole, one row a file, and exploded with line numbers, which order everything else; a file is one
session, so a row is bounded by a session's size. ``content`` may be a string or an array of blocks: it is
parsed to its JSON text and told apart by whether it has elements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = """type string, uuid string, parentUuid string, sessionId string, timestamp string, isSidechain boolean, agentId string, requestId string,
 cwd string, version string, gitBranch string, message struct<role: string, content: string>, toolUseResult struct<stdout: string, stderr: string, isImage: boolean>,
 messageId string, snapshot struct<timestamp: string, trackedFileBackups: map<string, struct<version: bigint, backupTime: string>>>, summary string, content string"""
BLOCKS = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean, thinking: string, signature: string>>"
ROLLOUT = "timestamp string, type string, payload struct<id: string, timestamp: string, cwd: string, originator: string, cli_version: string, model_provider: string, git: struct<branch: string, commit_hash: string, repository_url: string>, role: string, content: string, parent_message_id: string>"


def folder_name(path: str) -> str:
    """Folder of a project's logs: separators become hyphens (SRC-9)."""
    return re.sub(r"[/\\.]", "-", path.replace(":", ""))


def folder_variants(path: str) -> list[str]:
    """Folder names that older writers may have used, most recent first (SRC-8)."""
    base = path.replace(":", "")
    out = [folder_name(path), re.sub(r"[/\\]", "-", base), re.sub(r"[/\\._]", "-", base)]
    return list(dict.fromkeys(out + [v.lstrip("-") for v in out]))


def read_lines(spark: SparkSession, paths: list[str], glob: str = "*.jsonl", since_ms: int | None = None, recursive: bool = False) -> DataFrame:
    """file, file_name, line_no, line of logs changed at or after ``since_ms`` (SRC-1, SRC-5); of files with one name in several folders the first folder's counts."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(paths, wholetext=True)
    meta = F.col("_metadata")
    rows = raw.select(meta["file_path"].alias("file"), meta["file_name"].alias("file_name"), F.unix_millis(meta["file_modification_time"]).alias("modified"), "value")
    if since_ms is not None:
        rows = rows.where(F.col("modified") >= since_ms)
    if len(paths) > 1:
        order = F.coalesce(*[F.when(F.contains(F.col("file"), F.lit(p.rstrip("/") + "/")), F.lit(i)) for i, p in enumerate(paths)], F.lit(len(paths)))
        w = Window.partitionBy("file_name").orderBy(order, "file")
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.select("file", "file_name", F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line")).where(F.trim("line") != "")


def epoch_ms(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(F.try_to_timestamp(col))


def hashed(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _blocks(content: Column) -> Column:
    """Content blocks; null when the content is plain text."""
    return F.when(F.get_json_object(F.concat(F.lit('{"c":'), content, F.lit("}")), "$.c[0]").isNotNull(), F.from_json(content, BLOCKS))


def _text(content: Column, blocks: Column) -> Column:
    """Plain content, or the text blocks joined by line breaks (PRJ-4)."""
    return F.when(blocks.isNull(), content).otherwise(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))


def _entities(m: DataFrame) -> dict[str, DataFrame]:
    """Tool uses, tool results and thinking blocks of messages with ``blocks`` (PRJ-5, PRJ-7)."""
    b = m.select("message_key", "file", "ms", "stdout", "stderr", "is_image", F.posexplode("blocks").alias("at", "b"))
    uses = b.where("b.type = 'tool_use' and b.id is not null").select(hashed("message_key", "b.id").alias("id"), F.col("message_key").alias("message_id"), F.col("b.id").alias("external_id"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), F.col("ms").alias("timestamp"), "file")
    results = b.where("b.type = 'tool_result'").select(hashed("message_key", F.col("b.tool_use_id"), F.lit("result")).alias("id"), F.col("b.tool_use_id").alias("external_id"), F.col("message_key").alias("message_id"), F.col("b.content").alias("content"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), "stdout", "stderr", F.coalesce("is_image", F.lit(False)).alias("is_image"), F.col("ms").alias("timestamp"), "file")
    known = uses.select("file", "external_id", F.col("id").alias("tool_use_id")).dropDuplicates(["file", "external_id"])
    thinking = b.where("b.type = 'thinking'").select(hashed("message_key", F.col("at").cast("string"), F.lit("thinking")).alias("id"), F.col("message_key").alias("message_id"), F.col("b.thinking").alias("thinking_content"), F.col("b.signature").alias("signature"), F.col("ms").alias("timestamp"))
    return {"tool_uses": uses.drop("file"), "tool_results": results.join(known, ["file", "external_id"]).drop("file", "external_id"), "thinking_blocks": thinking}


def parse(lines: DataFrame, project: str, now: int) -> dict[str, DataFrame]:
    """Entity frames of dialect A: conversations, messages, tool_uses, tool_results, file_edits, thinking_blocks, parse_errors (SRC-4, PRJ-1 to PRJ-7)."""
    r = lines.withColumn("r", F.from_json("line", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.try_parse_json("line").isNotNull()
    errors = r.where(~good).select("file", "line_no", F.lit("not JSON").alias("error"))
    ok = r.where(good).select("file", "line_no", "r.*").withColumn("ms", epoch_ms("timestamp"))
    talk = F.col("type").isin("user", "assistant")
    conversations = ok.groupBy("file").agg(
        F.min_by("sessionId", F.when(F.col("sessionId").isNotNull(), F.col("line_no"))).alias("external_id"),
        F.min("ms").alias("first_message_at"),
        F.max("ms").alias("last_message_at"),
        F.count_if(talk).alias("message_count"),
        F.count("*").alias("total_messages"),
        F.max_by("gitBranch", F.when(F.coalesce(F.col("gitBranch"), F.lit("")) != "", F.col("line_no"))).alias("git_branch"),
        F.max_by("version", F.when(F.coalesce(F.col("version"), F.lit("")) != "", F.col("line_no"))).alias("version"),
    ).where("external_id is not null")
    conversations = conversations.select(hashed(F.lit(project), "external_id").alias("id"), F.lit(project).alias("project_path"), F.lit("primary").alias("source_type"), *conversations.columns[1:], F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    body = F.when(F.col("type") == "system", F.col("content")).when(F.col("type") == "summary", F.col("summary")).otherwise(F.col("message.content"))
    m = ok.where("uuid is not null and sessionId is not null").withColumn("body", body).withColumn("blocks", _blocks(F.col("body")))
    m = m.withColumns({"message_key": hashed(F.lit(project), "sessionId", "uuid"), "ms": F.coalesce("ms", F.lit(now)), "stdout": F.col("toolUseResult.stdout"), "stderr": F.col("toolUseResult.stderr"), "is_image": F.col("toolUseResult.isImage")})
    messages = m.select(F.col("message_key").alias("id"), hashed(F.lit(project), "sessionId").alias("conversation_id"), F.col("uuid").alias("external_id"), F.col("parentUuid").alias("parent_external_id"), F.col("type").alias("message_type"), F.col("message.role").alias("role"), _text(F.col("body"), F.col("blocks")).alias("content"), F.col("ms").alias("timestamp"), F.coalesce("isSidechain", F.lit(False)).alias("is_sidechain"), F.col("agentId").alias("agent_id"), F.col("requestId").alias("request_id"), F.col("gitBranch").alias("git_branch"), "cwd")
    session = ok.groupBy("file").agg(F.min_by("sessionId", F.when(F.col("sessionId").isNotNull(), F.col("line_no"))).alias("_session"))
    snaps = ok.where("type = 'file-history-snapshot' and messageId is not null").join(session, "file")
    edits = snaps.select(hashed(F.lit(project), "_session", "messageId").alias("message_id"), hashed(F.lit(project), "_session").alias("conversation_id"), epoch_ms("snapshot.timestamp").alias("snapshot_timestamp"), F.explode("snapshot.trackedFileBackups").alias("file_path", "v"))
    edits = edits.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi").select(hashed("message_id", "file_path").alias("id"), "conversation_id", "file_path", "message_id", F.col("v.version").alias("backup_version"), epoch_ms("v.backupTime").alias("backup_time"), "snapshot_timestamp")
    return {"conversations": conversations, "messages": messages, **_entities(m), "file_edits": edits, "parse_errors": errors}


def parse_rollouts(lines: DataFrame, now: int) -> dict[str, DataFrame]:
    """Entity frames of dialect B (SRC-6, SRC-7): a file without session_meta gives nothing."""
    ok = lines.where(F.try_parse_json("line").isNotNull()).withColumn("r", F.from_json("line", ROLLOUT)).select("file", "file_name", "line_no", "r.*")
    ok = ok.withColumn("ms", F.coalesce(epoch_ms("timestamp"), F.lit(now)))
    meta = ok.where("type = 'session_meta'")
    named = F.regexp_extract("file_name", r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1)
    head = meta.groupBy("file").agg(F.min_by("payload", "line_no").alias("p"), F.min_by("file_name", "line_no").alias("file_name"))
    cwd = ok.groupBy("file").agg(F.min_by("payload.cwd", F.when(F.col("payload.cwd").isNotNull(), F.col("line_no"))).alias("cwd"))
    key = F.coalesce(F.col("p.id"), F.when(named != "", named), F.col("file_name"))
    sessions = head.join(cwd, "file").select("file", key.alias("external_id"), "cwd", F.col("p.git.branch").alias("git_branch"), F.col("p.cli_version").alias("version"))
    items = ok.where("type = 'response_item' and payload.role is not null").join(sessions.select("file", "external_id", F.col("cwd").alias("_cwd"), "git_branch"), "file")
    items = items.withColumn("blocks", _blocks(F.col("payload.content"))).withColumn("message_key", hashed("external_id", F.coalesce("payload.id", F.col("line_no").cast("string"))))
    items = items.withColumns({"stdout": F.lit(None).cast("string"), "stderr": F.lit(None).cast("string"), "is_image": F.lit(False)})
    messages = items.select(F.col("message_key").alias("id"), hashed("external_id").alias("conversation_id"), F.coalesce("payload.id", F.col("line_no").cast("string")).alias("external_id"), F.col("payload.parent_message_id").alias("parent_external_id"), F.col("payload.role").alias("message_type"), F.col("payload.role").alias("role"), _text(F.col("payload.content"), F.col("blocks")).alias("content"), F.col("ms").alias("timestamp"), F.lit(False).alias("is_sidechain"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("request_id"), "git_branch", F.col("_cwd").alias("cwd"))
    stats = items.groupBy("file").agg(F.min("ms").alias("first_message_at"), F.max("ms").alias("last_message_at"), F.count("*").alias("message_count"))
    conversations = sessions.join(stats, "file", "left").select(hashed("external_id").alias("id"), F.col("cwd").alias("project_path"), F.lit("secondary").alias("source_type"), "external_id", "first_message_at", "last_message_at", F.coalesce("message_count", F.lit(0)).alias("message_count"), "git_branch", "version", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return {"conversations": conversations, "messages": messages, **_entities(items)}


def merge_parsed(*results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames of several scans, the first row of an id kept (SRC-2)."""
    out = {}
    for name in results[0]:
        frames = [r[name].withColumn("_o", F.lit(i)) for i, r in enumerate(results) if name in r]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        if "id" in rows.columns:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_o"))).where("_n = 1").drop("_n")
        out[name] = rows.drop("_o")
    return out


def without_servers(parsed: dict[str, DataFrame], servers: list[str] | None = None) -> dict[str, DataFrame]:
    """Frames without messages of calls to tool servers (``mcp__server__tool``), all of them or the named ones, and what hangs on them (PRJ-2, PRJ-8)."""
    uses, results = parsed["tool_uses"], parsed["tool_results"]
    hit = F.col("tool_name").startswith("mcp__")
    if servers is not None:
        hit = hit & F.split("tool_name", "__")[1].isin(servers)
    bad_uses = uses.where(hit).select(F.col("id").alias("tool_use_id"), "message_id")
    bad = bad_uses.select("message_id").union(results.join(bad_uses.select("tool_use_id"), "tool_use_id", "left_semi").select("message_id")).distinct()
    drop = lambda df, c: df.join(bad.withColumnRenamed("message_id", c), c, "left_anti")
    return {**parsed, "messages": drop(parsed["messages"], "id"), **{k: drop(parsed[k], "message_id") for k in ("tool_uses", "tool_results", "thinking_blocks", "file_edits") if k in parsed}}


def servers_used(tool_uses: DataFrame) -> DataFrame:
    """Distinct tool servers (PRJ-2)."""
    return tool_uses.where(F.col("tool_name").startswith("mcp__")).select(F.split("tool_name", "__")[1].alias("server")).distinct()
