"""Extraction operators over messages (message_id, conversation_id, role, content, timestamp) and tool rows.

All are column expressions or joins on keys: no Python runs on the rows. Ids are hashes of what identifies
a fact, so a second run over the same messages gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T

from . import rules as R


def anyof(c, patterns: list[str], case: bool = False) -> Column:
    """Whether one of the patterns matches; false for null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(("" if case else "(?i)") + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def hits(c, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, ignoring case."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("(?i)" + pattern), F.lit(group))


def group(c, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null without one."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike("(?i)" + pattern), F.trim(F.regexp_extract(col, "(?i)" + pattern, n)))


def first_label(c, labelled: dict[str, list[str]] | list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Label of the first rule that matches, in order."""
    pairs = labelled.items() if isinstance(labelled, dict) else labelled
    return F.coalesce(*[F.when(anyof(c, p), F.lit(k)) for k, p in pairs], F.lit(default))


def fact_id(kind: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def context_of(c) -> Column:
    """First context keyword, in the list's order, that occurs (EXT-D4)."""
    found = F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit("(?=(" + "|".join(R.CONTEXTS) + "))"), F.lit(1))
    return F.get(F.array_intersect(F.array(*map(F.lit, R.CONTEXTS)), found), F.lit(0))


# decisions ---------------------------------------------------------------------------------------------------------


def _fields(hit: Column) -> dict[str, Column]:
    lead = F.regexp_replace(hit, r"(?i)^(?:we|i|let's)\s+(?:decided|choose|chose|went with|picked|selected)\s+(?:to\s+)?", "")
    rejected = hits(hit, REJECTED, 0)
    instead = group(hit, r"(?:instead of|over|rather than)\s+(.+?)(?:\s+because|\z)")
    considered = F.transform(F.split(F.coalesce(group(hit, r"considered\s+(.+?)(?:\s+but|\z)"), F.lit("")), ",|and"), lambda x: F.trim(x))
    return {
        "decision_text": F.trim(F.regexp_replace(lead, r"(?i)\s+(?:because|since|as|for|due to).+\z", "")),
        "rationale": group(hit, r"(?:because|since|as|for|due to)\s+(.+?)(?:\.|\z)"),
        "alternatives": F.filter(F.concat(F.array(instead), considered), lambda x: x.isNotNull() & (x != "")),
        "rejected_reasons": F.map_from_entries(rejections(hit)),
        "n_rejected": F.size(rejected),
        "context": context_of(hit),
    }


REJECTED = r"(?:rejected|dismissed|avoided|didn't use)\s+(.+?)\s+(?:because|due to|since)\s+(.+?)(?:\.|\z)"


def rejections(hit: Column) -> Column:
    """array<struct<key,value>>: what was rejected and why, the last reason of each (MAP-1, EXT-D4)."""
    both = F.arrays_zip(F.transform(hits(hit, REJECTED, 1), lambda x: F.trim(x)).alias("key"), F.transform(hits(hit, REJECTED, 2), lambda x: F.trim(x)).alias("value"))
    pairs = F.transform(both, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]))


def decision_score(rationale="rationale", alternatives="alternatives", n_rejected="n_rejected", n_files="n_files", context="context", correction="is_correction") -> Column:
    """Importance of a decision (EXT-D5)."""
    return F.when(F.col(rationale).isNotNull(), 2).otherwise(0) + F.when(F.size(alternatives) > 0, 3).otherwise(0) + F.when(F.col(n_rejected) > 0, 3).otherwise(0) + F.when(F.col(n_files) > 0, 2).otherwise(0) + F.when(F.col(context).isNotNull(), 1).otherwise(0) + F.when(F.col(correction), 5).otherwise(0)


def decisions(messages: DataFrame, thinking: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Decisions of assistants and corrections by users that score ``least`` or more (EXT-D1 to EXT-D5)."""
    m = messages.where(~P.noise("content", R.NOISE))
    if thinking is not None:  # the first block of a message (JN-18)
        t = thinking.groupBy("message_id").agg(F.min_by("thinking_content", F.struct("timestamp", "id")).alias("_t"))
        m = m.join(t, "message_id", "left").withColumn("whole", F.concat_ws("\n", "content", F.coalesce("_t", F.lit("")))).drop("_t")
    else:
        m = m.withColumn("whole", F.col("content"))
    files = F.size(T.paths_in("metadata")) if "metadata" in messages.columns else F.lit(0)
    m = m.withColumn("n_files", files)
    keys = ["message_id", "conversation_id", "timestamp", "n_files"]
    talk = m.where("role = 'assistant'")
    found = talk.select(*keys, F.explode(F.concat(*[hits("whole", p) for p in R.DECISIONS])).alias("hit"))
    plain = found.select(*keys, *[c.alias(n) for n, c in _fields(F.col("hit")).items()], F.lit(False).alias("is_correction"))
    blocks = talk.select(*keys, "whole", F.explode(hits("whole", R.DECISION_BLOCK)).alias("hit"))
    part = lambda n: F.when(F.trim(F.regexp_extract("hit", "(?i)" + R.DECISION_BLOCK, n)) != "", F.trim(F.regexp_extract("hit", "(?i)" + R.DECISION_BLOCK, n)))
    structured = blocks.select(*keys, part(1).alias("decision_text"), part(2).alias("rationale"), F.filter(F.transform(F.split(F.coalesce(part(3), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("alternatives"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("rejected_reasons"), F.lit(0).alias("n_rejected"), context_of("whole").alias("context"), F.lit(False).alias("is_correction")).where("decision_text is not null")
    user = m.where("role = 'user'")
    which = F.coalesce(*[F.when(F.col("content").rlike("(?i)" + p), F.lit(i)) for i, p in enumerate(R.CORRECTIONS)])
    one = F.coalesce(*[F.when(F.col("_which") == i, F.trim(F.regexp_extract("content", "(?i)" + p, 1))) for i, p in enumerate(R.CORRECTIONS)])
    two = F.when(F.col("_which") == 3, F.trim(F.regexp_extract("content", "(?i)" + R.CORRECTIONS[3], 2)))
    technical = F.col("context").isNotNull() | F.lower("content").rlike("|".join(R.TECHNICAL))
    told = user.withColumn("_which", which).where("_which is not null").withColumn("context", context_of("content")).where(technical).withColumn("_one", one).withColumn("_two", two)
    corrections = told.select(
        *keys,
        F.when(F.col("_two").isNotNull(), F.concat(F.lit("Use "), F.col("_two"), F.lit(" instead of "), F.col("_one"))).otherwise(F.col("_one")).alias("decision_text"),
        F.lit("User correction - previous approach was incorrect").alias("rationale"),
        F.when(F.col("_two").isNotNull(), F.array("_one")).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        F.when(F.col("_two").isNotNull(), F.create_map("_one", F.lit("User correction"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("rejected_reasons"),
        F.lit(1).alias("n_rejected"),
        "context",
        F.lit(True).alias("is_correction"),
    )
    rows = plain.unionByName(structured).unionByName(corrections).withColumn("score", decision_score())
    signature = F.concat_ws("_", F.col("message_id").cast("string"), F.substring(F.lower("decision_text"), 1, 100), F.col("timestamp").cast("string"))
    w = Window.partitionBy("_sig").orderBy(F.desc("score"), "decision_text")
    return rows.withColumn("_sig", signature).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("score") >= least)).withColumn("id", fact_id("decision", "_sig")).drop("_sig", "_n")


# mistakes ----------------------------------------------------------------------------------------------------------


def mistake_type(c) -> Column:
    return first_label(c, R.MISTAKE_TYPES)


def error_summary(c) -> Column:
    """The most telling line of an error output (EXT-M1)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    telling = F.get(F.filter(lines, lambda x: anyof(x, R.DESCRIPTIVE)), F.lit(0))
    other = F.get(F.filter(lines, lambda x: ~x.rlike(r"(?i)^exit\s*code\s*\d+\z")), F.lit(0))
    best = F.coalesce(telling, other, F.get(lines, F.lit(0)), F.lit("Unknown error"))
    return F.when(F.length(best) > 300, F.concat(F.substring(best, 1, 300), F.lit("..."))).otherwise(best)


def tool_errors(results: DataFrame) -> DataFrame:
    """Mistakes from failed tool calls (EXT-M1)."""
    out = F.concat_ws("\n", "stderr", "stdout", "content")
    rows = results.where("is_error").withColumn("_out", out)
    return rows.select("id", "message_id", F.coalesce(mistake_type("_out"), F.lit("tool_error")).alias("mistake_type"), error_summary("_out").alias("what_went_wrong"))


def user_corrections(messages: DataFrame) -> DataFrame:
    """Corrections by users, each with the assistant message before it in its conversation (EXT-M2, WIN-1)."""
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("role") == "assistant", F.col("message_id")), ignorenulls=True).over(w)
    rows = messages.where(~P.noise("content", R.MISTAKE_NOISE)).withColumn("mistake_message_id", prior)
    return rows.where((F.col("role") == "user") & anyof("content", R.USER_CORRECTIONS)).select("message_id", "conversation_id", "mistake_message_id", F.coalesce(mistake_type("content"), F.lit("wrong_approach")).alias("mistake_type"), F.substring("content", 1, 500).alias("correction"))


def error_talk(messages: DataFrame, ahead: int = 4) -> DataFrame:
    """Errors that assistants mention, with the fix among the next messages (EXT-M3, WIN-2)."""
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id").rowsBetween(1, ahead)
    fix = F.first(F.when((F.col("role") == "assistant") & anyof("content", [R.FIXED]), F.substring("content", 1, 500)), ignorenulls=True).over(w)
    sentence = F.get(F.filter(F.split("content", r"[.!?]"), lambda s: anyof(s, R.ERROR_TALK)), F.lit(0))
    rows = messages.where(~P.noise("content", R.MISTAKE_NOISE)).withColumn("correction", fix)
    return rows.where((F.col("role") == "assistant") & anyof("content", R.ERROR_TALK)).select("message_id", "conversation_id", mistake_type("content").alias("mistake_type"), F.trim(sentence).alias("what_went_wrong"), "correction")


def severity(kind="mistake_type", correction="correction", user="is_user", n_files="n_files") -> Column:
    """Severity of a mistake (EXT-M4)."""
    by_kind = F.when(F.col(kind) == "logic_error", 3).when(F.col(kind) == "wrong_approach", 2).when(F.col(kind).isin("syntax_error", "tool_error"), 1).otherwise(0)
    return F.when(F.col(correction).isNotNull(), 2).otherwise(0) + F.when(F.col(user), 3).otherwise(0) + F.when(F.col(n_files) > 0, 2).otherwise(0) + by_kind


def mistakes(messages: DataFrame, results: DataFrame, least: int = 2) -> DataFrame:
    """All mistakes of a severity of ``least`` or more, one a message, kind and start of text (EXT-M1 to EXT-M4)."""
    at = messages.select("message_id", "conversation_id", "timestamp", "content")
    failed = tool_errors(results).drop("id").join(at.select("message_id", "conversation_id", "timestamp"), "message_id").withColumn("correction", F.lit(None).cast("string")).withColumn("source", F.lit("tool"))
    told = user_corrections(messages).join(at.select("message_id", "timestamp"), "message_id")
    told = told.select(F.coalesce("mistake_message_id", "message_id").alias("message_id"), "conversation_id", "timestamp", "mistake_type", F.substring("correction", 1, 200).alias("what_went_wrong"), "correction", F.lit("user").alias("source"))
    talked = error_talk(messages).join(at.select("message_id", "timestamp"), "message_id").withColumn("source", F.lit("assistant"))
    cols = ["message_id", "conversation_id", "timestamp", "mistake_type", "what_went_wrong", "correction", "source"]
    rows = failed.select(cols).unionByName(told.select(cols)).unionByName(talked.withColumn("mistake_type", F.coalesce("mistake_type", F.lit("general"))).select(cols))
    rows = rows.withColumn("files_affected", T.paths_in(F.concat_ws(" ", "what_went_wrong", "correction"))).withColumn("is_user", F.col("source") == "user").withColumn("n_files", F.size("files_affected"))
    rows = rows.withColumn("severity", severity()).where(F.col("severity") >= least)
    rows = rows.withColumn("id", fact_id("mistake", "message_id", "mistake_type", F.substring(F.lower("what_went_wrong"), 1, 100)))
    w = Window.partitionBy("id").orderBy(F.desc("severity"), F.col("correction").isNull(), "source", "timestamp", "correction")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "is_user", "n_files")


# requirements and validations --------------------------------------------------------------------------------------

# Parts of a system that a requirement may touch.
COMPONENTS = ["frontend", "backend", "api", "database", "auth", "ui", "server", "client"]
REASON = r"(?:because|since|for|due to)\s+(.+?)(?:\.|\z)"


def requirements(messages: DataFrame) -> DataFrame:
    """All matches of the requirement patterns, with rationale and components (EXT-R1).

    The description is what the pattern asks for; the rationale comes from the match, else from what follows its own
    place up to the sentence's end; components are those that the message names. Messages are dealt by their id first, as a table may be one row group and so one
    task; its matches then lie together, and only messages are moved.
    """
    dealt = messages.select("message_id", "conversation_id", "timestamp", "content").repartition("message_id")
    rows = dealt.select("message_id", "conversation_id", "timestamp", "content", F.explode(_matches([p for _, p in R.REQUIREMENTS])).alias("r"))
    kinds = F.array(*[F.lit(k) for k, _ in R.REQUIREMENTS])
    rows = rows.select("message_id", "conversation_id", "timestamp", "content", F.get(kinds, F.col("r.pattern")).alias("type"), F.trim("r.part").alias("description"), F.col("r.whole").alias("whole"), "r.pattern", "r.at").where("description <> ''")
    after = F.expr("substring(content, at + length(whole))")
    rationale = F.coalesce(group("whole", REASON), group(after, r"\A[^.]*?" + REASON))
    low = F.lower("content")
    components = F.filter(F.array(*map(F.lit, COMPONENTS)), lambda c: F.contains(low, c))
    sig = F.concat_ws("_", F.col("message_id").cast("string"), "type", F.substring("description", 1, 50))
    w = Window.partitionBy("message_id", "type", F.substring("description", 1, 50)).orderBy("timestamp", "pattern", "at")
    out = rows.select("message_id", "conversation_id", "timestamp", "type", "description", "pattern", "at", rationale.alias("rationale"), components.alias("affects_components")).withColumn("_sig", sig)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("id", fact_id("requirement", "_sig")).drop("_n", "_sig", "pattern", "at")


def _matches(patterns: list[str], c: str = "content") -> Column:
    """array<struct<pattern, at, whole, part>>: every match of every pattern, ignoring case, by number of the pattern and place."""
    numbered = lambda i: lambda x: F.struct(F.lit(i).alias("pattern"), x["at"].alias("at"), x["whole"].alias("whole"), x["part"].alias("part"))
    return F.concat(*[F.transform(T.placed(c, "(?i)" + p), numbered(i)) for i, p in enumerate(patterns)])


def validations(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Test runs and their outcome (EXT-R2). uses: id, command; results: tool_use_id, is_error, content."""
    j = uses.where(anyof("command", R.TEST_COMMANDS, case=True)).join(results, uses["id"] == results["tool_use_id"])
    low = F.lower(F.coalesce("content", F.lit("")))
    passed = anyof(low, [r"all tests? passed|✓|✔|success", r"\d+\s+passed,\s+0\s+failed"])
    failed = anyof(low, [r"test failed|✗|✘|failure|failed", r"\d+\s+failed"])
    number = lambda p, g=1: F.when(F.col("content").rlike("(?i)" + p), F.regexp_extract("content", "(?i)" + p, g))
    time = r"(\d+(?:\.\d+)?)\s*(ms|s|seconds?|milliseconds?)"
    ms = number(time).cast("double") * F.when(F.lower(number(time, 2)).startswith("s"), 1000.0).otherwise(1.0)
    subject = F.coalesce(group("command", r"test[/\\](.+?)(?:\s|\z)"), group("content", r"(?:Test Suite|Describe):\s*(.+)"), F.col("command"))
    outcome = F.when(F.col("is_error"), "error").when(passed, "passed").when(failed, "failed").otherwise("passed")
    files = T.paths_in(F.concat_ws(" ", "command", "content"), r"(?:[\w.-]*/)*[\w.-]*(?:test|spec)[\w.-]*\.\w+")
    return j.select(uses["id"], files.alias("test_files"), subject.alias("what_was_tested"), outcome.alias("result"), ms.alias("duration_ms"), number(r"(\d+)\s+passed").cast("long").alias("tests_passed"), number(r"(\d+)\s+failed").cast("long").alias("tests_failed"))


# segments ----------------------------------------------------------------------------------------------------------


def in_segments(messages: DataFrame) -> DataFrame:
    """Messages inside problem-solving segments, with ``segment`` (number in the conversation), ``good`` and ``closes`` (EXT-G1).

    A user problem opens a segment and ends the one before it; the first resolved or failed answer closes it. Both are running sums over a
    conversation in order of time, so no conversation is gathered in one row.
    """
    said = lambda role, *p: (F.col("role") == role) & anyof("content", [x for y in p for x in y])
    order = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id")
    rows = messages.withColumn("segment", F.sum(said("user", R.PROBLEM_START).cast("int")).over(order))
    rows = rows.withColumns({"closes": F.coalesce(said("assistant", R.SUCCESS, R.FAILURE), F.lit(False)), "good": F.coalesce(said("assistant", R.SUCCESS), F.lit(False))})
    before = Window.partitionBy("conversation_id", "segment").orderBy("timestamp", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("segment > 0").withColumn("_closed", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0))).where("_closed = 0").drop("_closed")


def methodology_segments(messages: DataFrame) -> DataFrame:
    """Problem-solving segments of each conversation (EXT-G1), two messages at least: first and last message, size and outcome."""
    at = F.struct("timestamp", "message_id")
    closed = F.when(F.max("good"), "success").when(F.max("closes"), "failed").otherwise("open")
    g = in_segments(messages).groupBy("conversation_id", "segment").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").cast("int").alias("n_messages"), closed.alias("outcome"))
    return g.where("n_messages >= 2").select("conversation_id", F.col("a.message_id").alias("start_message_id"), F.col("b.message_id").alias("end_message_id"), "n_messages", "outcome")


def approach(c) -> Column:
    """First approach that the text shows (EXT-G2)."""
    return first_label(c, R.APPROACHES, "implementation")


def outcome(c) -> Column:
    return first_label(c, [("success", R.SUCCESS), ("failed", R.FAILURE), ("partial", R.PARTIAL)], "ongoing")


PATHS = r"(?:/[\w.-]+)+\.[\w]+"
#: Sources that tools speak for, before any words do.
TOOL_SOURCES = {"Read": "code", "Glob": "code", "Grep": "code", "WebFetch": "documentation", "WebSearch": "web", "Bash": "experimentation"}


def _tools_of(uses: DataFrame) -> DataFrame:
    """message_id with the source, reference and items of its tool calls (message_id, tool_name, tool_input as JSON), the first call first."""
    at = F.struct("timestamp", "id")
    value = lambda k: F.get_json_object("tool_input", f"$.{k}")
    source = F.coalesce(*[F.when(F.col("tool_name") == k, F.lit(v)) for k, v in TOOL_SOURCES.items()])
    place = F.coalesce(value("file_path"), value("url"), value("path"))
    items = F.array_compact(F.array(value("file_path"), value("path")))
    return uses.groupBy("message_id").agg(F.min_by(source, F.when(source.isNotNull(), at)).alias("tool_source"), F.min_by(place, F.when(place.isNotNull(), at)).alias("tool_place"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", items.alias("items")))), lambda x: x["items"]))).alias("tool_items"))


def findings(messages: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Research findings of assistant messages (EXT-F1): every discovery of 20 characters or more, cut to 500.

    Topic, source, reference, relevance, confidence and related items are read from the words around the match's own place
    (200 before, 400 after) and, if ``uses`` are given, from the message's tool calls, which go first. Of discoveries of a message
    whose first 100 characters agree but for case, the first pattern's first one counts.
    """
    m = messages.where((F.col("role") == "assistant") & ~P.noise("content", R.SHORT_NOISE))
    # dealt by their id, as in requirements()
    m = m.select("message_id", "conversation_id", "content").repartition("message_id")
    rows = m.select("message_id", "conversation_id", "content", F.explode(_matches(R.DISCOVERIES)).alias("x"))
    rows = rows.select("message_id", "conversation_id", F.trim("x.part").alias("discovery"), "x.pattern", "x.at", F.expr("substring(content, greatest(x.at - 200, 1), x.at + 400 - greatest(x.at - 200, 1))").alias("around")).where(F.length("discovery") >= 20)
    first_place = Window.partitionBy("message_id", F.lower(F.substring("discovery", 1, 100))).orderBy("pattern", "at")
    rows = rows.withColumn("_n", F.row_number().over(first_place)).where("_n = 1")
    if uses is not None:
        rows = rows.join(_tools_of(uses), "message_id", "left")
    else:
        rows = rows.withColumns({"tool_source": F.lit(None).cast("string"), "tool_place": F.lit(None).cast("string"), "tool_items": F.lit(None).cast("array<string>")})
    first = lambda p: F.when(F.col("around").rlike(p), F.regexp_extract("around", p, 0))
    return rows.select(
        "message_id",
        "conversation_id",
        F.substring("discovery", 1, 500).alias("discovery"),
        F.substring(F.coalesce(*[group("around", p) for p in R.TOPICS], F.col("discovery")), 1, 100).alias("topic"),
        F.coalesce("tool_source", first_label("around", R.FINDING_SOURCES, "code")).alias("source_type"),
        F.coalesce("tool_place", first(PATHS), first(r"https?://[^\s)]+")).alias("source_reference"),
        first_label("around", [(k, R.RELEVANCE[k]) for k in ("high", "low")], "medium").alias("relevance"),
        first_label("around", [(k, R.SURENESS[k]) for k in ("verified", "uncertain")], "likely").alias("confidence"),
        F.array_distinct(F.concat(F.coalesce("tool_items", F.array().cast("array<string>")), T.paths_in("around", PATHS))).alias("related_to"),
    )


#: What a solution asks for first.
PREREQUISITES = [r"(?:(?:first|before),? (?:you need|ensure|make sure))\s+(.+?)(?:\.|\z)", r"(?:requires?|needs?)\s+(.+?)(?:\.|\z)", r"(?:install|setup|configure)\s+(.+?)(?:\.|\z)"]
COMPLETE = [r"(?:done|complete|finished|working|fixed)", r"(?:successfully|correctly) (?:implemented|fixed)"]


def problem_of(c) -> Column:
    """The problem that a user's message states: the first pattern's words, else its first sentence of more than ten characters."""
    sentence = F.trim(F.get(F.split(c, "[.!?]"), F.lit(0)))
    return F.coalesce(*[group(c, p) for p in R.PROBLEM_START], F.when(F.length(sentence) > 10, F.substring(sentence, 1, 200)))


def solution_segments(messages: DataFrame, most: int = 10) -> DataFrame:
    """(conversation_id, segment, message_id): rolling segments of each conversation (EXT-S1).

    A segment that has shown a solution ends at a completed answer, and any segment after more than ``most`` messages, where it
    counts only if it has shown one. The rule depends on where the segments before it ended, so it is a fold, over flags and ids only.
    """
    clean = messages.where(~P.noise("content", R.SHORT_NOISE))
    flags = F.struct("timestamp", "message_id", ((F.col("role") == "assistant") & anyof("content", R.SOLUTIONS)).alias("cue"), anyof("content", COMPLETE).alias("done"))
    rows = clean.groupBy("conversation_id").agg(F.array_sort(F.collect_list(flags)).alias("rows"))
    kind = messages.schema["message_id"].dataType.simpleString()
    none, no_list = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    zero = F.struct(none.alias("open"), F.lit(False).alias("cue"), no_list.alias("ended"))
    state = lambda open, cue, ended: F.struct(open.alias("open"), F.coalesce(cue, F.lit(False)).alias("cue"), ended.alias("ended"))

    def step(a, r):
        own, cue = F.concat(a["open"], F.array(r["message_id"])), a["cue"] | F.coalesce(r["cue"], F.lit(False))
        push = F.concat(a["ended"], F.array(own))
        full = F.size(own) > most
        return F.when(cue & (F.size(own) >= 2) & r["done"], state(none, F.lit(False), push)).when(full & cue, state(none, F.lit(False), push)).when(full, state(none, F.lit(False), a["ended"])).otherwise(state(own, cue, a["ended"]))

    folded = F.aggregate("rows", zero, step, lambda a: F.when(a["cue"] & (F.size(a["open"]) >= 2), F.concat(a["ended"], F.array(a["open"]))).otherwise(a["ended"]))
    ended = rows.select("conversation_id", F.posexplode(folded).alias("segment", "ids"))
    return ended.select("conversation_id", "segment", F.explode("ids").alias("message_id"))


def solutions(messages: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Solution patterns of rolling segments that hold a user's problem and a solution (EXT-S1, EXT-S2); written files need ``uses``.

    Rows of one segment meet by key: eleven messages at most. One pattern of each category and start of summary is kept in a conversation.
    """
    at = solution_segments(messages).join(messages.select("message_id", "conversation_id", "role", "content", "timestamp"), ["conversation_id", "message_id"])
    key = ["conversation_id", "segment"]
    cue = F.coalesce(*[group("content", p) for p in R.SOLUTIONS])
    order = F.struct("timestamp", "message_id")
    answer = (F.col("role") == "assistant") & (F.length("content") > 0)
    rows = F.array_sort(F.collect_list(F.struct("timestamp", "message_id", "content")))
    text = lambda a: F.array_join(F.transform(a, lambda r: r["content"]), "\n")
    best = F.struct("message_id", "content", cue.alias("cue"))
    g = at.groupBy(*key).agg(
        F.min_by("content", F.when((F.col("role") == "user") & (F.length("content") > 0), order)).alias("asked"),
        F.coalesce(F.min_by(best, F.when(answer & cue.isNotNull(), order)), F.max_by(best, F.when(answer, order))).alias("told"),
        text(rows).alias("whole"),
        text(F.slice(rows, F.greatest(F.size(rows) - 2, F.lit(1)), F.lit(3))).alias("end"),
    )
    g = g.withColumn("problem", problem_of("asked")).where("problem is not null and told is not null").withColumn("content", F.col("told.content"))
    if uses is None:
        g = g.withColumn("applied_to_files", F.array().cast("array<string>"))
    else:
        wrote = uses.where(F.col("tool_name").isin("Write", "Edit", "MultiEdit")).select("message_id", F.get_json_object("tool_input", "$.file_path").alias("f")).join(at.select("message_id", *key), "message_id")
        g = g.join(wrote.groupBy(*key).agg(F.array_sort(F.collect_set("f")).alias("applied_to_files")), key, "left").withColumn("applied_to_files", F.coalesce("applied_to_files", F.array().cast("array<string>")))
    steps = F.slice(F.concat(F.regexp_extract_all("whole", F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), F.lit(1)), F.regexp_extract_all("whole", F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1))), 1, 10)
    code = F.substring(F.regexp_extract("content", r"(?s)```\w*\n(.*?)```", 1), 1, 500)
    several = lambda c, rules: F.concat(*[hits(c, p, 1) for p in rules])
    when = lambda rules: F.substring(F.coalesce(*[group("whole", p) for p in rules]), 1, 200)
    out = g.select(
        F.col("told.message_id").alias("message_id"),
        "conversation_id",
        F.coalesce(F.col("told.cue"), F.substring(F.trim(F.get(F.split("content", "[.!?]"), F.lit(0))), 1, 200)).alias("solution_summary"),
        first_label("problem", R.CATEGORIES, "general").alias("problem_category"),
        first_label("end", [(k, dict(R.EFFECTIVENESS)[k]) for k in ("excellent", "poor", "moderate") if k in dict(R.EFFECTIVENESS)], "good").alias("effectiveness"),
        steps.alias("solution_steps"),
        F.when(code != "", code).alias("code_pattern"),
        F.slice(F.array_distinct(F.transform(several("whole", R.TECHNOLOGIES), lambda t: F.lower(t))), 1, 5).alias("technology"),
        F.transform(F.slice(several("content", PREREQUISITES), 1, 5), lambda x: F.substring(F.trim(x), 1, 100)).alias("prerequisites"),
        F.coalesce(when(R.APPLIES_WHEN), F.substring("problem", 1, 200)).alias("applies_when"),
        when(R.AVOID_WHEN).alias("avoid_when"),
        "applied_to_files",
    )
    w = Window.partitionBy("conversation_id", "problem_category", F.substring(F.lower("solution_summary"), 1, 50)).orderBy("message_id")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# live --------------------------------------------------------------------------------------------------------------


def live_decisions(messages: DataFrame, over: float = 0.5) -> DataFrame:
    """Decisions in a live message, with confidence above ``over`` (EXT-L1)."""
    found = F.concat(*[F.transform(hits("content", p, 1), lambda x: F.trim(x)) for p in R.LIVE_DECISIONS])
    rows = messages.select("message_id", F.length("content").alias("_len"), F.explode(F.array_distinct(found)).alias("text")).where(F.length("text").between(10, 200))
    score = 5 + reduce(lambda a, b: a + b, [F.when(anyof("text", [p]), 1).otherwise(0) for p in R.TECH_FAMILIES]) + F.when(F.col("_len") > 500, 1).otherwise(0) - F.when(F.col("text").contains("?"), 2).otherwise(0)
    confidence = F.least(F.greatest(score, F.lit(0)), F.lit(10)) / 10
    return rows.select("message_id", "text", confidence.alias("confidence")).where(F.col("confidence") > over)


def live_file_ops(uses: DataFrame) -> DataFrame:
    """File operations of live tool uses: name, file_path, command (EXT-L2)."""
    removed = F.regexp_extract(F.coalesce("command", F.lit("")), r"rm\s+(?:-\w+\s+)*(\S+)", 1)
    path = F.when(F.col("name").isin("Read", "Edit", "Write"), F.col("file_path")).when((F.col("name") == "Bash") & F.col("command").contains("rm ") & (removed != ""), removed)
    action = F.when(F.col("name") == "Read", "read").when(F.col("name") == "Edit", "edit").when(F.col("name") == "Write", "create").otherwise("delete")
    return uses.select("id", path.alias("path"), action.alias("action")).where("path is not null")


def live_errors(c) -> Column:
    """Up to five error texts of a message (EXT-L3)."""
    found = F.concat(*[F.transform(hits(c, p, 1), lambda x: F.trim(x)) for p in R.LIVE_ERRORS])
    return F.slice(F.filter(found, lambda x: (F.length(x) > 5) & (F.length(x) < 500)), 1, 5)


# validation --------------------------------------------------------------------------------------------------------


def decision_confidence(c, source=None) -> Column:
    """Product of the factors of everything that speaks against a decision text (EXT-V1)."""
    col = F.col(c)
    low = F.lower(col)
    keyword = reduce(lambda a, b: a | b, [low.contains(k) for k in R.ACTIONABLE])
    factors = [F.when(F.length(col) < 20, 0.3), F.when(F.length(col) > 500, 0.7), F.when(~keyword, 0.5), F.when(anyof(col, R.SUMMARY_START), 0.2), F.when(anyof(col, R.SHORT_REPLIES), 0.1)]
    if source is not None:
        factors.append(F.when(~F.lower(F.col(source)).contains(low), 0.6))
    factors.append(F.when(F.size(F.split(F.trim(col), r"\s+")) < 3, 0.7))
    return reduce(lambda a, b: a * b, [f.otherwise(1.0) for f in factors])


def decision_valid(c, source=None, least: float = 0.5) -> Column:
    return (decision_confidence(c, source) >= least) & ~anyof(c, R.SUMMARY_START) & ~anyof(c, R.SHORT_REPLIES)
