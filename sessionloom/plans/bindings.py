"""Session entities over the benchmark tables, in Spark and as SQL for the oracle.

The tables are no session logs, so each entity has a stand-in: events are tool calls, line items are file
edits, parts are memory items and tagged things, customers are project sources, and messages are
sentences put together from part columns so that the extraction rules have something to find.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import millis

NOW = 1_706_745_600_000  # 2024-02-01, a fixed clock


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_uses(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("message_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("tool_input"), millis("ts").alias("timestamp"))


TOOL_USES = "(SELECT event_id AS id, user_id AS message_id, event_type AS tool_name, props AS tool_input, epoch_us(ts) // 1000 AS timestamp FROM events)"


def tool_results(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 3 <> 0")
    return e.select((F.col("event_id") + 1_000_000_000).alias("id"), F.col("event_id").alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), F.concat(F.lit("value "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" props "), F.col("props")).alias("content"))


TOOL_RESULTS = "(SELECT event_id + 1000000000 AS id, event_id AS tool_use_id, event_type = 'error' AS is_error, 'value ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props ' || props AS content FROM events WHERE event_id % 3 <> 0)"


def edits(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("/src/m"), (F.col("l_partkey") % 50).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("file_path"), F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("version"), millis("l_shipdate").alias("timestamp"))


EDITS = "(SELECT '/src/m' || (l_partkey % 50) || '/p' || l_partkey || '.ts' AS file_path, l_orderkey AS conversation_id, l_linenumber AS version, epoch_us(l_shipdate) // 1000 AS timestamp FROM lineitem)"


def memory(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), ((k % m) % len(v) + 1).cast("int"))
    return p.select(
        F.concat(F.lit("k"), k.cast("string")).alias("key"),
        k.alias("id"),
        F.col("p_name").alias("value"),
        F.concat(F.lit("about "), F.col("p_brand")).alias("context"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("tags"),
        F.concat(F.lit("/proj/"), (k % 5).cast("string")).alias("project_path"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("session_id"),
        pick(7, "uncertain", "likely", "confirmed", "verified").alias("confidence"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(pick(9, "low", "normal", "high", "critical")).alias("importance"),
        (k % 13 == 0).alias("pinned"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(k % 10 == 0).alias("archived"),
        (F.lit(NOW) - (k % 200) * 86_400_000).alias("updated_at"),
        (F.lit(NOW) - (k % 400) * 86_400_000).alias("created_at"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit(NOW) + ((k % 21) - 7) * 86_400_000).alias("expires_at"),
    )


def _pick(m: int, *v: str) -> str:
    return f"([{', '.join(repr(x) for x in v)}])[CAST((p_partkey % {m}) % {len(v)} AS INT) + 1]"


MEMORY = f"""(SELECT 'k' || p_partkey AS key, p_partkey AS id, p_name AS value, 'about ' || p_brand AS context, [lower(p_type), lower(p_brand)] AS tags,
 '/proj/' || (p_partkey % 5) AS project_path, 's' || (p_partkey % 7) AS session_id, {_pick(7, 'uncertain', 'likely', 'confirmed', 'verified')} AS confidence,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {_pick(9, 'low', 'normal', 'high', 'critical')} END AS importance, p_partkey % 13 = 0 AS pinned,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 10 = 0 END AS archived, {NOW} - (p_partkey % 200) * 86400000 AS updated_at, {NOW} - (p_partkey % 400) * 86400000 AS created_at,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {NOW} + ((p_partkey % 21) - 7) * 86400000 END AS expires_at FROM part)"""

#: Sentence templates by part key: {a} brand, {b} type, {n} name; the last member is the role.
TEMPLATES = [
    ("We decided to use {a} because {b} parts are fast.", "assistant"),
    ("Use {a} instead of {b} because the database is slow.", "assistant"),
    ("That is wrong, use {a} for the api.", "user"),
    ("I need to fix the {n} module.", "user"),
    ("Error: {b} failed to start. The fix is small.", "assistant"),
    ("It is fixed and all tests pass for {n}.", "assistant"),
    ("We must support {a} version.", "user"),
    ("Let me summarize the work on {n}.", "assistant"),
    ("That is wrong, use {a}. You made an error in the {n} function.", "user"),
    ("I found that {a} needs the {n} library to run.", "assistant"),
    ("We should adopt {a} with python. The key is to use {n}.", "assistant"),
    ("Plain words about {n}.", "assistant"),
]


def _fill(text: str) -> list[tuple[str, str]]:
    out, rest = [], text
    while "{" in rest:
        i = rest.index("{")
        out += [("text", rest[:i]), ("col", {"a": "p_brand", "b": "p_type", "n": "p_name"}[rest[i + 1]])]
        rest = rest[i + 3 :]
    return [*out, ("text", rest)]


def messages(spark, d) -> DataFrame:
    """message_id, conversation_id, role, content, timestamp."""
    p = table(spark, d, "part")
    k = F.pmod(F.col("p_partkey") * 7 + F.floor(F.col("p_partkey") / 9), F.lit(len(TEMPLATES)))
    content, role = None, None
    for i, (t, r) in enumerate(TEMPLATES):
        c = F.concat(*[F.lit(v) if kind == "text" else F.col(v) for kind, v in _fill(t)])
        content = F.when(k == i, c) if content is None else content.when(k == i, c)
        role = F.when(k == i, r) if role is None else role.when(k == i, r)
    return p.select(F.col("p_partkey").alias("message_id"), F.floor(F.col("p_partkey") / 20).alias("conversation_id"), role.alias("role"), content.alias("content"), F.col("p_partkey").alias("timestamp"))


def _case(values: list[str]) -> str:
    return "CASE (p_partkey * 7 + p_partkey // 9) % " + str(len(TEMPLATES)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


MESSAGES = (
    "(SELECT p_partkey AS message_id, p_partkey // 20 AS conversation_id, "
    + _case([f"'{r}'" for _, r in TEMPLATES])
    + " AS role, "
    + _case([" || ".join(f"'{v}'" if kind == "text" else v for kind, v in _fill(t)) for t, _ in TEMPLATES])
    + " AS content, p_partkey AS timestamp FROM part)"
)


def scratch(s) -> str:
    """A new folder that driver and executors share, for tables that a query builds: under spark.checkpoint.dir; a session on one machine that names none gets a temporary one."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir") or s.sparkContext.getCheckpointDir()
    if not base:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
