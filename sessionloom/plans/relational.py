"""Relational and memory queries over the stand-ins, each with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T
from sessionloom.operators import memory as M
from sessionloom.operators import relational as R
from sessionloom.operators import search as S
from sessionloom.operators import tools as O

from . import bindings as B
from .bindings import EDITS, MEMORY, MESSAGES, NOW, TOOL_RESULTS, TOOL_USES, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""SELECT u.id, tool_name, timestamp, r.id AS result_id, is_error, CASE WHEN length(content) > 20 THEN substr(content, 1, 20) || '... (truncated)' ELSE content END AS content
FROM {TOOL_USES} u LEFT JOIN {TOOL_RESULTS} r ON r.tool_use_id = u.id WHERE tool_name = 'error' AND timestamp BETWEEN 1704500000000 AND 1706000000000""")
def tool_history(s, d):
    return R.tool_history(B.tool_uses(s, d), B.tool_results(s, d), "error", 1704500000000, 1706000000000, content_chars=20).select("id", "tool_name", "timestamp", "result_id", "is_error", "content")


@query(f"""SELECT id, tool_name, timestamp, true AS has_more FROM {TOOL_USES} ORDER BY timestamp DESC, id LIMIT 25 OFFSET 50""")
def tool_history_page(s, d):
    return R.page(B.tool_uses(s, d).select("id", "tool_name", "timestamp"), [F.desc("timestamp"), F.asc("id")], 25, 50)


@query("""SELECT c.conv_id AS id, count(m.turn) AS n_messages, CASE WHEN length(f) > 40 THEN substr(f, 1, 39) || '…' ELSE f END AS preview
FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN conversations m USING (conv_id)
JOIN (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS f FROM conversations GROUP BY conv_id) x USING (conv_id) GROUP BY c.conv_id, f""")
def session_list_preview(s, d):
    c = table(s, d, "conversations")
    m = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("timestamp"), F.col("text").alias("content"))
    return R.session_previews(c.select(F.col("conv_id").alias("id")).distinct(), m, 40)


@query("""SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def latest_per_role(s, d):
    return R.latest(table(s, d, "conversations"), ["conv_id", "role"], [F.desc("turn")], 3).select("conv_id", "role", "turn")


@query(f"""SELECT * FROM (SELECT 'edit' AS kind, conversation_id AS ref, timestamp, file_path AS detail FROM {EDITS} WHERE file_path = '/src/m7/p7.ts'
UNION ALL SELECT 'commit', o_orderkey, epoch_us(o_orderdate) // 1000, o_orderpriority FROM orders WHERE o_custkey = 7)""")
def file_timeline(s, d):
    e = B.edits(s, d).where("file_path = '/src/m7/p7.ts'").select(F.lit("edit").alias("kind"), F.col("conversation_id").alias("ref"), "timestamp", F.col("file_path").alias("detail"))
    c = table(s, d, "orders").where("o_custkey = 7").select(F.lit("commit").alias("kind"), F.col("o_orderkey").alias("ref"), T.millis("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("detail"))
    return R.timeline(e, c)


@query(f"""SELECT file_path, count(DISTINCT conversation_id) AS n_conversations, max(timestamp) AS last_change, string_agg(DISTINCT CAST(conversation_id AS VARCHAR), ',' ORDER BY CAST(conversation_id AS VARCHAR)) AS conversations
FROM {EDITS} GROUP BY file_path ORDER BY last_change DESC, file_path LIMIT 30""")
def file_change_stats(s, d):
    f = R.file_changes(B.edits(s, d), 30)
    return f.withColumn("conversations", F.array_join(F.array_sort(F.split("conversations", ",")), ","))


@query("""SELECT count(DISTINCT c_nationkey) AS projects, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS primary_sources, CAST(sum(CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS secondary_sources, CAST(sum(c_custkey) AS BIGINT) AS messages, CAST(sum(c_custkey % 10) AS BIGINT) AS conversations FROM customer""")
def registry_stats(s, d):
    c = table(s, d, "customer")
    return R.registry_stats(c.select(F.col("c_nationkey").alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, "primary").otherwise("secondary").alias("source_type"), F.col("c_custkey").alias("message_count"), (F.col("c_custkey") % 10).alias("conversation_count")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("customer", "orders", "events", "conversations")))
def global_stats(s, d):
    return R.counts(**{t: table(s, d, t) for t in ("customer", "orders", "events", "conversations")})


TAGS = "(SELECT DISTINCT p_size AS id, 'size' || p_size AS name FROM part UNION ALL SELECT 9999, 'unused')"
ITEMS = "(SELECT p_size AS tag_id, CASE WHEN p_partkey % 2 = 0 THEN 'decision' ELSE 'mistake' END AS item_type, p_partkey AS item_id, p_partkey AS created_at FROM part)"


def _tags(s, d):
    p = table(s, d, "part")
    tags = p.select(F.col("p_size").alias("id"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("name")).distinct().unionByName(s.createDataFrame([(9999, "unused")], "id int, name string"))
    items = p.select(F.col("p_size").alias("tag_id"), F.when(F.col("p_partkey") % 2 == 0, "decision").otherwise("mistake").alias("item_type"), F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("created_at"))
    return tags, items


@query(f"""SELECT t.id AS tag_id, name, count(i.tag_id) AS usage_count, max(i.created_at) AS last_used, coalesce(string_agg(DISTINCT item_type, ',' ORDER BY item_type), '') AS used_in FROM {TAGS} t LEFT JOIN {ITEMS} i ON i.tag_id = t.id GROUP BY t.id, name""")
def tag_stats(s, d):
    return R.tag_stats(*_tags(s, d))


TYPED = "(SELECT lower(p_type) AS name, p_partkey AS item_id, 'part' AS item_type FROM part UNION ALL SELECT lower(p_brand), p_partkey, 'part' FROM part)"


def _typed(s, d):
    p = table(s, d, "part")
    both = p.select(F.explode(F.array(F.lower("p_type"), F.lower("p_brand"))).alias("name"), F.col("p_partkey").alias("item_id"), F.lit("part").alias("item_type"))
    items = both.select(F.xxhash64("name").alias("tag_id"), "item_type", "item_id")
    return items, both.select(F.xxhash64("name").alias("id"), "name").distinct()


@query(f"""SELECT item_type, item_id, string_agg(DISTINCT name, ',' ORDER BY name) AS matched, count(DISTINCT name) AS n_matched FROM {TYPED} WHERE name IN ('economy', 'brand#7') GROUP BY ALL""")
def tags_any(s, d):
    return M.tagged(*_typed(s, d), ["economy", "brand#7"], every=False)


@query(f"""SELECT item_type, item_id, string_agg(DISTINCT name, ',' ORDER BY name) AS matched, count(DISTINCT name) AS n_matched FROM {TYPED} WHERE name IN ('economy', 'brand#7') GROUP BY ALL HAVING count(DISTINCT name) = 2""")
def tags_all(s, d):
    return M.tagged(*_typed(s, d), ["economy", "brand#7", "economy"], every=True)


@query(f"""SELECT DISTINCT CASE WHEN tag_id IN (3, 4) THEN 5 ELSE tag_id END AS tag_id, item_type, item_id FROM {ITEMS}""")
def tag_merge(s, d):
    return M.merge_tags(_tags(s, d)[1], [3, 4], 5).drop("created_at")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey"))
    return R.orphans(o, table(s, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings_anti(s, d):
    return R.orphans(table(s, d, "documents").select("doc_id"), table(s, d, "embeddings"), "doc_id", "vec_id")


@query("""SELECT a.conv_id, a.turn, b.turn AS parent_turn FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def parent_messages(s, d):
    m = table(s, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("external_id"), (F.col("turn") - 1).alias("parent_external_id"), F.col("turn").alias("id"))
    return R.parents_resolved(m).select(F.col("conversation_id").alias("conv_id"), F.col("external_id").alias("turn"), F.col("parent_message_id").alias("parent_turn"))


@query("""SELECT source, n, first_seen FROM (SELECT source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY source) ORDER BY n DESC, first_seen LIMIT 1""")
def project_mode_cwd(s, d):
    return R.mode(table(s, d, "documents"), "source", "doc_id")


LEVEL = "CASE importance WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END"


@query(f"""SELECT lower(trim(value)) AS norm, count(*) AS n, arg_min(id, (-{LEVEL}, -created_at, id)) AS keep_id FROM {MEMORY} GROUP BY norm HAVING count(*) > 1""")
def duplicate_groups(s, d):
    return R.duplicate_groups(B.memory(s, d), "id", "value", "importance", "created_at")


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce(archived, false)) AS active, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE pinned) AS pinned,
count(*) FILTER (WHERE expires_at <= {NOW}) AS expired, count(*) FILTER (WHERE expires_at > {NOW} AND expires_at <= {NOW} + 7 * 86400000) AS expiring_soon FROM {MEMORY}""")
def memory_stats(s, d):
    return M.memory_stats(B.memory(s, d), NOW)


@query(f"""SELECT b AS bucket, count(m.id) AS n FROM (SELECT unnest(['low', 'normal', 'high', 'critical']) AS b) LEFT JOIN {MEMORY} m ON coalesce(m.importance, 'normal') = b GROUP BY b""")
def memory_histogram(s, d):
    return M.histogram(B.memory(s, d), "importance", M.IMPORTANCE, "normal")


@query(f"""SELECT id, CAST(floor(({NOW} - updated_at) / 86400000) AS BIGINT) AS days_stale FROM {MEMORY} WHERE updated_at < {NOW} - 30 * 86400000::BIGINT AND NOT coalesce(pinned, false) AND NOT coalesce(archived, false) AND importance NOT IN ('critical', 'high')""")
def stale_items(s, d):
    return M.stale(B.memory(s, d), NOW, 30).select("id", "days_stale")


@query(f"""SELECT id, key, confidence, importance FROM {MEMORY} WHERE confidence IN ('confirmed', 'verified') AND (contains(lower(key), 'ring') OR contains(lower(value), 'ring') OR contains(lower(context), 'ring')) AND NOT coalesce(archived, false)""")
def quality_search_sort(s, d):
    return M.search_quality(B.memory(s, d), ["confirmed", "verified"], text="RING").select("id", "key", "confidence", "importance")


@query(f"""SELECT id, key FROM {MEMORY} WHERE project_path = '/proj/2' AND (expires_at IS NULL OR expires_at > {NOW}) AND list_has_any(tags, ['economy', 'small'])""")
def recall_live(s, d):
    return M.recall(B.memory(s, d), NOW, "/proj/2", tags=["economy", "small"]).select("id", "key")


@query(f"""SELECT project_path, key, CASE WHEN id % 3 = 0 THEN 'new ' || value ELSE value END AS value, created_at, CASE WHEN id % 3 = 0 THEN {NOW} ELSE updated_at END AS updated_at,
CASE WHEN id % 3 = 0 THEN {NOW} + 60000 ELSE expires_at END AS expires_at FROM {MEMORY}""")
def merge_upsert(s, d):
    m = B.memory(s, d).select("id", "project_path", "key", "value", "created_at", "updated_at", "expires_at")
    fresh = m.where("id % 3 = 0").select("project_path", "key", F.concat(F.lit("new "), "value").alias("value"), F.lit(60).alias("ttl"))
    return M.remember(m.drop("id"), fresh, NOW)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def delete_cascade(s, d):
    doomed = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(doomed, "l_orderkey", "left_anti")


@query(f"""SELECT id, used FROM (SELECT id, sum(tokens) OVER (ORDER BY p, updated_at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT id, updated_at, CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS p, CAST(ceil(length(value) / 4.0) AS BIGINT) AS tokens FROM {MEMORY})) WHERE used <= 500""")
def context_budget(s, d):
    m = B.memory(s, d).withColumn("p", F.when(F.col("importance") == "critical", 0).when(F.col("importance") == "high", 1).otherwise(2)).withColumn("tokens", T.simple_tokens("value"))
    return M.within_budget(m, 500, "p", "updated_at").select("id", "used")


@query(f"""SELECT tool_name AS file_path, id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY timestamp DESC, id DESC) AS n FROM (SELECT * FROM {TOOL_USES} ORDER BY timestamp DESC, id DESC LIMIT 50)) WHERE n = 1""")
def handoff_active_files(s, d):
    return M.active_files(B.tool_uses(s, d), F.col("tool_name")).select("file_path", "id", "timestamp")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY month")
def monthly_timeline(s, d):
    return R.monthly(table(s, d, "orders"), "o_orderdate")


@query(f"""WITH f AS (SELECT regexp_extract(file_path, '^(.*?)/[^/]*$', 1) AS module, conversation_id % 7 AS k FROM (SELECT DISTINCT file_path, conversation_id FROM {EDITS}))
SELECT module, count(*) AS n_files, count(*) FILTER (WHERE k = 1) AS n_decisions, count(*) FILTER (WHERE k = 2) AS n_mistakes, least(count(*) FILTER (WHERE k IN (1, 2)) / count(*)::DOUBLE, 10.0) AS complexity FROM f GROUP BY module""")
def module_rollup(s, d):
    e = B.edits(s, d).select("file_path", "conversation_id").distinct()
    return R.module_rollup(e, e.where("conversation_id % 7 = 1"), e.where("conversation_id % 7 = 2"))


@query(f"""WITH m AS (SELECT unnest(['/src', '/src/m1', '/src/m10', '/src/m', '/none', 'src']) AS module)
SELECT m.module, count(file_path) AS n_rows, count(DISTINCT file_path) AS n_paths FROM m LEFT JOIN {EDITS} e ON starts_with(e.file_path, m.module || '/') GROUP BY m.module""")
def module_containment(s, d):
    m = s.createDataFrame([(x,) for x in ("/src", "/src/m1", "/src/m10", "/src/m", "/none", "src")], "module string")
    return R.nested_rollup(m, B.edits(s, d))


@query("""SELECT scenario, failed, warned, CASE WHEN failed > 0 THEN greatest(0, 50 - 25 * failed) WHEN warned > 1 THEN greatest(50, 100 - 15 * warned) ELSE 100 - 10 * warned END AS score
FROM (SELECT scenario, count(*) FILTER (WHERE scenario >= 3 AND r_regionkey >= 7 - scenario) AS failed, count(*) FILTER (WHERE r_regionkey > 0 AND r_regionkey <= scenario AND NOT (scenario >= 3 AND r_regionkey >= 7 - scenario)) AS warned FROM region, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS scenario) GROUP BY scenario)""")
def health_score(s, d):
    def one(n):
        k = F.col("r_regionkey")
        bad = (k >= 7 - n) if n >= 3 else F.lit(False)
        status = F.when(bad, "fail").when((k > 0) & (k <= n), "warn").otherwise("pass")
        return R.health(table(s, d, "region").select(F.col("r_name").alias("check"), status.alias("status"))).withColumn("scenario", F.lit(n))

    return reduce(DataFrame.unionByName, map(one, range(6)))


@query(f"""SELECT id, key, value FROM {MEMORY} WHERE context ILIKE '%brand#1_%'""")
def like_wildcards(s, d):
    return B.memory(s, d).where(P.wild("context", "brand#1_")).select("id", "key", "value")


@query(f"""SELECT c.o_orderkey AS commit_id, arg_min(c_id, (-confidence, c_id)) AS conv_id, max(confidence) AS confidence FROM (
SELECT o.o_orderkey, v.c_custkey AS c_id,
 ((CASE WHEN t BETWEEN a AND b THEN 3.0 WHEN least(abs(t - a), abs(t - b)) < 300000 THEN 2.0 WHEN least(abs(t - a), abs(t - b)) < 3600000 THEN 1.0 ELSE 0.0 END)
  + 4.0 * len(list_intersect(of, vf)) / greatest(len(of), len(vf)) + CASE WHEN ob = vb THEN 1.0 ELSE 0.0 END + 2.0 * least(len(list_filter(vk, lambda k: contains(lower(msg), k))), 3) / 3) / 10 AS confidence
FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS t, ['f' || (o_orderkey % 97), 'f' || (o_custkey % 89)] AS of, o_orderstatus AS ob, o_orderpriority AS msg FROM orders) o
JOIN (SELECT c_custkey, 820454400000 + c_custkey * 86400000 * 2 AS a, 820454400000 + c_custkey * 86400000 * 2 + 86400000 AS b, ['f' || (c_custkey % 97)] AS vf, CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS vb, ['urgent', 'high'] AS vk FROM customer) v ON true
) c WHERE confidence > 0.3 GROUP BY c.o_orderkey""")
def commit_link_best(s, d):
    o = table(s, d, "orders")
    f = lambda c, m: F.concat(F.lit("f"), (F.col(c) % m).cast("string"))
    commits = o.select(F.col("o_orderkey").alias("commit_id"), T.millis("o_orderdate").alias("timestamp"), F.array(f("o_orderkey", 97), f("o_custkey", 89)).alias("files"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("message"))
    first = F.lit(820454400000) + F.col("c_custkey") * 86400000 * 2
    convs = table(s, d, "customer").select(F.col("c_custkey").alias("conv_id"), first.alias("first_at"), (first + 86400000).alias("last_at"), F.array(f("c_custkey", 97)).alias("files"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("F").alias("branch"), F.array(F.lit("urgent"), F.lit("high")).alias("keywords"))
    return R.link_commits(commits, convs)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50""")
def json_props_extract(s, d):
    return table(s, d, "events").select("event_id", T.json_or("props", "k bigint", F.lit(None).cast("struct<k:bigint>"))["k"].alias("k")).where("k > 50")


@query(f"""SELECT user_id, event_type, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 + CASE event_type WHEN 'purchase' THEN 7 WHEN 'view' THEN 1 ELSE 3 END * 86400000::BIGINT > {NOW - 3 * 86_400_000} GROUP BY ALL""")
def events_ttl_live(s, d):
    ttl = F.when(F.col("event_type") == "purchase", 7).when(F.col("event_type") == "view", 1).otherwise(3)
    e = table(s, d, "events").withColumn("expires_at", T.millis("ts") + ttl * F.lit(86_400_000))
    return e.where(P.live(NOW - 3 * 86_400_000)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT a.doc_id AS doc_id, b.doc_id AS other, CASE WHEN a.p = b.p THEN 100.0 WHEN len(a.x) = len(b.x) AND len(a.x) - same = 1 THEN 80.0 ELSE same / greatest(len(a.x), len(b.x))::DOUBLE * 100 END AS likeness
FROM (SELECT doc_id, '/home/' || lang || '/' || source AS p, ['home', lang, source] AS x FROM documents) a JOIN (SELECT doc_id, '/home/' || lang || '/' || source AS p, ['home', lang, source] AS x FROM documents) b ON b.doc_id = a.doc_id + 1,
LATERAL (SELECT (CASE WHEN a.x[1] = b.x[1] THEN 1 ELSE 0 END) + (CASE WHEN a.x[2] = b.x[2] THEN 1 ELSE 0 END) + (CASE WHEN a.x[3] = b.x[3] THEN 1 ELSE 0 END) AS same)""")
def path_likeness(s, d):
    p = table(s, d, "documents").select("doc_id", F.concat(F.lit("/home/"), "lang", F.lit("/"), "source").alias("p"))
    j = p.join(p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q")), "doc_id")
    return j.select("doc_id", (F.col("doc_id") + 1).alias("other"), T.path_likeness("p", "q").alias("likeness"))


@query(f"SELECT message_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM {MESSAGES}")
def token_estimate(s, d):
    return B.messages(s, d).select("message_id", T.estimated_tokens("content").alias("tokens"))


@query(f"""WITH s AS (SELECT conv_id FROM (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id) ORDER BY t DESC, conv_id LIMIT 1),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY turn DESC) AS rank FROM conversations WHERE conv_id IN (SELECT conv_id FROM s) AND role IN ('user', 'assistant'))
SELECT role AS part, rank, CASE WHEN length(x) > 60 THEN substr(x, 1, 59) || '…' ELSE x END AS text FROM (SELECT role, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM r WHERE rank <= 3)
UNION ALL SELECT 'tool', row_number() OVER (ORDER BY n DESC, tool_name), tool_name || ' x ' || n FROM (SELECT tool_name, count(*) AS n FROM {TOOL_USES} WHERE message_id IN (SELECT turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM s)) GROUP BY tool_name ORDER BY n DESC, tool_name LIMIT 5)
UNION ALL SELECT 'error', row_number() OVER (ORDER BY timestamp DESC, rid DESC), CASE WHEN length(content) > 60 THEN substr(content, 1, 59) || '…' ELSE content END FROM (SELECT u.timestamp, r.id AS rid, r.content FROM {TOOL_USES} u JOIN {TOOL_RESULTS} r ON r.tool_use_id = u.id WHERE is_error AND message_id IN (SELECT turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM s)) ORDER BY u.timestamp DESC, r.id DESC LIMIT 5)""")
def latest_session_summary(s, d):
    c = table(s, d, "conversations")
    convs = c.groupBy("conv_id").agg(F.max("turn").alias("last_message_at")).withColumnRenamed("conv_id", "id")
    m = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"))
    return O.session_summary(O.latest_session(convs), m, B.tool_uses(s, d), B.tool_results(s, d), chars=60)


@query(f"""SELECT t.id AS tag_id, name, count(i.tag_id) AS usage_count, max(i.created_at) AS last_used, string_agg(DISTINCT item_type, ',' ORDER BY item_type) AS used_in FROM {TAGS} t JOIN {ITEMS} i ON i.tag_id = t.id GROUP BY t.id, name""")
def list_tags(s, d):
    tags, items = _tags(s, d)
    return O.list_tags(tags, items, unused=False)


@query(f"""SELECT * FROM (SELECT 'decision' AS kind, CAST(o_orderkey AS VARCHAR) AS id, epoch_us(o_orderdate) // 1000 AS timestamp, o_orderpriority AS text FROM orders WHERE contains(lower(o_orderpriority), 'high') ORDER BY timestamp DESC, o_orderkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'mistake', CAST(c_custkey AS VARCHAR), c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'high') LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'message', CAST(message_id AS VARCHAR), timestamp, content FROM {MESSAGES} WHERE contains(lower(content), 'high') ORDER BY timestamp DESC, message_id LIMIT 5)""")
def search_by_file(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), T.millis("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("decision_text"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("timestamp"), F.col("c_mktsegment").alias("what_went_wrong"))
    return O.about_file("HIGH", 5, o, c, B.messages(s, d).withColumnRenamed("message_id", "id"))


@query("""SELECT lang AS source_type, count(*) FILTER (WHERE n_chars > 5000) AS n FROM documents GROUP BY lang""")
def hits_per_source(s, d):
    x = table(s, d, "documents").withColumnRenamed("lang", "source_type")
    return O.per_source(x.where("n_chars > 5000"), x)


@query(None)
def methodology_features(s, d):
    uses = B.tool_uses(s, d).withColumn("message_id", F.col("id") % 2000)
    return O.methodologies(B.messages(s, d), uses, B.tool_results(s, d))


HITS = f"(SELECT m.message_id AS id, m.conversation_id, m.timestamp, '/proj/' || (m.conversation_id % 5) AS project_path, CASE WHEN m.conversation_id % 3 = 0 THEN 'secondary' ELSE 'primary' END AS source_type FROM {MESSAGES} m WHERE regexp_matches(lower(m.content), '\\b(fixed|wrong)\\b'))"


@query(f"""SELECT id, conversation_id, project_path, source_type, count(*) OVER (PARTITION BY source_type) AS n_in_source, (SELECT count(*) FROM {HITS}) > 35 AS has_more FROM {HITS} ORDER BY timestamp DESC, id LIMIT 25 OFFSET 10""")
def search_all_page(s, d):
    m = B.messages(s, d).withColumnRenamed("message_id", "id")
    k = F.col("conversation_id")
    c = m.select("conversation_id").distinct().select(k.alias("id"), F.concat(F.lit("/proj/"), (k % 5).cast("string")).alias("project_path"), F.lit(None).cast("string").alias("git_branch"), F.when(k % 3 == 0, "secondary").otherwise("primary").alias("source_type"))
    hits = m.where(S.match_any("content", "fixed wrong")).select("id", "conversation_id", "timestamp")
    return O.hits_page(hits, c, [F.desc("timestamp"), F.asc("id")], 25, 10).drop("timestamp", "git_branch")


@query(f"""SELECT key, project_path, CASE id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'in_progress' ELSE 'pending' END AS status FROM {MEMORY} WHERE id % 4 <> 3 AND (expires_at IS NULL OR expires_at > {NOW})""")
def pending_tasks(s, d):
    k = F.col("id") % 4
    tags = F.when(k == 0, F.array(F.lit("task"), F.lit("blocked"))).when(k == 1, F.array(F.lit("in_progress"))).when(k == 2, F.array(F.lit("task"))).otherwise(F.array(F.lit("other")))
    return M.pending_tasks(B.memory(s, d).withColumn("tags", tags), NOW).select("key", "project_path", "status")
