"""Retrieval, chunking and extraction queries over the stand-ins, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions import vectors as V
from sessionloom.operators import chunking as C
from sessionloom.operators import embedding as E
from sessionloom.operators import relational as R
from sessionloom.operators import search as S
from sessionloom.operators.extract import facts as X
from sessionloom.operators.extract import rules
from sessionloom.operators.text_index import TextIndex
from sessionloom.sources.store import Tables

from . import bindings as B
from .bindings import MESSAGES, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _vector(s, d, vec_id: int = 0) -> list[float]:
    row = table(s, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, label, round({COS}, 6) AS similarity FROM embeddings e, {Q0} q ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_cosine_topk(s, d):
    return S.knn(table(s, d, "embeddings"), _vector(s, d), 10).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, label, round({COS}, 6) AS similarity FROM embeddings e, {Q0} q WHERE label IN (1, 3) AND {COS} >= 0.05 ORDER BY {COS} DESC, vec_id LIMIT 20")
def knn_filtered(s, d):
    return S.knn(table(s, d, "embeddings"), _vector(s, d), 20, F.col("label").isin(1, 3), 0.05).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5""")
def knn_join(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.knn_join(e, q, 5).select("query_id", "vec_id", "rank")


TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'of', 'thnt'])")
def fts_and(s, d):
    return table(s, d, "documents").where(S.match_all("text", "the OF thnt")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['thnt', 'einutz'])")
def fts_or(s, d):
    return table(s, d, "documents").where(S.match_any("text", "thnt einütz")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' '), ' of the th')")
def fts_phrase_prefix(s, d):
    return table(s, d, "documents").where(S.match_phrase_prefix("text", "of the th")).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, {TOKENS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),
h AS (SELECT doc_id, len(t) AS dl, q.q AS token, len(list_filter(t, lambda x: x = q.q)) AS tf FROM w, (SELECT unnest(['thnt', 'einutz', 'thor']) AS q) q), f AS (SELECT token, count(*) AS df FROM h WHERE tf > 0 GROUP BY token)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN f USING (token), c WHERE tf > 0 GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT 15""")
def fts_or_bm25(s, d):
    return S.bm25(table(s, d, "documents"), "thnt einütz thor", 15, "doc_id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(ORACLE["fts_or_bm25"])
def fts_indexed_bm25(s, d):
    """The same from a stored index, which is built first."""
    index = TextIndex(Tables(s, B.scratch(s), buckets=16))
    index.add(table(s, d, "documents"), "doc_id")
    return index.bm25("thnt einütz thor", 15).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['thnt']) ORDER BY n_chars DESC, doc_id LIMIT 20")
def fts_recent_candidates(s, d):
    return S.recent_candidates(table(s, d, "documents"), S.match_any("text", "thnt"), "n_chars", 20, "doc_id").select("doc_id")


FUSED = f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS} DESC, vec_id) AS r FROM embeddings e, {Q0} q), v10 AS (SELECT * FROM v WHERE r <= 30),
t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE list_has_any({TOKENS}, ['the'])), t10 AS (SELECT * FROM t WHERE r <= 30),
j AS (SELECT coalesce(v10.id, t10.id) AS id, v10.r AS vector_rank, t10.r AS fts_rank, coalesce(0.7 / (60 + v10.r), 0) + coalesce(0.3 / (60 + t10.r), 0) AS s FROM v10 FULL JOIN t10 ON v10.id = t10.id),
k AS (SELECT * FROM j ORDER BY s DESC, id LIMIT 20)
SELECT id, vector_rank, fts_rank, round(CASE WHEN vector_rank IS NOT NULL AND fts_rank IS NOT NULL THEN s * 1.2 ELSE s END, 9) AS score FROM k"""


@query(FUSED)
def hybrid_search(s, d):
    """The flagship: nearest vectors and full-text candidates, fused by rank."""
    v = S.ranked(S.knn(table(s, d, "embeddings"), _vector(s, d), 30).select(F.col("vec_id").alias("id"), "similarity"), "similarity", "id", 30)
    docs = table(s, d, "documents").where(S.match_any("text", "the")).select(F.col("doc_id").alias("id"), "n_chars")
    t = S.ranked(docs, "n_chars", "id", 30)
    return S.reciprocal_rank_fusion(v, t, 20).select("id", "vector_rank", "fts_rank", F.round("score", 9).alias("score"))


CHUNKS = "(SELECT o_custkey AS message_id, o_orderkey AS chunk_index, 'c' || o_orderkey AS content, (o_orderkey % 100) / 100.0::DOUBLE AS similarity FROM orders)"


def _chunks(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("message_id"), k.alias("chunk_index"), F.concat(F.lit("c"), k.cast("string")).alias("content"), ((k % 100) / 100).alias("similarity"))


@query(f"SELECT message_id, max(similarity) AS similarity, count(*) AS n_chunks, arg_max(content, (similarity, -chunk_index)) AS snippet, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY similarity DESC, chunk_index) AS matched_chunks FROM {CHUNKS} WHERE similarity >= 0.4 GROUP BY message_id")
def chunk_to_message_agg(s, d):
    return S.chunks_to_messages(_chunks(s, d), 0.4).withColumn("matched_chunks", F.array_join(F.col("matched_chunks").cast("array<string>"), ","))


@query(f"""WITH c AS (SELECT message_id, max(similarity) AS c FROM {CHUNKS} WHERE similarity >= 0.4 GROUP BY 1), m AS (SELECT c_custkey AS message_id, (c_custkey % 90) / 100.0::DOUBLE AS m FROM customer)
SELECT coalesce(c.message_id, m.message_id) AS message_id, CASE WHEN c IS NULL OR m > c THEN m ELSE c END AS similarity, CASE WHEN c IS NULL OR m > c THEN 'message' ELSE 'chunk' END AS origin FROM c FULL JOIN m ON c.message_id = m.message_id ORDER BY similarity DESC, message_id LIMIT 100""")
def merge_results(s, d):
    m = table(s, d, "customer").select(F.col("c_custkey").alias("message_id"), ((F.col("c_custkey") % 90) / 100).alias("similarity"))
    return S.merge_hits(S.chunks_to_messages(_chunks(s, d), 0.4), m, 100)


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda x: length(x) > 2)) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1""")
def jaccard_pairs(s, d):
    p = table(s, d, "part").select("p_partkey", T.word_set(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("w"))
    j = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v")), "p_partkey")
    return j.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(None)
def greedy_near_repeats(s, d):
    hits = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"), ((F.col("p_partkey") * 37 % 1000) / 1000).alias("similarity"))
    return S.without_near_repeats(hits, 60)


@query("""SELECT conv_id AS conversation_id, max((turn * 13 % 10) / 10.0::DOUBLE) AS similarity, count(*) AS n_hits FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def similar_sessions(s, d):
    h = table(s, d, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("conversation_id"), ((F.col("turn") * 13 % 10) / 10).alias("similarity"))
    return S.by_conversation(h)


@query("""SELECT doc_id, i AS chunk_index, s AS start, substr(text, CAST(s + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 1000 THEN 0 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) END)) AS i FROM documents), LATERAL (SELECT i * 900 AS s)""")
def chunk_sliding(s, d):
    w = table(s, d, "documents").select("doc_id", F.explode(C.sliding_windows("text", 1000, 100)).alias("w"))
    return w.select("doc_id", F.col("w.chunk_index").alias("chunk_index"), F.col("w.start").alias("start"), F.col("w.content").alias("content"))


@query(None)
def chunk_sentences(s, d):
    return C.chunks(table(s, d, "documents"), "doc_id", "text")


@query(None)
def search_snippets(s, d):
    return table(s, d, "documents").where(S.match_all("text", "the thnt")).select("doc_id", C.snippet("text", "the thnt").alias("snippet"))


@query(None)
def hashed_embeddings(s, d):
    return table(s, d, "benchmark").select("item_id", V.hashed_embedding(T.tokens("text"), 32).alias("embedding"))


@query(None)
def fitted_embeddings(s, d):
    docs = table(s, d, "documents")
    return E.embedded(docs, T.tokens("text"), E.fit(s, docs, T.tokens("text")), "embedding").select("doc_id", "embedding")


# SQL of the extraction rules, from the same patterns -----------------------------------------------------------------


def _re(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


def _any(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_re(p)})" for p in patterns) + ")"


def _group(c: str, p: str, n: int = 1) -> str:
    return f"CASE WHEN regexp_matches({c}, {_re(p)}) THEN trim(regexp_extract({c}, {_re(p)}, {n})) END"


def _label(c: str, pairs, default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, p)} THEN '{k}'" for k, p in pairs) + (f" ELSE '{default}' END" if default else " END")


def _noise(patterns: list[str]) -> str:
    return f"NOT coalesce({_any('substr(content, 1, 500)', patterns)}, false)"


# extraction --------------------------------------------------------------------------------------------------------


@query(f"""SELECT message_id, trim(regexp_extract(content, '(?i)(?:we|i)\\s+(?:decided|chose)\\s+(?:to\\s+)?(.+?)\\s+(?:because|since|due to|for)', 1)) AS decision_text, trim(regexp_extract(content, '(?i)because\\s+(.+?)\\.', 1)) AS rationale FROM {MESSAGES}
WHERE role = 'assistant' AND regexp_matches(content, '(?i)^we decided to use')""")
def decision_we_chose(s, d):
    m = B.messages(s, d)
    return X.decisions(m).where("decision_text rlike '^use Brand' and rationale is not null and size(alternatives) = 0").select("message_id", "decision_text", "rationale")


@query(None)
def decision_extract(s, d):
    return X.decisions(B.messages(s, d)).select("id", "message_id", "decision_text", "rationale", F.array_join("alternatives", "|").alias("alternatives"), "context", "is_correction", "score")


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN 2 ELSE 0 END + CASE WHEN p_size > 20 THEN 3 ELSE 0 END + CASE WHEN p_size > 30 THEN 3 ELSE 0 END + CASE WHEN p_size > 40 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 0 END AS score FROM part""")
def decision_score(s, d):
    z = F.col("p_size")
    p = table(s, d, "part").select("p_partkey", F.when(z > 10, "r").alias("rationale"), F.when(z > 20, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("alternatives"), F.when(z > 30, 1).otherwise(0).alias("n_rejected"), F.when(z > 40, 1).otherwise(0).alias("n_files"), F.when(F.col("p_partkey") % 2 == 0, "c").alias("context"), (F.col("p_partkey") % 5 == 0).alias("is_correction"))
    return p.select("p_partkey", X.decision_score().alias("score"))


CORR = "regexp_matches(content, '(?i)that''?s?\\s+(?:wrong|incorrect|a mistake)[,\\s]+(?:you should|use|the correct)') OR regexp_matches(content, '(?i)(?:you|that)\\s+(?:made|caused|introduced)\\s+(?:a|an)\\s+(?:error|bug)\\s+(?:in|with|when)')"


@query(f"""SELECT message_id, mistake_message_id FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN message_id END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY timestamp, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mistake_message_id FROM {MESSAGES}) WHERE role = 'user' AND ({CORR})""")
def mistake_user_correction_prev(s, d):
    return X.user_corrections(B.messages(s, d)).select("message_id", "mistake_message_id")


@query(f"""SELECT message_id, {_label("content", rules.MISTAKE_TYPES.items(), None)} AS mistake_type, trim(list_filter(regexp_split_to_array(content, '[.!?]'), lambda s: {_any("s", rules.ERROR_TALK)})[1]) AS what_went_wrong, first_fix AS correction
FROM (SELECT *, first_value(CASE WHEN role = 'assistant' AND {_any("content", [rules.FIXED])} THEN substr(content, 1, 500) END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY timestamp, message_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS first_fix FROM {MESSAGES} WHERE {_noise(rules.MISTAKE_NOISE)})
WHERE role = 'assistant' AND {_any("content", rules.ERROR_TALK)}""")
def mistake_next4_fix(s, d):
    return X.error_talk(B.messages(s, d)).select("message_id", "mistake_type", "what_went_wrong", "correction")


def _places(patterns: list[str]) -> str:
    """Rows of ``m`` once for each match: number of the pattern, place, match and first group."""
    one = lambda i, p: f"SELECT *, {i} AS pattern, string_split_regex(content, {_re(p)}) AS gaps, regexp_extract_all(content, {_re(p)}) AS wholes, regexp_extract_all(content, {_re(p)}, 1) AS parts FROM m"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""SELECT *, unnest(wholes) AS whole, unnest(parts) AS part, unnest(list_transform(range(1, len(wholes) + 1), lambda i: {size("gaps[1:i]")} + {size("wholes[1:i - 1]")} + 1))::BIGINT AS pos
FROM ({" UNION ALL ".join(one(i, p) for i, p in enumerate(patterns))})"""


@query(f"""WITH m AS (SELECT * FROM {MESSAGES}), h AS (SELECT *, [{", ".join(f"'{k}'" for k, _ in rules.REQUIREMENTS)}][pattern + 1] AS type, trim(part) AS description FROM ({_places([p for _, p in rules.REQUIREMENTS])})),
n AS (SELECT *, row_number() OVER (PARTITION BY message_id, type, substr(description, 1, 50) ORDER BY timestamp, pattern, pos) AS n FROM h WHERE description <> '')
SELECT message_id, type, description, coalesce({_group("whole", X.REASON)}, {_group("substr(content, pos + length(whole))", chr(92) + "A[^.]*?" + X.REASON)}) AS rationale, array_to_string(list_filter({X.COMPONENTS!r}, lambda c: contains(lower(content), c)), ',') AS affects_components FROM n WHERE n = 1""")
def requirement_extract(s, d):
    return X.requirements(B.messages(s, d)).select("message_id", "type", "description", "rationale", F.array_join("affects_components", ",").alias("affects_components"))


RUNS = "(SELECT event_id, event_type = 'error' AS is_error, CASE event_id % 3 WHEN 0 THEN (event_id % 50) || ' passed, 0 failed in ' || (event_id % 900) || ' ms' WHEN 1 THEN (event_id % 40) || ' passed, ' || (event_id % 7 + 1) || ' failed in 2 s' ELSE 'ran' END AS content FROM events)"


@query(f"""SELECT event_id AS id, '' AS test_files, 'unit' AS what_was_tested, CASE WHEN is_error THEN 'error' WHEN regexp_matches(content, '\\d+ passed, 0 failed') THEN 'passed' WHEN content LIKE '%failed%' THEN 'failed' ELSE 'passed' END AS result,
CASE WHEN content LIKE '% ms' THEN CAST(event_id % 900 AS DOUBLE) WHEN content LIKE '% s' THEN 2000.0 END AS duration_ms, CAST(nullif(regexp_extract(content, '(\\d+) passed', 1), '') AS BIGINT) AS tests_passed, CAST(nullif(regexp_extract(content, '(\\d+) failed', 1), '') AS BIGINT) AS tests_failed FROM {RUNS}""")
def validation_perf(s, d):
    k = F.col("event_id")
    c = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    content = F.when(k % 3 == 0, c((k % 50).cast("string"), " passed, 0 failed in ", (k % 900).cast("string"), " ms")).when(k % 3 == 1, c((k % 40).cast("string"), " passed, ", (k % 7 + 1).cast("string"), " failed in 2 s")).otherwise("ran")
    e = table(s, d, "events")
    return X.validations(e.select(k.alias("id"), F.lit("pytest test/unit -q").alias("command")), e.select(k.alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), content.alias("content"))).withColumn("test_files", F.array_join("test_files", ","))


KEYWORD = "(" + " OR ".join(f"contains(lower(content), '{k}')" for k in rules.ACTIONABLE) + ")"


@query(f"""SELECT message_id, round(CASE WHEN length(content) < 20 THEN 0.3 ELSE 1 END * CASE WHEN {KEYWORD} THEN 1 ELSE 0.5 END * CASE WHEN regexp_matches(content, '(?i)^(yes|no|ok|okay|sure|thanks|thank you|got it)') OR regexp_matches(content, '(?i)^(hi|hello|hey)') THEN 0.1 ELSE 1 END, 6)::DOUBLE AS confidence FROM {MESSAGES}""")
def validator_confidence(s, d):
    return B.messages(s, d).select("message_id", F.round(X.decision_confidence("content"), 6).alias("confidence"))


@query(f"""WITH m AS (SELECT * FROM {MESSAGES}), h AS ({" UNION ALL ".join(f"SELECT message_id, length(content) AS size, trim(unnest(regexp_extract_all(content, {_re(p)}, 1))) AS text FROM m" for p in rules.LIVE_DECISIONS)}),
t AS (SELECT DISTINCT message_id, size, text FROM h WHERE length(text) BETWEEN 10 AND 200)
SELECT * FROM (SELECT message_id, text, least(greatest(5 + {" + ".join(f"CASE WHEN regexp_matches(text, {_re(p)}) THEN 1 ELSE 0 END" for p in rules.TECH_FAMILIES)} + CASE WHEN size > 500 THEN 1 ELSE 0 END - CASE WHEN contains(text, '?') THEN 2 ELSE 0 END, 0), 10) / 10.0::DOUBLE AS confidence FROM t) WHERE confidence > 0.5""")
def live_decision_confidence(s, d):
    return X.live_decisions(B.messages(s, d)).select("message_id", "text", "confidence")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '/tmp/x' || event_id ELSE '/src/f' || event_id END AS path, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'create' ELSE 'delete' END AS action FROM events WHERE event_type <> 'signup'""")
def live_file_ops(s, d):
    name = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write").when(F.col("event_type") == "error", "Bash").otherwise("Other")
    k = F.col("event_id").cast("string")
    u = table(s, d, "events").select(F.col("event_id").alias("id"), name.alias("name"), F.concat(F.lit("/src/f"), k).alias("file_path"), F.concat(F.lit("rm -rf -v /tmp/x"), k).alias("command"))
    return X.live_file_ops(u)


@query(f"""WITH m AS (SELECT *, coalesce(role = 'user' AND {_any("content", rules.PROBLEM_START)}, false) AS opens, coalesce(role = 'assistant' AND {_any("content", [*rules.SUCCESS, *rules.FAILURE])}, false) AS closes, coalesce(role = 'assistant' AND {_any("content", rules.SUCCESS)}, false) AS good FROM {MESSAGES}),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conversation_id ORDER BY timestamp, message_id) AS segment FROM m),
c AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY conversation_id, segment ORDER BY timestamp, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM s WHERE segment > 0)
SELECT conversation_id, arg_min(message_id, (timestamp, message_id)) AS start_message_id, arg_max(message_id, (timestamp, message_id)) AS end_message_id, count(*)::INT AS n_messages, CASE WHEN bool_or(good) THEN 'success' WHEN bool_or(closes) THEN 'failed' ELSE 'open' END AS outcome FROM c WHERE closed = 0 GROUP BY conversation_id, segment HAVING count(*) >= 2""")
def methodology_segments(s, d):
    return X.methodology_segments(B.messages(s, d))


PATHS = "'" + X.PATHS + "'"


@query(f"""WITH m AS (SELECT * FROM {MESSAGES} WHERE role = 'assistant' AND {_noise(rules.SHORT_NOISE)}), h AS (SELECT *, trim(part) AS t FROM ({_places(rules.DISCOVERIES)})),
n AS (SELECT *, row_number() OVER (PARTITION BY message_id, lower(substr(t, 1, 100)) ORDER BY pattern, pos) AS n FROM h WHERE length(t) >= 20),
a AS (SELECT *, substr(content, greatest(pos - 200, 1), pos + 400 - greatest(pos - 200, 1)) AS around FROM n WHERE n = 1)
SELECT message_id, conversation_id, substr(t, 1, 500) AS discovery, substr(coalesce({", ".join(_group("around", p) for p in rules.TOPICS)}, t), 1, 100) AS topic, {_label("around", rules.FINDING_SOURCES.items(), "code")} AS source_type,
CASE WHEN regexp_matches(around, {PATHS}) THEN regexp_extract(around, {PATHS}) WHEN regexp_matches(around, 'https?://[^\\s)]+') THEN regexp_extract(around, 'https?://[^\\s)]+') END AS source_reference,
{_label("around", [(k, rules.RELEVANCE[k]) for k in ("high", "low")], "medium")} AS relevance, {_label("around", [(k, rules.SURENESS[k]) for k in ("verified", "uncertain")], "likely")} AS confidence, array_to_string(list_sort(list_distinct(regexp_extract_all(around, {PATHS}))), ',') AS related_to FROM a""")
def research_findings(s, d):
    return X.findings(B.messages(s, d)).withColumn("related_to", F.array_join(F.array_sort("related_to"), ","))


@query(None)
def solution_patterns(s, d):
    return X.solutions(B.messages(s, d)).withColumns({c: F.array_join(c, "|") for c in ("solution_steps", "technology", "prerequisites", "applied_to_files")})


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'fatal: permission denied' ELSE 'odd line' END AS what_went_wrong FROM events WHERE event_type = 'error'")
def mistake_tool_errors(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("message_id"), (F.col("event_type") == "error").alias("is_error"), F.lit("exit code 1").alias("stderr"), F.when(F.col("event_id") % 2 == 0, "fatal: permission denied").otherwise("odd line").alias("stdout"), F.lit("").alias("content"))
    return X.tool_errors(e).select("id", "what_went_wrong")


@query(f"SELECT role, count(*) AS n FROM {MESSAGES} GROUP BY role")
def message_roles(s, d):
    return B.messages(s, d).groupBy("role").agg(F.count("*").alias("n"))


@query(f"SELECT message_id FROM {MESSAGES} WHERE NOT {_noise(rules.NOISE)}")
def noise_messages(s, d):
    from sessionloom.functions import predicates as P

    return B.messages(s, d).where(P.noise("content", rules.NOISE)).select("message_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY md5(substr(lower(text), 1, 100)) ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1""")
def signature_dedupe(s, d):
    return R.first_by_signature(table(s, d, "conversations"), [F.substring(F.lower("text"), 1, 100)], [F.asc("conv_id"), F.asc("turn")]).select("conv_id", "turn", "role")
