"""Operators and functions on small frames: the cases that the benchmark tables do not hold."""

import random
import re
import math

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T
from sessionloom.functions import vectors as V
from sessionloom.operators import chunking as C
from sessionloom.operators import maintenance
from sessionloom.operators import memory as M
from sessionloom.operators import relational as R
from sessionloom.operators import search as S
from sessionloom.operators.extract import facts as X

NOW = 1_706_745_600_000



def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        bad.select(V.cosine(F.col("a"), F.col("b"))).collect()
    unit = spark.range(1).select(V.hashed_embedding(T.tokens(F.lit("one two two")))).first()[0]
    assert math.isclose(sum(x * x for x in unit), 1.0)
    assert spark.range(1).select(V.hashed_embedding(T.tokens(F.lit("")))).first()[0] == [0.0] * 64


def test_fusion(spark):
    v = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    t = spark.createDataFrame([(3, 1), (4, 2)], "id long, rank int")
    got = {r["id"]: r["score"] for r in S.reciprocal_rank_fusion(v, t, 10).collect()}
    assert got[3] == pytest.approx((0.7 / 63 + 0.3 / 61) * 1.2) and got[1] == pytest.approx(0.7 / 61) and got[4] == pytest.approx(0.3 / 62)
    empty = S.reciprocal_rank_fusion(v.limit(0), t.limit(0), 10)
    assert empty.count() == 0


def test_fts(spark):
    d = spark.createDataFrame([(1, "Fix the API Endpoint"), (2, "the end"), (3, None)], "id long, text string")
    ids = lambda c: sorted(r["id"] for r in d.where(c).collect())
    assert ids(S.match_all("text", "api THE")) == [1] and ids(S.match_any("text", "api end")) == [1, 2]
    assert ids(S.match_phrase_prefix("text", "api end")) == [1] and ids(S.match_all("text", "  ")) == []
    assert [r["id"] for r in S.bm25(d, "the", 5).collect()] == [2, 1]
    assert S.bm25(d, "", 5).count() == 0
    assert S.first_nonempty(d.limit(0), d).count() == 3


def test_near_repeats(spark):
    d = spark.createDataFrame([(1, 0.9, "alpha beta gamma"), (2, 0.8, "alpha beta gamma"), (3, 0.7, "delta epsilon"), (4, 0.6, ""), (5, 0.5, "")], "id long, similarity double, content string")
    assert sorted(r["id"] for r in S.without_near_repeats(d, 10).collect()) == [1, 3, 4]


def test_predicates(spark):
    d = spark.createDataFrame([("100% done", ["a", "b"], None, None), ("1000 done", ["a"], NOW + 1, True), (None, None, NOW - 1, False)], "t string, tags array<string>, expires_at long, archived boolean")
    n = lambda c: d.where(c).count()
    assert n(P.contains("t", "100%")) == 1 and n(P.wild("t", "100%")) == 2
    assert n(P.any_tag("tags", ["b", "c"])) == 1 and n(P.all_tags("tags", ["a", "b", "a"])) == 1
    assert n(P.live(NOW)) == 2 and n(P.unset("archived")) == 2
    assert n(P.has_path(F.array(F.lit("/A/b.ts")), "/a/B.ts")) == 3
    assert P.dynamic_threshold(3) == pytest.approx(0.33) and P.dynamic_threshold(100) == 0.55


def test_text(spark):
    s = lambda e: spark.range(1).select(e).first()[0]
    assert s(T.estimated_tokens(F.lit("abcd"))) == 1 and s(T.estimated_tokens(F.lit("`abcdefg`"))) == math.ceil(9 / 3.5)
    assert s(T.truncated(F.lit("abcdef"), 3)) == "abc... (truncated)" and s(T.preview(F.lit(" a \n b  c"), 4)) == "a b…"
    assert s(T.path_likeness(F.lit("/a/b/c"), F.lit("/a/x/c"))) == 80 and s(T.path_likeness(F.lit("/a/b"), F.lit("/a/b"))) == 100
    assert s(T.path_likeness(F.lit("/a/b/c/d"), F.lit("/a/b"))) == 50
    assert s(T.iso(F.lit(1_706_745_600_123))) == "2024-02-01T00:00:00.123Z"
    assert s(T.human_bytes(F.lit(2048))) == "2.0 KB" and s(T.jaccard(F.array(), F.array())) == 1.0
    assert s(T.json_or(F.lit("{bad"), "a int", F.struct(F.lit(1).alias("a"))))["a"] in (1, None)


def tokens_of(t):
    code = sum(map(len, re.findall(r"(?s)```.*?```|`[^`]+`", t)))
    return math.ceil(code / 3.5 + (len(t) - code) / 4)


def packed_by_hand(text, chunk, carry, hard):
    """Chunks (start, end) of sentences, sentence by sentence."""
    units = []
    for s in re.findall(r"(?s)```.*?(?:```|\Z)\s*|.+?(?:[.!?](?=\s|\Z)\s*|\n+|(?=```)|\Z)", text):
        n = int(hard * 3.5) if "`" in s else hard * 4
        units += [s] if tokens_of(s) <= hard else re.findall(rf"(?s).{{1,{n}}}(?:\s+|\Z)|.{{1,{n}}}", s)
    out, own, at = [], [], 0
    for u in units:
        if own and sum(t for _, t in own) + tokens_of(u) > chunk - carry:
            out.append((own[0][0], at))
            tail = []
            for x in own[:0:-1]:
                if sum(t for _, t in tail) + x[1] > carry:
                    break
                tail.insert(0, x)
            own = tail if sum(t for _, t in tail) + tokens_of(u) <= chunk else []
        own.append((at, tokens_of(u)))
        at += len(u)
    return out + ([(own[0][0], at)] if own else [])


def windows_by_hand(text, chunk, overlap):
    code = sum(map(len, re.findall(r"(?s)```.*?```|`[^`]+`", text)))
    window = math.floor(chunk * (4 - 0.5 * code / len(text)))
    step = window - math.floor(window * overlap)
    half, at, out = step // 2, 0, []

    def edge(p):
        k = next((k for k in range(p, p - half, -1) if text[k - 1].isspace()), p)
        return k

    while at < len(text):
        end = len(text) if at + window >= len(text) else edge(at + window)
        out.append((at, end))
        if end == len(text):
            break
        at = edge(at + step)
    return out


def test_chunks(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice(["word ", "longer words ", "stop. ", "why? ", "\n", "`code` ", "```x = 1\ny```\n", "é "]) for _ in range(n))
    texts = ["One sentence here. " * 200 + "v1. no end\nlast line", "short", None, "x" * 9000, "", "word " * 3000, *[prose(rng.randint(300, 900)) for _ in range(12)]]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for chunk, overlap, strategy in ((450, 0.1, "sentence"), (60, 0.4, "paragraph"), (60, 0.0, "sentence"), (450, 0.1, "sliding_window"), (50, 0.5, "sliding_window")):
        got = {}
        for r in C.chunks(d, "id", "text", chunk, overlap, strategy, hard_max=chunk + 50).orderBy("message_id", "chunk_index").collect():
            got.setdefault(r["message_id"], []).append(r)
        for i, t in enumerate(texts):
            t = t or ""
            spans = [(r["start"], r["end"]) for r in got[i]]
            want = [(0, len(t))] if tokens_of(t) <= chunk else windows_by_hand(t, chunk, overlap) if strategy == "sliding_window" else packed_by_hand(t, chunk, int(chunk * overlap), chunk + 50)
            assert spans == want, (i, chunk, strategy)
            assert all(r["content"] == t[r["start"] : r["end"]] and r["total_chunks"] == len(spans) for r in got[i])
            assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(a[1] >= b[0] > a[0] for a, b in zip(spans, spans[1:]))
    for bad in ({"strategy": "x"}, {"overlap": 1.0}, {"chunk_tokens": 0}):
        with pytest.raises(ValueError):
            C.chunks(d, "id", "text", **bad)
    w = spark.createDataFrame([("abcdefghij",)], "t string").select(C.sliding_windows("t", 4, 1)).first()[0]
    assert [x["content"] for x in w] == ["abcd", "defg", "ghij"]


def snippet_by_hand(text, query, window=200, step=10):
    """Every window against every hit."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if len(t) >= 2 and t not in C.STOP_WORDS]
    hits = [(k, k + len(t)) for t in terms for k in range(len(text)) if text.lower().startswith(t, k)]
    if not hits:
        if len(text) <= window:
            return text
        end = max((k for k in range(1, window + 1) if text[k].isspace()), default=window)
        return text[:end].strip() + "..."
    a, b = 0, len(text)
    if len(text) > window:
        def score(s):
            e = s + window
            return sum(2 if x >= s and y <= e else 1 if x < e and y > s else 0 for x, y in hits) + (0.5 if s == 0 or re.search(r"[.!?]\s*$", text[max(0, s - 5) : s]) else 0)
        a = max(range(0, len(text) - window + 1, step), key=lambda s: (score(s), -s))
        b = a + window
        a = max((k for k in range(1, a + 1) if text[k - 1].isspace()), default=0) if a else 0
        b = min((k for k in range(b, len(text)) if text[k].isspace()), default=len(text))
    shown = text[a:b].strip()
    for t in ["|".join(map(re.escape, sorted(terms, key=len, reverse=True)))]:
        shown = re.sub(t, lambda m: f"**{m[0]}**", shown, flags=re.I)
    return ("..." if a > 0 else "") + shown + ("..." if b < len(text) else "")


def test_snippet_and_expansion(spark):
    rng = random.Random(4)
    text = "filler words " * 40 + "the cache was slow " + "more filler " * 40
    words = ["cache", "Cached", "slow.", "the", "a", "end!", "filler", "longerwordsthanthat", "\n", "x" * 30]
    texts = [text, "", None, "the cache", "no hits at all " * 30, "y" * 500, *[" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(40)]]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for query in ("cache slow", "the of a", "", "CACHE cached slow cache", "end! x"):
        got = {r["i"]: r["s"] for r in d.select("i", C.snippet("t", query).alias("s")).collect()}
        assert got == {i: snippet_by_hand(t or "", query) for i, t in enumerate(texts)}, query
    assert "**cache** was **slow**" in d.where("i = 0").select(C.snippet("t", "cache slow")).first()[0]
    assert C.expansions("api error") == ["api error", "endpoint error", "interface error", "service error"]
    assert C.expansions("zzz", {"zzz": ["y"]}) == ["zzz", "y"]


def test_containment(spark):
    """Modules hold a path at any depth, by whole parts of it."""
    paths = ["/a/b/c.ts", "/a/b.ts", "/ab/c.ts", "a/b/c.ts", "c.ts", "/c.ts", "", None, "/a/b/c.ts"]
    modules = ["/a", "/a/b", "/ab", "a", "a/b", "/none", "/"]
    f, m = spark.createDataFrame([(p,) for p in paths], "file_path string"), spark.createDataFrame([(x,) for x in modules], "module string")
    got = {r["module"]: (r["n_rows"], r["n_paths"]) for r in R.nested_rollup(m, f).collect()}
    under = {x: [p for p in paths if p and p.startswith(x + "/")] for x in modules}
    assert got == {x: (len(u), len(set(u))) for x, u in under.items()}


def test_memory(spark):
    empty = spark.createDataFrame([], "project_path string, key string, value string, created_at long, updated_at long, expires_at long")
    items = spark.createDataFrame([("/p", "a", "1", 0), ("/p", "b", "it's 😀", 10), ("/p", "c", "3", -1)], "project_path string, key string, value string, ttl int")
    m = M.remember(empty, items, NOW)
    got = {r["key"]: r["expires_at"] for r in m.collect()}
    assert got == {"a": None, "b": NOW + 10_000, "c": NOW - 1000}
    assert M.sweep(m, NOW).count() == 2
    assert M.forget(m, spark.createDataFrame([("/p", "a")], "project_path string, key string")).count() == 2
    q = m.withColumns({"confidence": F.lit("likely"), "verified_at": F.lit(None).cast("long")})
    r = {x["key"]: x for x in M.set_quality(q, F.col("key") == "a", NOW + 5, confidence="verified").collect()}
    assert r["a"]["verified_at"] == NOW + 5 and r["b"]["confidence"] == "likely"


def test_handoff(spark):
    d = spark.createDataFrame([("use x", 2), ("use y", 1)], "decision_text string, timestamp long")
    f = spark.createDataFrame([("/a", 1)], "file_path string, timestamp long")
    m = spark.createDataFrame([("k", "v", 3)], "key string, value string, updated_at long")
    r = M.handoff(d, f, m.limit(0), m).first()
    assert [x["decision_text"] for x in r["decisions"]] == ["use x", "use y"] and r["tasks"] == [] and r["memory"][0]["value"] == "v"


def test_budget(spark):
    d = spark.createDataFrame([(i, 0 if i == 3 else 1, i, 4) for i in range(6)], "id long, priority int, timestamp long, tokens long")
    got = [r["id"] for r in M.within_budget(d, 10).orderBy("used").collect()]
    assert got == [3, 5]
    assert M.within_budget(d, 0).count() == 0


def test_decisions(spark):
    rows = [
        (1, 1, "assistant", "Let me summarize: we decided to use x because y.", 1),
        (2, 1, "assistant", "We rejected mongo because it is slow. Decision: use sqlite\nRationale: simple\nAlternatives: mongo, redis", 2),
        (3, 1, "user", "don't use jest, use vitest for the component", 3),
        (4, 1, "user", "don't use jest, use vitest", 4),
        (5, 1, "assistant", None, 5),
    ]
    m = spark.createDataFrame(rows, "message_id long, conversation_id long, role string, content string, timestamp long")
    got = X.decisions(m).collect()
    assert {r["message_id"] for r in got} == {2, 3}
    fix = next(r for r in got if r["is_correction"])
    assert fix["decision_text"].startswith("Use vitest") and fix["decision_text"].endswith("instead of jest") and fix["score"] >= 10
    block = next(r for r in got if r["rationale"] == "simple")
    assert block["alternatives"] == ["mongo", "redis"]
    again = X.decisions(m).collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}


def test_segments(spark):
    rows = [(1, "user", "help me fix the build."), (2, "assistant", "looking"), (3, "assistant", "It is fixed"), (4, "assistant", "idle"), (5, "user", "let's add a test."), (6, "user", "can you update docs."), (7, "assistant", "hmm")]
    m = spark.createDataFrame([(i, 1, r, c, i) for i, r, c in rows], "message_id long, conversation_id long, role string, content string, timestamp long")
    got = [(r["start_message_id"], r["end_message_id"], r["n_messages"], r["outcome"]) for r in X.methodology_segments(m).orderBy("start_message_id").collect()]
    assert got == [(1, 3, 3, "success"), (6, 7, 2, "open")]


def test_error_rules(spark):
    d = spark.createDataFrame([("exit code 1\nsomething odd",), ("a\nfatal: no such file or directory: x",), ("",)], "t string")
    assert [r[0] for r in d.select(X.error_summary("t")).collect()] == ["something odd", "fatal: no such file or directory: x", "Unknown error"]
    e = spark.createDataFrame([("error: disk is full\ncannot open the file",), ("fine",)], "t string").select(X.live_errors("t")).collect()
    assert len(e[0][0]) == 2 and e[1][0] == []
    s = spark.createDataFrame([("logic_error", None, False, 0), ("misunderstanding", None, False, 0), ("tool_error", "x", True, 1)], "mistake_type string, correction string, is_user boolean, n_files int")
    assert [r[0] for r in s.select(X.severity()).collect()] == [3, 0, 8]


def test_validator(spark):
    d = spark.createDataFrame([("Use redis as the cache for sessions", "we Use redis as the cache for sessions now"), ("ok", "ok"), ("session summary: we use many tools here", ""), ("Use redis as the cache for sessions", "nothing")], "t string, src string")
    got = [(round(r[0], 4), r[1]) for r in d.select(X.decision_confidence("t", "src"), X.decision_valid("t", "src")).collect()]
    assert got[0] == (1.0, True) and not got[1][1] and not got[2][1] and got[3] == (0.6, True)


def test_paging_and_links(spark):
    d = spark.range(5)
    assert [r["has_more"] for r in R.page(d, [F.asc("id")], 2, 2).collect()] == [True, True]
    assert [r["has_more"] for r in R.page(d, [F.asc("id")], 2, 3).collect()] == [False, False]
    commits = spark.createDataFrame([(1, 1000, ["a"], "main", "add cache"), (2, 10**10, ["z"], "dev", "x")], "commit_id long, timestamp long, files array<string>, branch string, message string")
    convs = spark.createDataFrame([(7, 0, 2000, ["a", "b"], "main", ["cache"]), (8, 0, 2000, ["q"], "dev", ["x"])], "conv_id long, first_at long, last_at long, files array<string>, branch string, keywords array<string>")
    got = R.link_commits(commits, convs).collect()
    assert [(r["commit_id"], r["conv_id"]) for r in got] == [(1, 7)] and got[0]["confidence"] == pytest.approx((3 + 2 + 1 + 2 / 3) / 10)


def test_maintenance(spark):
    m = spark.createDataFrame([(1, 10, "about redis"), (2, 11, "other")], "id long, conversation_id long, content string")
    assert [r[0] for r in maintenance.about(m, "Redis").collect()] == [10]
    t = maintenance.storage_stats(messages=m).first()
    assert (t["table"], t["n"], t["oldest"]) == ("messages", 2, None)
    assert R.health(spark.createDataFrame([("a", "fail")], "check string, status string")).first()["score"] == 25


def test_settings_and_models(spark):
    from sessionloom import settings as G

    assert G.settings(spark) == G.Settings()
    spark.conf.set("spark.sessionloom.rrf_k", "10")
    spark.conf.set("spark.sessionloom.chunk_overlap", "2")
    s = G.settings(spark)
    assert s.rrf_k == 10 and s.chunk_overlap == 0.1 and s.fts_weight == pytest.approx(0.3)
    spark.conf.unset("spark.sessionloom.rrf_k")
    spark.conf.unset("spark.sessionloom.chunk_overlap")
    assert G.model(spark, "all-minilm").first()["dimensions"] == 384
    assert G.model(spark, "nomic-embed-text:latest").first()["name"] == "nomic-embed-text"
    assert G.model(spark, " ").count() == 0 and G.model(spark, "none-such").count() == 0
    assert G.recommended(spark, "openai").first()["name"] == "text-embedding-3-small"
    assert G.recommended(spark, "transformers").first()["quality"] == "medium"


def test_tools(spark):
    from sessionloom.operators import tools as O

    f = spark.createDataFrame([("/a/b/c", "-a-b-c", True, 3), ("/x", "-x", False, 0)], "path string, folder string, has_db boolean, n_files long")
    got = O.old_projects(f, "/a/x/c").collect()
    assert [r["path"] for r in got] == ["/a/b/c"] and got[0]["score"] == pytest.approx(80 + 40 + 20 + 3)
    facts = spark.createDataFrame([(1, "fix the cache", 1), (2, "other", 2)], "id long, problem string, timestamp long")
    assert [r["id"] for r in O.facts_matching(facts, "the ca", ["problem"], "timestamp", 5).collect()] == [1]
    assert [r["id"] for r in O.facts_matching(facts, "zzz", ["problem"], "timestamp", 5).collect()] == [2, 1]
    tags = spark.createDataFrame([(1, "a", "/p"), (2, "b", None)], "id long, name string, project_path string")
    items = spark.createDataFrame([(1, "decision", 5, 9)], "tag_id long, item_type string, item_id long, created_at long")
    assert [r["name"] for r in O.list_tags(tags, items, scope="global").collect()] == ["b"]
    assert [r["name"] for r in O.list_tags(tags, items, unused=False).collect()] == ["a"]


def test_solutions(spark):
    text = "The fix is to use a lock in python. When you need to share state, do this:\n1. take the lock\n2. write\n```py\nwith lock:\n    pass\n```\nAvoid this when reading only. pytest passes."
    rows = [(1, 1, "assistant", text, 1), (2, 1, "user", "works perfectly, thanks", 2), (3, 2, "user", "works perfectly", 3)]
    m = spark.createDataFrame(rows, "message_id long, conversation_id long, role string, content string, timestamp long")
    r = X.solutions(m).collect()
    assert len(r) == 1
    r = r[0]
    assert r["solution_summary"] == "use a lock in python" and r["effectiveness"] == "excellent"
    assert r["solution_steps"] == ["take the lock", "write"] and r["code_pattern"].startswith("with lock")
    assert r["technology"] == ["python", "pytest"] and r["applies_when"] == "share state" and r["avoid_when"] == "reading only"


def test_knn_join_in_blocks(spark):
    """Blocks of queries change nothing, ties included."""
    rows = [(i, [float(i % 4), 1.0, float(i % 3)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 2 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = [{(r["query_id"], r["rank"], r["vec_id"]) for r in S.knn_join(vectors, queries, 3, block).collect()} for block in (1_000, 240)]
    assert got[0] == got[1] and len(got[0]) == 60
    assert S.knn_join(vectors, queries.limit(0), 3).count() == 0


def test_findings_all_matches(spark):
    """Every discovery of a message, against Python's own search; a short first match hides no later one."""
    import re

    from sessionloom.operators.extract import facts, rules

    said = ["I found that it is off. I found that the cache keeps rows of closed sessions. I noticed that the second index is never used by any query.", "This means nothing. The problem is a lock that two writers take in turn. This shows the queue was full for most of the night", "Nothing here."]
    rows = [(i, 1, "assistant", t) for i, t in enumerate(said)]
    want = {(i, m[1].strip()) for i, t in enumerate(said) for p in rules.DISCOVERIES for m in re.finditer(p.replace(r"\z", r"\Z"), t, re.I) if len(m[1].strip()) >= 20}
    got = facts.findings(spark.createDataFrame(rows, "message_id int, conversation_id int, role string, content string")).collect()
    assert sorted((r["message_id"], r["discovery"]) for r in got) == sorted(want) and len(want) == 4


def test_requirement_query_keeps_every_type(spark):
    """The unfiltered query against Python's own search over all patterns."""
    import re

    from sessionloom.operators.extract import rules
    from sessionloom.plans import bindings, retrieval

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in bindings.messages(spark, sf).select("message_id", "content").collect():
        for kind, p in rules.REQUIREMENTS:
            want |= {(r["message_id"], kind, m[1].strip(" ")[:50]) for m in re.finditer(p, r["content"] or "", re.I)}
    got = retrieval.QUERIES["requirement_extract"](spark, sf).collect()
    assert {(r["message_id"], r["type"], r["description"][:50]) for r in got} == want and want


def test_matches_keep_their_own_place(spark):
    """Places of all matches against Python's own, also where a match's words stand earlier in another match."""
    import re

    from sessionloom.functions import text as T

    texts = [None, "", "plain", "ab ab", "xaby ab", "äab😀ab ab", "ab", "ababab tail", "x" * 3000 + "ab" * 500]
    rows = [(i, t) for i, t in enumerate(texts)]
    for pattern in ("ab", "(?i)A(b)", r"(?:a(b)\s*)+", r"a(.?)\z"):
        g = 1 if "(b)" in pattern or "(.?)" in pattern else 0
        got = spark.createDataFrame(rows, "i int, t string").select("i", T.placed("t", pattern, g).alias("p")).collect()
        want = {i: [(m.start() + 1, m[0], m[g]) for m in re.finditer(pattern.replace(r"\z", r"\Z"), t or "")] for i, t in rows}
        assert {r["i"]: [tuple(x) for x in r["p"]] for r in got} == want, pattern


def test_findings_and_requirements_read_their_own_surroundings(spark):
    from sessionloom.operators.extract import facts

    columns = "message_id int, conversation_id int, role string, content string, timestamp long"
    filler = " Plain words fill the page." * 40
    said = "This means the cache holds old rows today. Maybe, possibly so." + filler + " We have confirmed and verified it. This means the cache holds old rows"
    got = {r["discovery"]: r["confidence"] for r in facts.findings(spark.createDataFrame([(1, 1, "assistant", said, 1)], columns)).collect()}
    assert got == {"the cache holds old rows today": "uncertain", "the cache holds old rows": "verified"}, got
    same = "I found that The Index is never used by queries. x. I found that the index is never used by queries."
    assert [r["discovery"] for r in facts.findings(spark.createDataFrame([(1, 1, "assistant", same, 1)], columns)).collect()] == ["The Index is never used by queries"]
    asked = "Constraint: keep logs as they are. Yes.\nConstraint: keep logs\n, since disks are small."
    r = {x["description"]: x["rationale"] for x in facts.requirements(spark.createDataFrame([(1, 1, "user", asked, 1)], columns)).collect()}
    assert r["keep logs"] == "disks are small", r


def test_matches_are_spread_and_found_once(spark):
    """Messages of one row group are dealt before they are searched; a text without a match is searched once by each pattern, one with matches once for each of its arrays."""
    from sessionloom.functions import text as T
    from sessionloom.operators.extract import facts

    m = spark.createDataFrame([(1, 1, "user", "We must support Ruby version.", 1), (2, 1, "user", None, 2), (3, 1, "user", "Nothing.", 3)], "message_id int, conversation_id int, role string, content string, timestamp long")
    for df in (facts.requirements(m), facts.findings(m)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")] and "Exchange" in plan
    assert [(r["message_id"], r["type"], r["description"]) for r in facts.requirements(m).collect()] == [(1, "compatibility", "Ruby version.")]
    one = T.placed("content", "(?i)must")
    assert str(one).count("regexp_extract_all") == 2 and "CASE WHEN" in str(one)
    assert [[tuple(x) for x in r["p"]] for r in m.orderBy("message_id").select(T.placed("content", "(?i)(must)").alias("p")).collect()] == [[(4, "must", "must")], [], []]
