"""Logs of both dialects, the table store, live streaming and the facade."""

import json
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from sessionloom.api import Engine
from sessionloom.sources import session_logs as L
from sessionloom.streaming import live

NOW = 1_737_200_000_000


def record(**k):
    return json.dumps({"timestamp": "2025-01-17T10:00:00.000Z", "sessionId": "s1", **k})


def write_log(folder):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [
        record(type="user", uuid="u1", message={"role": "user", "content": "Please add a database cache"}),
        record(type="assistant", uuid="a1", parentUuid="u1", timestamp="2025-01-17T10:01:00.000Z", gitBranch="main", version="2.0", message={"role": "assistant", "content": [{"type": "text", "text": "We decided to use redis because it is fast."}, {"type": "thinking", "thinking": "hm", "signature": "x"}, {"type": "tool_use", "id": "t1", "name": "mcp__files__read", "input": {"path": "/a/b.ts"}}]}),
        record(type="user", uuid="u2", toolUseResult={"stdout": "ok", "stderr": "", "isImage": False}, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "fine", "is_error": False}, {"type": "tool_result", "tool_use_id": "none", "content": "lost"}]}),
        "",
        "{broken",
        record(type="file-history-snapshot", messageId="a1", snapshot={"timestamp": "2025-01-17T10:02:00.000Z", "trackedFileBackups": {"/a/b.ts": {"version": 2, "backupTime": "2025-01-17T10:02:00.000Z"}}}),
        record(type="assistant", message={"role": "assistant", "content": "no uuid"}),
    ]
    (folder / "s1.jsonl").write_text("\n".join(lines))


def test_dialect_a(spark, tmp_path):
    write_log(tmp_path / "p")
    p = L.parse(L.read_lines(spark, [str(tmp_path / "p")]), "/proj", NOW)
    c = p["conversations"].first()
    assert (c["external_id"], c["message_count"], c["git_branch"], c["version"]) == ("s1", 4, "main", "2.0")
    m = {r["external_id"]: r for r in p["messages"].collect()}
    assert set(m) == {"u1", "a1", "u2"} and m["a1"]["content"] == "We decided to use redis because it is fast."
    assert m["a1"]["timestamp"] - m["u1"]["timestamp"] == 60_000
    assert [r["tool_name"] for r in p["tool_uses"].collect()] == ["mcp__files__read"]
    r = p["tool_results"].collect()
    assert len(r) == 1 and r[0]["stdout"] == "ok" and r[0]["content"] == "fine"
    assert p["file_edits"].first()["backup_version"] == 2
    assert p["thinking_blocks"].first()["thinking_content"] == "hm"
    assert [(x["line_no"], x["error"]) for x in p["parse_errors"].collect()] == [(4, "not JSON")]
    assert [x["server"] for x in L.servers_used(p["tool_uses"]).collect()] == ["files"]
    left = L.without_servers(p)
    assert {x["external_id"] for x in left["messages"].collect()} == {"u1"}


def test_same_name_in_two_folders_and_merge(spark, tmp_path):
    write_log(tmp_path / "p")
    write_log(tmp_path / "q")
    paths = [str(tmp_path / "p"), str(tmp_path / "q")]
    lines = L.read_lines(spark, paths)
    assert [r["file"].split("/")[-2] for r in lines.select("file").distinct().collect()] == ["p"]
    one = L.parse(L.read_lines(spark, paths[:1]), "/proj", NOW)
    assert L.merge_parsed(one, one)["messages"].count() == 3


def test_dialect_b(spark, tmp_path):
    f = tmp_path / "2025" / "01" / "rollout-x-0198c2a4-1111-2222-3333-444455556666.jsonl"
    f.parent.mkdir(parents=True)
    rows = [{"timestamp": "2025-01-17T10:00:00Z", "type": "session_meta", "payload": {"id": "b1", "cwd": "/w", "git": {"branch": "dev"}}}, {"timestamp": "2025-01-17T10:00:01Z", "type": "response_item", "payload": {"id": "m1", "role": "user", "content": "hello"}}, {"timestamp": "2025-01-17T10:00:02Z", "type": "response_item", "payload": {"id": "m2", "role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}]
    f.write_text("\n".join(map(json.dumps, rows)))
    (f.parent / "rollout-none.jsonl").write_text(json.dumps(rows[1]))
    p = L.parse_rollouts(L.read_lines(spark, [str(tmp_path)], "rollout-*.jsonl", recursive=True), NOW)
    c = p["conversations"].collect()
    assert len(c) == 1 and c[0]["external_id"] == "b1" and c[0]["message_count"] == 2 and c[0]["git_branch"] == "dev"
    assert sorted(r["content"] for r in p["messages"].collect()) == ["a\nb", "hello"]


def test_folder_names():
    assert L.folder_name("/home/u/my.app") == "-home-u-my-app"
    assert "-home-u-my.app" in L.folder_variants("/home/u/my.app")


def test_engine(spark, tmp_path):
    write_log(tmp_path / "p")
    e = Engine(spark, str(tmp_path / "store"))
    n = e.index("/proj", [str(tmp_path / "p")], NOW)
    assert n["messages"] == 3 and n["decisions"] == 1
    assert e.index("/proj", [str(tmp_path / "p")], NOW) == n  # a second run changes nothing
    run = e.sources().first()  # nor is a text embedded again, and nobody counts the tables
    assert (run["runs"], run["embedded"], run["messages"], e.statistics()["messages"]) == (2, 3, 6, 3)
    assert e.search("redis").first()["snippet"].startswith("We decided")
    assert e.decisions("redis").count() == 1
    assert e.tool_history(name="mcp__files__read").first()["content"] == "fine"
    assert e.sessions().first()["n_messages"] == 3
    assert e.file_timeline("/A/b.ts").count() == 1
    items = spark.createDataFrame([("/proj", "k", "v", ["x"], 60), ("/proj", "z", "w", ["x"], -5)], "project_path string, key string, value string, tags array<string>, ttl int")
    e.remember(items, NOW)
    e.remember(items.where("key = 'k'").withColumn("value", F.lit("v2")), NOW + 1)
    assert [(r["key"], r["value"], r["created_at"]) for r in e.recall(NOW + 2).collect()] == [("k", "v2", NOW)]
    assert "redis" in e.report("/proj")
    assert e.forget_topic("redis") == {"conversations": 1}
    e.forget_topic("redis", str(tmp_path / "backup"), confirm=True)
    assert e.tables.read("messages").count() == 0 and e.tables.read("tool_uses").count() == 0
    left = [f for f in (tmp_path / "store").rglob("part-*") if any("redis" in str(r) for r in spark.read.parquet(str(f)).collect())]
    assert left == [] and list((tmp_path / "store" / "_staged").iterdir()) == []


def test_tables_rewrite_touched_buckets(spark, tmp_path):
    """One changed row replaces the files of its bucket and of no other; replaced and deleted rows are in no file."""
    from sessionloom.sources.store import Tables

    t = Tables(spark, str(tmp_path), buckets=8)
    files = lambda: {str(f.relative_to(tmp_path)) for f in tmp_path.rglob("part-*")}
    row = lambda rows: spark.createDataFrame(rows, "id long, v string, created_at long")
    assert t.upsert("x", row([(i, f"old{i}", 1) for i in range(100)]), ["id"]) == 100
    first = files()
    assert len(first) == 8 and t.count("x") == 100
    assert t.upsert("x", row([(7, "new", 2), (7, "new", 2)]), ["id"]) == 1
    assert len(files() - first) == 1 and len(first - files()) == 1 and t.count("x") == 100
    assert [tuple(r) for r in t.read("x").where("id = 7").collect()] == [(7, "new", 1)]
    one = t.read_keys("x", spark.createDataFrame([(7,)], "id long"))
    assert len(one.inputFiles()) == 1 and one.where("id = 7").count() == 1
    before = files()
    assert t.upsert("x", row([]), ["id"]) == 0 and files() == before
    assert t.append("x", row([(500, "more", 3)])) == 1 and before < files() and t.count("x") == 101
    assert t.upsert("x", spark.createDataFrame([(500, "int key")], "id int, v string"), ["id"]) == 1 and t.count("x") == 101
    assert t.delete("x", spark.createDataFrame([(f"old{i}",) for i in range(50)], "v string")) == 49
    said = [r["v"] for f in tmp_path.rglob("part-*") for r in spark.read.parquet(str(f)).collect()]
    assert len(said) == 52 and not {f"old{i}" for i in range(50)} & set(said)
    t.compact("x")
    assert t.count("x") == t.read("x").count() == 52 and len(files()) == 1
    late = t.version("x")
    t.clear("x")
    assert t.read("x").count() == 0 and files() == set()
    with pytest.raises(RuntimeError):  # a writer that began before
        t._commit("x", late, replace(late, number=late.number + 1))


def test_engine_facts(spark, tmp_path):
    """Everything that is indexed is found again, linked to its source, and goes with its conversation."""
    import subprocess

    said = [("user", "help me fix the login api."), ("assistant", "We decided to use redis because it is fast. I found that the session cache keeps rows of closed sessions in /src/cache.py."), ("user", "that's wrong, use postgres for the database"), ("assistant", "error: connection refused by server"), ("assistant", "The fix is to use a lock. It is fixed and done."), ("user", "we must support python 3 because the client needs it.")]
    folder = tmp_path / "p"
    folder.mkdir()
    rows = [{"type": r, "uuid": f"u{i}", "sessionId": "s1", "timestamp": f"2025-01-17T10:0{i}:00.000Z", "cwd": "/w", "message": {"role": r, "content": t}} for i, (r, t) in enumerate(said)]
    use = {"type": "assistant", "uuid": "t1", "sessionId": "s1", "timestamp": "2025-01-17T10:06:00.000Z", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "x", "name": "Bash", "input": {"command": "pytest tests/test_a.py"}}]}}
    result = {"type": "user", "uuid": "t2", "sessionId": "s1", "timestamp": "2025-01-17T10:07:00.000Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "x", "content": "1 failed in 2 s", "is_error": True}]}}
    (folder / "s1.jsonl").write_text("\n".join(map(json.dumps, [*rows, use, result])))
    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "cache.py").write_text("x\n")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True, env={"GIT_COMMITTER_DATE": "2025-01-17T10:05:00Z", "GIT_AUTHOR_DATE": "2025-01-17T10:05:00Z", "PATH": "/usr/bin:/bin:/usr/local/bin"})
    for a in (("init", "-q"), ("add", "."), ("commit", "-qm", "keep sessions in the database")):
        git(*a)
    e = Engine(spark, str(tmp_path / "store"))
    n = e.index("/proj", [str(folder)], NOW, repo=str(repo))
    assert all(n[k] >= 1 for k in ("decisions", "mistakes", "requirements", "validations", "methodologies", "research_findings", "solution_patterns")), n
    assert n["skipped_messages"] == 0
    d = e.decisions("redis").first()
    assert d["project_path"] == "/proj" and d["message_role"] == "assistant"
    assert "connection refused" in e.mistakes("connection refused").first()["what_went_wrong"] or e.mistakes("failed").count()
    r = e.requirements("client").first()
    assert r["description"].startswith("python 3") and r["rationale"] == "the client needs it" and "client" in r["affects_components"]
    assert e.validations().first()["result"] == "error" and e.validations().first()["test_files"] == ["tests/test_a.py"]
    assert e.facts("research_findings").first()["source_reference"] == "/src/cache.py"
    assert e.facts("solution_patterns").first()["solution_summary"] == "use a lock"
    assert e.facts("methodologies").count() == 1
    c = e.commits().first()
    assert c["conversation_id"] is not None and c["project_path"] == "/proj" and c["first_message"].startswith("help me")
    found, advice = e.recall_and_apply("redis database")
    assert {"decision", "commit"} <= {x["kind"] for x in found.collect()} and advice
    assert e.search("redis", by_session=True).first()["n_hits"] >= 1
    page = e.report("/proj")
    assert "## Architecture" in page and "## Quality" in page and "2025-01: " in page
    assert e.maintain(NOW).count() >= 4
    assert e.tables.migrate("/proj", "/moved")["conversations"] == 1 and e.canonical("/proj") == "/moved"
    kept = e.forget_topic("redis", str(tmp_path / "backup"), confirm=True)
    assert kept["mistakes"] >= 1 and kept["embeddings"] >= 6
    for name in ("messages", "embeddings", "chunk_embeddings", *[k for k in n if k not in ("skipped_messages",)]):
        assert e.tables.read(name).count() == 0, name
    assert e.commits().first()["conversation_id"] is None


def test_handoff_resume(spark):
    from sessionloom.operators import memory

    schema = "id string, from_session_id string, project_path string, created_at long, handoff_data string, resumed_by_session_id string, resumed_at long"
    data = json.dumps({"memory": [{"key": "k", "value": "v", "tags": ["t"]}, {"key": None}]})
    h = spark.createDataFrame([("a", "s", "/p", 1, data, None, None), ("b", "s", "/p", 2, data, "old", 5), ("c", "s", "/q", 9, "broken", None, None)], schema)
    taken = memory.resume(h, "/p")
    assert [r["id"] for r in taken.collect()] == ["a"] and [r["id"] for r in memory.resume(h, "/p", "c").collect()] == ["c"]
    marked = {r["id"]: (r["resumed_by_session_id"], r["resumed_at"]) for r in memory.mark_resumed(h, taken, "me", 7).collect()}
    assert marked == {"a": ("me", 7), "b": ("old", 5), "c": (None, None)}
    m = spark.createDataFrame([], "project_path string, key string, value string, tags array<string>, created_at long, updated_at long, expires_at long")
    assert [(r["key"], r["value"], r["expires_at"]) for r in memory.injected(m, h, 7).where("project_path = '/p'").collect()] == [("k", "v", None)]


def test_handoffs_of_the_engine(spark, tmp_path):
    """A hand-off holds what its project has, is listed until it is resumed, and is in no file once deleted."""
    folder = tmp_path / "p"
    folder.mkdir()
    say = lambda i, content, role="assistant": {"type": role, "uuid": f"u{i}", "sessionId": "s1", "timestamp": f"2025-01-17T10:0{i}:00.000Z", "message": {"role": role, "content": content}}
    use = lambda i, name, path: say(i, [{"type": "tool_use", "id": f"x{i}", "name": name, "input": {"file_path": path}}])
    rows = [say(0, "add a cache", "user"), say(1, "We decided to use redis because it is fast."), use(2, "Read", "/a/b.py"), use(3, "Edit", "/a/b.py"), use(4, "Write", "/a/c.py"), use(5, "Glob", "/a/d.py")]
    (folder / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    e = Engine(spark, str(tmp_path / "store"))
    assert e.handoffs("/proj") is None and e.handoff("x") is None and not e.delete_handoff("x")
    assert e.handoffs("/proj") is None  # nothing is stored by asking
    empty = e.hand_off("/proj", "s0", NOW - 1).first()
    assert json.loads(empty["handoff_data"])["summary"] == "Empty handoff."
    e.index("/proj", [str(folder)], NOW)
    items = spark.createDataFrame([("/proj", "k", "v", ["x"], 0), ("/proj", "t", "do it", ["task", "blocked"], 0), ("/q", "z", "w", ["task"], 0), ("/proj", "old", "w", ["task"], -5)], "project_path string, key string, value string, tags array<string>, ttl int")
    e.remember(items, NOW)
    row = e.hand_off("/proj", "s1", NOW + 1).first()
    data = json.loads(row["handoff_data"])
    assert [x["decision_text"] for x in data["decisions"]] == ["redis"] or data["decisions"][0]["decision_text"].startswith("use redis")
    assert [(f["file_path"], f["action"]) for f in data["files"]] == [("/a/c.py", "create"), ("/a/b.py", "edit")]
    assert [(x["key"], x["status"]) for x in data["tasks"]] == [("t", "blocked")]
    assert sorted((x["key"], tuple(x["tags"])) for x in data["memory"]) == [("k", ("x",)), ("t", ("task", "blocked"))]
    assert data["summary"].startswith("1 decision(s): ") and data["summary"].endswith(". 2 file(s) active: c.py, b.py. 1 pending task(s). 2 memory item(s).")
    part = json.loads(e.hand_off("/proj", "s1", NOW + 2, include=("memory",)).first()["handoff_data"])  # the latest
    assert part["decisions"] == [] and part["summary"] == "2 memory item(s)."
    assert [r["created_at"] for r in e.handoffs("/proj").collect()] == [NOW + 2, NOW + 1, NOW - 1]
    assert e.handoffs("/q").count() == 0 and e.handoffs(limit=1).first()["summary"] == "2 memory item(s)."
    assert e.handoff(row["id"]).first()["handoff_data"] == row["handoff_data"]
    e.tables.delete("working_memory", items.select("project_path", "key"))
    assert e.resume("/proj", "s2", NOW + 3, row["id"]).count() == 1
    assert sorted(r["key"] for r in e.recall(NOW + 4, project="/proj").collect()) == ["k", "t"]
    assert row["id"] not in [r["id"] for r in e.handoffs("/proj").collect()]
    assert (row["id"], "s2") in [(r["id"], r["resumed_by_session_id"]) for r in e.handoffs("/proj", resumed=True).collect()]
    assert e.delete_handoff(row["id"]) and not e.delete_handoff(row["id"])
    left = [f for f in (tmp_path / "store" / "session_handoffs").rglob("part-*") if any(r["id"] == row["id"] for r in spark.read.parquet(str(f)).collect())]
    assert left == [] and e.handoffs("/proj", resumed=True).count() == 2


def test_search_of_all_projects(spark, tmp_path):
    """Pages of hits say where each is from; filters come before the page and the counts."""
    e = Engine(spark, str(tmp_path / "store"))
    for p in ("one", "two"):
        (tmp_path / p).mkdir()
        say = [("user", "please add a database cache"), ("assistant", f"We decided to use redis{p} because the database is slow."), ("assistant", "That's wrong, /a/b.py has a bug. Error: the database failed to start."), ("user", "that's wrong, use postgres for the database")]
        rows = [{"type": r, "uuid": f"{p}{i}", "sessionId": p, "timestamp": f"2025-01-17T10:0{i}:00.000Z", "message": {"role": r, "content": t}} for i, (r, t) in enumerate(say)]
        edit = {"type": "file-history-snapshot", "messageId": f"{p}1", "sessionId": p, "timestamp": "2025-01-17T10:05:00.000Z", "snapshot": {"timestamp": "2025-01-17T10:02:00.000Z", "trackedFileBackups": {"/a/b.py": {"version": 2, "backupTime": "2025-01-17T10:02:00.000Z"}}}}
        (tmp_path / p / f"{p}.jsonl").write_text("\n".join(map(json.dumps, [*rows, edit])))
        e.index(f"/{p}", [str(tmp_path / p)], NOW)
    every = e.search_all("database", 50).collect()
    assert {r["project_path"] for r in every} == {"/one", "/two"} and not every[0]["has_more"]
    assert {r["n_in_source"] for r in every} == {len(every)} and {r["source_type"] for r in every} == {"primary"}
    page = e.search_all("database", 2, 1).collect()
    assert [r["id"] for r in page] == [r["id"] for r in every[1:3]] and page[0]["has_more"]
    assert e.search_all("database", source="secondary").count() == 0
    first = min(r["timestamp"] for r in every)
    assert {r["timestamp"] for r in e.search_all("database", until=first).collect()} == {first}
    made = e.all_decisions("redis").collect()
    assert {r["project_path"] for r in made} == {"/one", "/two"} and e.all_decisions("redis", limit=1).first()["has_more"]
    wrong = e.all_mistakes("database").collect()
    assert wrong and {r["n_in_source"] for r in wrong} == {len(wrong)}
    assert e.all_mistakes("database", kind="none such").count() == 0
    known = e.check_before_modify("/A/b.py").collect()
    assert [r["detail"] for r in known if r["kind"] == "edit"] == ["/a/b.py"] * 2
    assert len([r for r in e.check_before_modify("/A/b.py", 1).collect() if r["kind"] == "edit"]) == 1
    assert e.check_before_modify("/no/file").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from sessionloom import __main__ as cli

    write_log(tmp_path / "p")
    run = lambda *words: (cli.main([str(tmp_path / "store"), *words, "--now", str(NOW)]), capsys.readouterr().out)[1]
    assert "'messages': 3" in run("index", str(tmp_path / "p"), "--project", "/proj")
    assert "'messages': 3" in run("status")
    assert run("handoffs") == "none\n"
    for words, told in ((("all", "redis"), "We decided"), (("check", "/a/b.ts"), "edit"), (("sources",), "sessions")):
        assert told in run(*words), words


def test_project_ids(spark):
    from sessionloom.operators import relational as R

    paths = spark.createDataFrame([("/a",), ("/old",), ("/new",)], "project_path string")
    projects = spark.createDataFrame([("p1", "/a"), ("p2", "/b")], "id string, canonical_path string")
    aliases = spark.createDataFrame([("/old", "p2"), ("/a", "p9")], "alias_path string, project_id string")
    got = {r["project_path"]: (r["found_by"], r["project_id"]) for r in R.project_ids(paths, projects, aliases).collect()}
    assert got["/a"] == ("canonical", "p1") and got["/old"] == ("alias", "p2") and got["/new"][0] == "new" and len(got["/new"][1]) == 64


def test_tag_operations(spark):
    from sessionloom.operators import maintenance, memory

    tags = spark.createDataFrame([(1, "x", "/p", 0), (2, "y", "/p", 0), (3, "x", None, 0)], "id long, name string, project_path string, updated_at long")
    links = spark.createDataFrame([(1, "d", 10, 5), (2, "d", 10, 4), (2, "m", 11, 3)], "tag_id long, item_type string, item_id long, created_at long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    t, k = memory.rename_tag(tags, links, "x", "z", 9, "/p")
    assert {(r["id"], r["name"]) for r in t.collect()} == {(1, "z"), (2, "y"), (3, "x")} and rows(k) == rows(links)
    t, k = memory.rename_tag(tags, links, "y", "x", 9, "/p")  # the name is there: links move
    assert {r["id"] for r in t.collect()} == {1, 3} and rows(k) == [(1, "d", 10, 4), (1, "m", 11, 3)]
    with pytest.raises(ValueError):
        memory.delete_tag(tags, links, 1)
    assert memory.delete_tag(tags, links, 1, force=True)[1].count() == 2
    items = spark.createDataFrame([("d", 10), ("d", 12)], "item_type string, item_id long")
    assert rows(memory.tag_items(links, items, [1], 8)) == [(1, "d", 10, 5), (1, "d", 12, 8), (2, "d", 10, 4), (2, "m", 11, 3)]
    assert rows(memory.untag_items(links, items, [2])) == [(1, "d", 10, 5), (2, "m", 11, 3)]
    found = memory.tagged(links, tags, ["x", "y"], False)
    assert rows(memory.tag_breakdown(found)) == [("x", 1), ("y", 2)]
    facts = spark.createDataFrame([(10, "a"), (12, "b"), (13, "c")], "id long, value string")
    kept, moved = maintenance.merge_duplicates(facts, links, 12, [10], "d", strategy="merge_content")
    assert rows(kept) == [(12, "b\na"), (13, "c")] and (1, "d", 12, 5) in rows(moved)


def test_budget_with_free_items(spark):
    """Against a running sum in Python; items without tokens cost nothing."""
    import random

    from sessionloom.operators import memory

    rng = random.Random(1)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 5), rng.choice([0, 0, 1, 3, 8])) for i in range(80)]
    for budget in (0, 1, 10, 60, 1000):
        used, want = 0, {}
        for i, _, _, n in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
            used += n
            if used > budget:
                break
            want[i] = used
        df = spark.createDataFrame(rows, "id long, priority int, timestamp long, tokens int")
        assert {r["id"]: r["used"] for r in memory.within_budget(df, budget).collect()} == want, budget


def test_link_commits_against_all_pairs(spark):
    import random

    from sessionloom.operators import relational as R

    rng = random.Random(3)
    files = [f"f{i}" for i in range(6)]
    hour = 3_600_000
    commits = [(i, rng.randrange(40) * hour // 3, rng.sample(files, rng.randint(0, 3)), rng.choice("ab"), rng.choice(["Fix db", "api", ""])) for i in range(40)]
    convs = [(i, s := rng.randrange(40) * hour // 3, s + rng.randrange(3) * hour, rng.sample(files, rng.randint(0, 3)), rng.choice("ab"), rng.sample(["db", "API", "x"], rng.randint(0, 2))) for i in range(30)]

    def score(c, v):
        gap = min(abs(c[1] - v[1]), abs(c[1] - v[2]))
        time = 3 if v[1] <= c[1] <= v[2] else 2 if gap < hour / 12 else 1 if gap < hour else 0
        shared = len(set(c[2]) & set(v[3]))
        if not time and not shared:
            return 0.0
        return (time + (4 * shared / max(len(c[2]), len(v[3])) if c[2] and v[3] else 0) + (c[3] == v[4]) + 2 * min(sum(k.lower() in c[4].lower() for k in v[5]), 3) / 3) / 10

    want = {}
    for c in commits:
        best = min(((-round(score(c, v), 9), v[0]) for v in convs))
        if -best[0] > 0.3 + 1e-9:
            want[c[0]] = (best[1], -best[0])
    got = R.link_commits(spark.createDataFrame(commits, "commit_id long, timestamp long, files array<string>, branch string, message string"), spark.createDataFrame(convs, "conv_id long, first_at long, last_at long, files array<string>, branch string, keywords array<string>")).collect()
    assert {r["commit_id"]: r["conv_id"] for r in got if r["confidence"] > 0.3 + 1e-9} == {k: v[0] for k, v in want.items()}


def test_live_stream(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    rows = [{"type": "message", "role": "assistant", "content": "We should adopt a python api for this. It ran."}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/a/b.ts"}}, {"type": "message", "role": "assistant", "content": "error: connection refused by host"}]
    (folder / "1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad")
    for _ in range(2):  # the second run has nothing new
        q = live.remember_live(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "ck"), "/proj", NOW)
        assert q.awaitTermination(120)
    from sessionloom.sources.store import Tables

    got = {r["tags"][0]: r["value"] for r in Tables(spark, str(tmp_path / "s")).read("working_memory").collect()}
    assert got["file"] == "edit /a/b.ts" and "adopt a python api" in got["decision"] and "connection refused" in got["error"]


def test_tail_source(spark, tmp_path):
    from sessionloom.streaming.tail import TailSource

    spark.dataSource.register(TailSource)
    f = tmp_path / "t" / "a.jsonl"
    f.parent.mkdir()
    f.write_text("one\ntwo\nhalf")
    q = spark.readStream.format("session_tail").option("folder", str(f.parent)).load().writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        with f.open("a") as out:
            out.write(" now\nthree\n")
        q.processAllAvailable()
        got = [(r["start"], r["line"]) for r in spark.sql("select * from tail order by start").collect()]
    finally:
        q.stop()
    assert got == [(0, "one"), (4, "two"), (8, "half now"), (17, "three")]


def test_tail_ranges(tmp_path, monkeypatch):
    """Parts of any size give each line once."""
    from sessionloom.streaming import tail

    f = tmp_path / "a.jsonl"
    lines = ["x" * n for n in (0, 1, 5, 17, 2, 0, 40, 3)]
    f.write_text("\n".join(lines) + "\nrest")
    for size in (1, 2, 7, 16, 1000):
        monkeypatch.setattr(tail, "PART_BYTES", size)
        monkeypatch.setattr(tail, "LOOK_BYTES", 3)
        r = tail._Reader(str(tmp_path), "*.jsonl")
        end = r.latestOffset()
        assert [x[2] for p in r.partitions({}, end) for x in r.read(p)] == lines
        assert r.partitions(end, end) == []


def test_tail_restart(tmp_path, monkeypatch):
    """What a restart finds: an unreadable file keeps the place that the checkpoint has, a rotated or cut file is read anew, an appended one goes on."""
    from sessionloom.streaming import tail

    names = ("same", "grown", "rotated", "cut", "locked", "rewritten")
    f = {n: tmp_path / f"{n}.jsonl" for n in names}
    for n in names:
        f[n].write_text(f"{n} one\n{n} two\n")
    start = json.loads(json.dumps(tail._Reader(str(tmp_path), "*.jsonl").latestOffset()))
    (tmp_path / "ck" / "offsets").mkdir(parents=True)
    (tmp_path / "ck" / "offsets" / "9").write_text("old")
    (tmp_path / "ck" / "offsets" / "10").write_text("v1\n{}\n" + json.dumps(start))
    with f["grown"].open("a") as out:
        out.write("grown three\n")
    f["rotated"].rename(tmp_path / "rotated.1")
    f["rotated"].write_text("rotated anew, and longer than before it was\n")
    f["cut"].write_text("cut\n")
    f["rewritten"].write_text("REWRITTEN one\nrewritten two\nthree\n")
    whole = tail.complete_bytes
    monkeypatch.setattr(tail, "complete_bytes", lambda p: None if "locked" in p else whole(p))
    r = tail._Reader(str(tmp_path), "*.jsonl", str(tmp_path / "ck"))
    end = r.latestOffset()
    got = sorted(x[2] for p in r.partitions(start, end) for x in r.read(p))
    assert got == ["REWRITTEN one", "cut", "grown three", "rewritten two", "rotated anew, and longer than before it was", "three"]
    assert tail._Reader(str(tmp_path), "*.jsonl").latestOffset().get(str(f["locked"])) is None  # without the checkpoint its place is not known
    monkeypatch.setattr(tail, "complete_bytes", whole)
    with f["locked"].open("a") as out:
        out.write("locked three\n")
    after = r.latestOffset()
    assert [x[2] for p in r.partitions(end, after) for x in r.read(p)] == ["locked three"]


def test_rested_files_fire_once(spark, tmp_path):
    """A file that keeps changing is given out once, when it rests."""
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    changes = spark.readStream.schema("path string").json(str(folder))
    say = lambda k, *paths: (folder / f"{k}.json").write_text("\n".join(json.dumps({"path": p}) for p in paths))
    said = lambda: sorted((r["path"], r["changes"]) for r in spark.sql("select * from rested").collect())
    say(0, "a", "b")
    q = live.rested(changes, quiet_ms=8_000).writeStream.format("memory").queryName("rested").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        for k in (1, 2):
            while time.time() < until and sum(p["numInputRows"] for p in q.recentProgress) < k + 1:
                time.sleep(0.2)
            say(k, "a")
        while time.time() < until and len(said()) < 2:
            time.sleep(0.5)
        time.sleep(2)
        got = said()
    finally:
        q.stop()
    assert got == [("a", 3), ("b", 1)]


def test_live_stream_reads_the_clock(spark, tmp_path):
    """Facts of a later batch are dated by that batch."""
    from sessionloom.sources.store import Tables

    folder = tmp_path / "live"
    folder.mkdir()
    ticks = iter(range(NOW, NOW + 10**9, 1000))
    seen = []
    for k in range(2):
        (folder / f"{k}.jsonl").write_text(json.dumps({"type": "tool_use", "name": "Edit", "input": {"file_path": f"/a/{k}.ts"}}))
        assert live.remember_live(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "ck"), "/proj", lambda: next(ticks)).awaitTermination(120)
        seen.append({r["value"]: r["created_at"] for r in Tables(spark, str(tmp_path / "s")).read("working_memory").collect()})
    assert seen[0] == {"edit /a/0.ts": NOW} and seen[1] == {"edit /a/0.ts": NOW, "edit /a/1.ts": NOW + 1000}


def test_git_and_tree(spark, tmp_path):
    import subprocess

    from sessionloom.sources import files

    repo = tmp_path / "r"
    (repo / "src").mkdir(parents=True)
    (repo / "src" / "a.py").write_text("x = 1\n")
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "b.js").write_text("1")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src")
    git("commit", "-qm", "first")
    c = files.git_commits(spark, str(repo)).collect()
    assert len(c) == 1 and c[0]["message"] == "first" and c[0]["files_changed"] == ["src/a.py"]
    assert [(r["path"].split("/")[-1], r["size"]) for r in files.source_tree(spark, str(repo)).collect()] == [("a.py", 6)]
