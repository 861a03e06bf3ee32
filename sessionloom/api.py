"""One object over a folder of tables: index logs, search, look up facts, remember, tag, report, forget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import predicates as P
from sessionloom.functions import text as T
from sessionloom.functions import vectors as V
from sessionloom.operators import chunking, embedding, maintenance, memory, relational, report, search, tools
from sessionloom.operators.extract import facts
from sessionloom.operators.text_index import TextIndex
from sessionloom.sources import files, session_logs
from sessionloom.sources.store import Tables


#: Facts that are found by likeness, and the columns that speak for them.
FACT_TEXT = {"decisions": ["decision_text", "rationale"], "mistakes": ["what_went_wrong", "correction"]}
FACTS = ("decisions", "mistakes", "requirements", "validations", "methodologies", "research_findings", "solution_patterns")
#: Tools that open a file, and what they do to it.
FILE_ACTIONS = {"Read": "read", "Edit": "edit", "Write": "create"}
#: Hits that are looked for beyond a page, so that it is known whether there are more.
BEYOND = 50
#: Tables whose rows are counted by run and in all.
COUNTED = ("conversations", "messages", "tool_uses", "tool_results", *FACTS)


class Engine:
    """``now`` (epoch milliseconds) is given to calls that depend on time, so results are repeatable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)
        self.text = TextIndex(self.tables, "message_text")

    # indexing
    def index(self, project: str, folders: list[str], now: int, since_ms: int | None = None, rollouts: bool = False, skip_servers: list[str] | None = None, repo: str | None = None) -> dict[str, int]:
        """Parse logs, upsert entities, extract all facts, embed messages and chunks, link commits of ``repo``; rows by table, and messages left out.

        A project that has an alias goes on under its canonical path. Facts are made of the messages of conversations that this run has read.
        """
        project = self.canonical(project)
        lines = session_logs.read_lines(self.spark, folders, "rollout-*.jsonl" if rollouts else "*.jsonl", since_ms, rollouts)
        parsed = session_logs.parse_rollouts(lines, now) if rollouts else session_logs.parse(lines, project, now)
        if skip_servers is not None:
            parsed = session_logs.without_servers(parsed, skip_servers or None)
        t, came = self.tables, {}
        came["conversations"] = t.upsert("conversations", parsed["conversations"])
        came["messages"], skipped = t.upsert_messages(parsed["messages"])
        for name in ("tool_uses", "tool_results", "thinking_blocks", "file_edits"):
            if name in parsed:
                came[name] = t.upsert(name, parsed[name])
        ids, _ = t.staged(parsed["conversations"].select(F.col("id").alias("conversation_id")).distinct())
        came |= self._facts(ids)
        t.unstage(ids)
        if repo:
            self.link_commits(repo)
        counted = {n: came.get(n, 0) for n in (*COUNTED, "embedded")}
        t.append("index_runs", self.spark.createDataFrame([(project, now, "rollouts" if rollouts else "sessions", skipped, *counted.values())], ", ".join(["project_path string, at long, source string, skipped_messages long", *(f"{n} long" for n in counted)])))
        return {**self.statistics(), "skipped_messages": skipped}

    def statistics(self) -> dict[str, int]:
        """Rows by table, as the writes have counted them: no table is read (AGG-7, AGG-17)."""
        return {n: self.tables.count(n) for n in COUNTED}

    def sources(self) -> DataFrame:
        """Each project that was indexed: runs, the time of the last one, and the rows that came in all runs by table (SNK-11)."""
        runs = self.tables.read("index_runs")
        return runs.groupBy("project_path", "source").agg(F.count("*").alias("runs"), F.max("at").alias("last_indexed"), *[F.sum(n).alias(n) for n in (*COUNTED, "embedded", "skipped_messages")]).orderBy(F.desc("last_indexed"), "project_path", "source")

    def index_all(self, projects: dict[str, list[str]], now: int, rollout_folders: list[str] | None = None, since_ms: int | None = None) -> dict[str, dict[str, int]]:
        """Every project of both dialects (index_all_projects); rows by project."""
        out = {p: self.index(p, folders, now, since_ms) for p, folders in projects.items()}
        if rollout_folders:
            out["rollouts"] = self.index("", rollout_folders, now, since_ms, rollouts=True)
        return out

    def _facts(self, ids: DataFrame) -> dict[str, int]:
        """Facts and vectors of the given conversations; rows that came by table, and messages that were embedded."""
        t, came = self.tables, {}
        own = t.read("messages").join(ids, "conversation_id", "left_semi")
        m = own.withColumnRenamed("id", "message_id")
        of = lambda name: t.read(name).join(m.select("message_id"), "message_id", "left_semi")
        uses, results = of("tool_uses"), of("tool_results")
        came["decisions"] = t.upsert("decisions", facts.decisions(m, of("thinking_blocks")))
        came["mistakes"] = t.upsert("mistakes", facts.mistakes(m, results))
        came["requirements"] = t.upsert("requirements", facts.requirements(m))
        runs = uses.select("id", "message_id", "timestamp", F.get_json_object("tool_input", "$.command").alias("command"))
        checked = facts.validations(runs.select("id", "command"), results.select("tool_use_id", "is_error", "content"))
        came["validations"] = t.upsert("validations", checked.join(runs.select("id", "message_id", "timestamp"), "id").join(m.select("message_id", "conversation_id"), "message_id"))
        keyed = lambda df, kind, *parts: df.withColumn("id", facts.fact_id(kind, *parts))
        found = keyed(facts.findings(m, uses), "finding", "message_id", F.lower("discovery"))
        solved = keyed(facts.solutions(m, uses), "solution", "message_id", F.lower("solution_summary"))
        at = m.select("message_id", "timestamp")
        came["research_findings"] = t.upsert("research_findings", found.join(at, "message_id"))
        came["solution_patterns"] = t.upsert("solution_patterns", solved.join(at, "message_id"))
        ways = keyed(tools.methodologies(m, uses, results), "methodology", "start_message_id")
        came["methodologies"] = t.upsert("methodologies", ways.join(at.withColumnRenamed("message_id", "start_message_id"), "start_message_id"))
        came["embedded"] = self._embed(own)
        self.text.add(own, "id", "content")
        for kind, columns in FACT_TEXT.items():
            self._embed_facts(kind, columns, t.read(kind).join(ids, "conversation_id", "left_semi"))
        return came

    def _embed(self, own: DataFrame) -> int:
        """Vectors of the chunks of messages whose text has none yet or has changed; how many messages (VEC-6)."""
        t, known = self.tables, self.tables.read("embeddings")
        said = own.select("id", "content", self._text_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))
        if known is not None:
            said = said.join(known.select(F.col("message_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")
        todo, n = t.staged(said)
        if n or known is None:
            parts = self._with_vectors(chunking.chunks(todo, "id", "content"), "content")
            parts, _ = t.staged(parts.withColumn("id", F.concat_ws("_", "message_id", F.col("chunk_index").cast("string"))))
            t.delete("chunk_embeddings", todo.select(F.col("id").alias("message_id")))  # of an earlier text
            t.append("chunk_embeddings", parts, ["id"])
            # the first chunk is the message's own vector; written last, as it says that the message is done
            hashes = todo.select(F.col("id").alias("message_id"), "content_hash")
            t.upsert("embeddings", parts.where("chunk_index = 0").select("message_id", "embedding").join(hashes, "message_id"))
            t.unstage(parts)
        t.unstage(todo)
        return n

    def _embed_facts(self, kind: str, columns: list[str], rows: DataFrame) -> int:
        """Vectors of facts that have none yet or whose text has changed; how many (VEC-5)."""
        known, said = self.tables.read("fact_embeddings"), F.concat_ws(" ", *columns)
        rows = rows.select(F.lit(kind).alias("kind"), "id", said.alias("said"), self._text_hash(said).alias("content_hash"))
        if known is not None:
            rows = rows.join(known.select("kind", "id", "content_hash"), ["kind", "id", "content_hash"], "left_anti")
        return self.tables.upsert("fact_embeddings", self._with_vectors(rows, "said").drop("said"))

    def fit_embedding(self, common: int = 1) -> int:
        """Term weights and common directions learnt from all messages; messages and facts get vectors of the new model; how many messages, none if nothing is indexed (SRC-13).

        Later messages are embedded by this model until it is fitted again. After a failure the call can be made again: what has a
        vector of the model by then keeps it, if the messages are the same.
        """
        t = self.tables
        said = t.read("messages")
        if said is None:
            return 0
        told = said.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("content"), F.lit(1 << 31))).alias("s")).select(F.xxhash64("n", "s", F.lit(common)).alias("version"))
        version, old = told.first()[0], t.read("embedding_model")
        if old is None or old.first()["version"] != version:  # else the messages are those of the last fit
            model = embedding.fit(self.spark, said, T.tokens("content"), common=common)
            t.upsert("embedding_model", model.select(F.lit("current").alias("id"), "weights", "directions", F.lit(version).alias("version")), ["id"])
        n = self._embed(said)
        for kind, columns in FACT_TEXT.items():
            if (rows := t.read(kind)) is not None:
                self._embed_facts(kind, columns, rows)
        return n

    def _text_hash(self, text):
        """Hash of what a vector is made of: the text, and the model if one is fitted."""
        model = self.tables.read("embedding_model")
        return F.xxhash64(text) if model is None else F.xxhash64(text, F.lit(model.first()["version"]))

    def _with_vectors(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``embedding`` of a text column, by the fitted model if there is one, else hashed."""
        model = self.tables.read("embedding_model")
        return df.withColumn("embedding", V.hashed_embedding(T.tokens(text))) if model is None else embedding.embedded(df, T.tokens(text), model, "embedding")

    def _query_vector(self, text: str) -> list[float]:
        return self._with_vectors(self.spark.createDataFrame([(text,)], "q string"), "q").first()["embedding"]

    def link_commits(self, repo: str, days: int | None = None) -> int:
        """Commits of a repository with the conversation that they belong to; how many are linked (link_commits)."""
        commits = files.git_commits(self.spark, repo, days).select(F.col("hash").alias("commit_id"), "timestamp", F.col("files_changed").alias("files"), "branch", "message", "author")
        edits = self.tables.read("file_edits")
        root = repo.rstrip("/") + "/"
        changed = edits.groupBy("conversation_id").agg(F.array_sort(F.collect_set(F.when(F.col("file_path").startswith(root), F.expr(f"substring(file_path, {len(root) + 1})")).otherwise(F.col("file_path")))).alias("files"))
        said = self.tables.read("decisions").where("context is not null").groupBy("conversation_id").agg(F.array_sort(F.collect_set("context")).alias("keywords"))
        none = F.array().cast("array<string>")
        c = self.tables.read("conversations").select(F.col("id").alias("conversation_id"), F.col("first_message_at").alias("first_at"), F.col("last_message_at").alias("last_at"), F.col("git_branch").alias("branch"))
        c = c.join(changed, "conversation_id", "left").join(said, "conversation_id", "left").withColumns({"files": F.coalesce("files", none), "keywords": F.coalesce("keywords", none)}).withColumnRenamed("conversation_id", "conv_id")
        best = relational.link_commits(commits.drop("author"), c)
        rows = commits.join(best, "commit_id", "left").select(F.col("commit_id").alias("hash"), "message", "author", "timestamp", "branch", F.col("files").alias("files_changed"), F.col("conv_id").alias("conversation_id"), "confidence")
        self.tables.upsert("git_commits", rows)
        return self.tables.read("git_commits").where("conversation_id is not null").count()

    def canonical(self, project: str) -> str:
        """The path that a project's rows are under: its own if it has rows or no alias, else its alias's (SNK-1, JN-19)."""
        aliases, known = self.tables.read("project_aliases"), self.tables.read("conversations")
        if aliases is None or (known is not None and not known.where(F.col("project_path") == project).isEmpty()):
            return project
        found = aliases.where(F.col("alias_path") == project).orderBy("canonical_path").first()
        return found["canonical_path"] if found else project

    # search
    def _conversations(self, project: str | None = None, source: str | None = None) -> DataFrame | None:
        """Ids (conversation_id) of the conversations of a project and of a source type; None if neither is given."""
        if project is None and source is None:
            return None
        return self.tables.read("conversations").where(P.all_of({"project_path": project, "source_type": source})).select(F.col("id").alias("conversation_id"))

    def search(self, query: str, limit: int = 10, where=None, expand: bool = False, by_session: bool = False, project: str | None = None, source: str | None = None) -> DataFrame:
        """Messages by vectors of chunks and messages and by full text, fused by rank, with snippets; filters come before any cut (HYB-4).

        Chunk hits make message hits, which replace them where they are better; near repeats go before ranks are given.
        """
        m = self.tables.read("messages")
        m = m if where is None else m.where(where)
        of = self._conversations(project, source)
        m = m if of is None else m.join(of, "conversation_id", "left_semi")
        own = m.select(F.col("id").alias("message_id"))
        q = self._query_vector(query)
        near = lambda name, key: search.knn(self.tables.read(name).join(own, "message_id", "left_semi"), q, 5 * limit, id_col=key)
        chunk_hits = search.chunks_to_messages(near("chunk_embeddings", "id"), 1e-6)
        hits = search.merge_hits(chunk_hits, near("embeddings", "message_id").where("similarity > 0"), 3 * limit)
        said = hits.join(m.select(F.col("id").alias("message_id"), "content"), "message_id").select(F.col("message_id").alias("id"), "similarity", "content")
        v = search.ranked(search.without_near_repeats(said, 3 * limit).select("id", "similarity"), "similarity", "id", 3 * limit)
        named = reduce(DataFrame.unionByName, [self.text.matching(text) for text in (chunking.expansions(query) if expand else [query])])
        t = search.ranked(m.join(named, "id", "left_semi").select("id", "timestamp"), "timestamp", "id", 3 * limit)
        fused = search.reciprocal_rank_fusion(v, t, limit)
        out = fused.join(m, "id").select("id", "conversation_id", "role", "timestamp", "score", chunking.snippet("content", query).alias("snippet")).orderBy(F.desc("score"), "id")
        return search.sessions_of(out.withColumnRenamed("score", "similarity"), limit) if by_session else out

    def search_all(self, query: str, limit: int = 20, offset: int = 0, since: int | None = None, until: int | None = None, source: str | None = None) -> DataFrame:
        """A page of the messages that :meth:`search` finds in all projects, with the project and source of each (search_all_conversations)."""
        return self._page(self.search(query, limit + offset + BEYOND, P.between_ms("timestamp", since, until), source=source), [F.desc("score"), F.asc("id")], limit, offset)

    def all_decisions(self, query: str, file_path: str | None = None, limit: int = 20, offset: int = 0, source: str | None = None) -> DataFrame:
        """A page of the decisions of all projects that are like a query, those that name a file if one is given (get_all_decisions)."""
        named = P.contains_any(["decision_text", "rationale", "context"], file_path) if file_path else None
        return self._page(self._found("decisions", query, limit + offset + BEYOND, named, source=source), self._fact_order(query), limit, offset)

    def all_mistakes(self, query: str, kind: str | None = None, limit: int = 20, offset: int = 0, source: str | None = None) -> DataFrame:
        """A page of the mistakes of all projects that are like a query (search_all_mistakes)."""
        of = F.col("mistake_type") == kind if kind else None
        return self._page(self._found("mistakes", query, limit + offset + BEYOND, of, source=source), self._fact_order(query), limit, offset)

    @staticmethod
    def _fact_order(text: str | None) -> list:
        return [*([F.desc("similarity")] if text else []), F.desc("timestamp"), F.asc("id")]

    def _page(self, hits: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
        # a few hits, searched once: the page, its probe for a next one and the counts read them
        found = self.spark.createDataFrame(hits.collect(), hits.schema)
        return tools.hits_page(found, self.tables.read("conversations"), order, limit, offset)

    def search_words(self, query: str, limit: int = 10) -> DataFrame:
        """Messages by BM25 over any word of the query, from the stored index (FTS-5)."""
        best = self.text.bm25(query, limit)
        return best.join(self.tables.read("messages"), "id").select("id", "conversation_id", "role", "timestamp", "score", chunking.snippet("content", query).alias("snippet")).orderBy(F.desc("score"), "id")

    def _found(self, name: str, text: str | None, limit: int, *where, source: str | None = None) -> DataFrame:
        """Facts with their source, by likeness of their stored vectors to ``text`` and by words of it, the likest first; without text the latest (VEC-5, JN-2, JN-3)."""
        columns = FACT_TEXT[name]
        rows = self.tables.read(name).where(P.all_of(None, *where))
        of = self._conversations(source=source)
        rows = rows if of is None else rows.join(of, "conversation_id", "left_semi")
        rows = relational.with_source(rows, self.tables.read("conversations"), self.tables.read("messages"))
        if not text:
            return rows.orderBy(F.desc("timestamp"), "id").limit(limit)
        q = self._query_vector(text)
        vectors = self.tables.read("fact_embeddings").where(F.col("kind") == name).select("id", F.col("embedding").alias("_vector"))
        scored = rows.join(vectors, "id", "left").withColumn("similarity", F.coalesce(V.cosine_to(F.col("_vector"), q), F.lit(0.0))).drop("_vector")
        scored = scored.withColumn("_named", P.contains_any(columns, text) | search.match_all(F.concat_ws(" ", *columns), text))
        return scored.where(F.col("_named") | (F.col("similarity") > 0.3)).orderBy(F.desc("_named"), F.desc("similarity"), F.desc("timestamp"), "id").limit(limit).drop("_named")

    def decisions(self, text: str | None = None, limit: int = 20) -> DataFrame:
        return self._found("decisions", text, limit)

    def mistakes(self, text: str | None = None, kind: str | None = None, limit: int = 10, conversation: str | None = None) -> DataFrame:
        """search_mistakes."""
        return self._found("mistakes", text, limit, F.col("mistake_type") == kind if kind else None, F.col("conversation_id") == conversation if conversation else None)

    def requirements(self, component: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        """get_requirements: those that touch a component or name it."""
        r = self.tables.read("requirements").where(P.all_of({"type": kind}, F.array_contains("affects_components", component.lower()) | P.contains("description", component)))
        return r.orderBy(F.desc("timestamp"), "id").limit(limit)

    def validations(self, limit: int = 20) -> DataFrame:
        return self.tables.read("validations").orderBy(F.desc("timestamp"), "id").limit(limit)

    def facts(self, name: str, text: str | None = None, limit: int = 10) -> DataFrame:
        """get_methodologies, get_research_findings, get_solution_patterns: by phrase prefix, else the latest."""
        columns = {"methodologies": ["problem_statement", "approach"], "research_findings": ["topic", "discovery"], "solution_patterns": ["solution_summary", "problem_category"]}[name]
        return tools.facts_matching(self.tables.read(name), text, columns, "timestamp", limit)

    def recall_and_apply(self, query: str, file_path: str | None = None, since: int | None = None, until: int | None = None, limit: int = 5) -> tuple[DataFrame, list[str]]:
        """(kind, id, timestamp, text) of messages, decisions, mistakes, file changes and commits for a task, ``limit`` of each, and what to do with them."""
        row = lambda df, kind, key, text: df.where(P.all_of(None, P.between_ms("timestamp", since, until))).limit(limit).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "timestamp", text.alias("text"))
        parts = [row(self.search(query, limit), "conversation", "id", F.col("snippet")), row(self.decisions(query, limit), "decision", "id", F.col("decision_text")), row(self.mistakes(query, limit=limit), "mistake", "id", F.col("what_went_wrong"))]
        edits = self.tables.read("file_edits").withColumn("timestamp", F.col("snapshot_timestamp"))
        edits = edits.where(P.contains("file_path", file_path or query))
        parts.append(row(edits.orderBy(F.desc("timestamp"), "id"), "file_change", "id", F.col("file_path")))
        if self.tables.read("git_commits") is not None:
            parts.append(row(self.commits(query, limit), "commit", "hash", F.col("message")))
        out = reduce(DataFrame.unionByName, parts)
        n = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
        says = {"conversation": "Read the messages before starting.", "decision": "Keep to these decisions or say why not.", "mistake": "Check that these mistakes are not made again.", "file_change": "See how these files have changed.", "commit": "See what these commits did."}
        return out, [f"{n[k]} {k.replace('_', ' ')}s: {text}" for k, text in says.items() if n.get(k)]

    def commits(self, text: str | None = None, limit: int = 20, project: str | None = None) -> DataFrame:
        """Commits with the conversation that they are linked to (JN-6)."""
        c = self.tables.read("git_commits")
        c = c.where(P.contains_any(["message", "hash"], text) | search.match_any("message", text)) if text else c
        return relational.commits_with_talk(c, self.tables.read("conversations"), self.tables.read("messages"), project).orderBy(F.desc("timestamp"), "hash").limit(limit)

    def tool_history(self, **filters) -> DataFrame:
        return relational.tool_history(self.tables.read("tool_uses"), self.tables.read("tool_results"), **filters).orderBy(F.desc("timestamp"), "id")

    def sessions(self, limit: int = 20) -> DataFrame:
        return relational.session_previews(self.tables.read("conversations"), self.tables.read("messages")).orderBy(F.desc("last_message_at"), "id").limit(limit)

    def file_timeline(self, path: str, decisions: bool = True, commits: bool = True) -> DataFrame:
        """Edits of a file, and the decisions and commits that name it (get_file_evolution)."""
        e = self.tables.read("file_edits").where(F.lower("file_path") == path.lower())
        parts = [e.select(F.lit("edit").alias("kind"), F.col("id").alias("ref"), F.col("snapshot_timestamp").alias("timestamp"), F.col("file_path").alias("detail"))]
        if decisions:
            d = self.tables.read("decisions").where(P.contains("decision_text", path))
            parts.append(d.select(F.lit("decision").alias("kind"), F.col("id").alias("ref"), "timestamp", F.col("decision_text").alias("detail")))
        c = self.tables.read("git_commits") if commits else None
        if c is not None:
            hit = c.where(F.exists("files_changed", lambda f: (F.length(f) > 0) & F.lit(path.lower()).endswith(F.lower(f))))
            parts.append(hit.select(F.lit("commit").alias("kind"), F.col("hash").alias("ref"), "timestamp", F.col("message").alias("detail")))
        return relational.timeline(*parts)

    def check_before_modify(self, path: str, k: int = 5) -> DataFrame:
        """What to know of a file before it is changed: its latest edits and commits, decisions and mistakes that name it (check_before_modify)."""
        edits = self.tables.read("file_edits").withColumn("timestamp", F.col("snapshot_timestamp"))
        return tools.before_change(k, edits, self.tables.read("git_commits"), self.tables.read("decisions"), self.tables.read("mistakes"), path)

    # memory
    def remember(self, items: DataFrame, now: int) -> None:
        """items: project_path, key, value, tags, ttl (seconds)."""
        self.tables.upsert("working_memory", memory.fresh(items, now))

    def recall(self, now: int, **filters) -> DataFrame:
        return memory.recall(self.tables.read("working_memory"), now, **filters)

    def hand_off(self, project: str, session: str, now: int, include: tuple[str, ...] = ("decisions", "files", "tasks", "memory")) -> DataFrame:
        """Stores the latest decisions and active files of a project, its tasks and its memory for a session to come; the stored row (HND-1)."""
        t, blank = self.tables, lambda ddl: self.spark.createDataFrame([], ddl)
        none = {"decisions": blank("decision_text string, timestamp long"), "files": blank("file_path string, timestamp long"), "tasks": blank("key string, value string, updated_at long"), "memory": blank("key string, value string, tags array<string>, updated_at long")}
        parts, own = dict(none), None
        if t.read("conversations") is not None:
            own = t.read("messages").join(self._conversations(project), "conversation_id", "left_semi").select(F.col("id").alias("message_id"))
        if own is not None and (made := t.read("decisions")) is not None:
            parts["decisions"] = made.join(own, "message_id", "left_semi")
        if own is not None and (uses := t.read("tool_uses")) is not None:
            action = F.element_at(F.create_map(*[F.lit(x) for pair in FILE_ACTIONS.items() for x in pair]), F.col("tool_name"))
            uses = uses.where(F.col("tool_name").isin(*FILE_ACTIONS)).join(own, "message_id", "left_semi")
            parts["files"] = memory.active_files(uses, F.get_json_object("tool_input", "$.file_path")).withColumn("action", action)
        if (items := t.read("working_memory")) is not None:
            parts["tasks"], parts["memory"] = memory.pending_tasks(items, now, project), memory.recall(items, now, project)
        chosen = {n: parts[n] if n in include else none[n] for n in none}
        row = memory.handoff_row(memory.handoff(**chosen), project, session, now)
        row = self.spark.createDataFrame(row.collect(), row.schema)
        t.upsert("session_handoffs", row)
        return row

    def handoffs(self, project: str | None = None, resumed: bool = False, limit: int = 10) -> DataFrame | None:
        """list_handoffs (HND-3); None if there never was one."""
        kept = self.tables.read("session_handoffs")
        return None if kept is None else memory.list_handoffs(kept, project, resumed, limit)

    def handoff(self, handoff_id: str) -> DataFrame | None:
        """The hand-off of an id, whole (HND-3)."""
        one = self.spark.createDataFrame([(handoff_id,)], "id string")
        kept = self.tables.read_keys("session_handoffs", one)
        return None if kept is None else kept.where(F.col("id") == handoff_id)

    def delete_handoff(self, handoff_id: str) -> bool:
        """Whether there was a hand-off of this id; it is in no file any more (HND-3)."""
        return self.tables.delete("session_handoffs", self.spark.createDataFrame([(handoff_id,)], "id string")) > 0

    def resume(self, project: str, session: str, now: int, handoff_id: str | None = None, inject: bool = True) -> DataFrame | None:
        """The latest hand-off of a project that is open, or the one of an id: marked as resumed, its memory put back (HND-2)."""
        all_of = self.tables.read("session_handoffs")
        if all_of is None:
            return None
        taken = self.spark.createDataFrame(memory.resume(all_of, project, handoff_id).collect(), all_of.schema)
        if taken.isEmpty():
            return None
        self.tables.upsert("session_handoffs", memory.mark_resumed(taken, taken, session, now))
        if inject and self.tables.version("working_memory") is not None:
            self.tables.upsert("working_memory", memory.fresh(memory.handed_over(taken), now))
        return taken

    # upkeep
    def maintain(self, now: int, days: int = 90) -> DataFrame:
        """Archive stale items, drop expired ones and embeddings without a message, compact tables; the history of such runs (run_maintenance)."""
        t, done = self.tables, []
        items = t.read("working_memory")
        if items is not None:
            expired, _ = t.staged(items.where(~F.coalesce(P.live(now), F.lit(False))).select("project_path", "key"))
            done.append(maintenance.log_row(self.spark, "sweep_expired", now, t.delete("working_memory", expired)))
            t.unstage(expired)
        for name in ("embeddings", "chunk_embeddings"):
            e = t.read(name)
            if e is not None:
                lost, _ = t.staged(e.select("message_id").distinct().join(t.read("messages").select(F.col("id").alias("message_id")), "message_id", "left_anti"))
                done.append(maintenance.log_row(self.spark, f"cleanup_{name}", now, t.delete(name, lost)))
                t.unstage(lost)
        for name in ("messages", "tool_uses", "tool_results"):
            if t.read(name) is not None:
                t.compact(name)
                done.append(maintenance.log_row(self.spark, f"compact_{name}", now, t.count(name)))
        t.upsert("maintenance_log", reduce(DataFrame.unionByName, done))
        return t.read("maintenance_log").orderBy(F.desc("at"), "id")

    def forget_topic(self, topic: str, backup: str | None = None, confirm: bool = False) -> dict[str, int]:
        """Conversations about a topic: counted, or backed up and deleted."""
        ids = maintenance.about(self.tables.read("messages"), topic).union(self.search(topic, 20).select("conversation_id")).distinct().select(F.col("conversation_id").alias("id"))
        ids, n = self.tables.staged(ids)
        kept = self.tables.backup(ids, backup) if confirm and backup else {}
        if confirm:
            self.delete_conversations(ids)
        self.tables.unstage(ids)
        return {"conversations": n, **kept}

    def delete_conversations(self, ids: DataFrame) -> dict[str, int]:
        """Conversations (id) with all that hangs on them, in the tables and in the text index; rows that went by table. No file holds them any more."""
        gone = self.tables.read("messages").join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select("id")
        self.text.remove(gone)
        return self.tables.delete_conversations(ids)

    def report(self, project: str) -> str:
        e = self.tables.read("file_edits").withColumn("timestamp", F.col("snapshot_timestamp"))
        return report.project_report(project, self.tables.read("decisions"), self.tables.read("mistakes"), self.tables.read("requirements"), e)
