"""Parquet tables in hash buckets: a write replaces the buckets that it touches and leaves the others alone (SNK-2 to SNK-20)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import schemas
from sessionloom.operators.memory import merge


#: Tables whose rows go with their message, and those that go with their conversation.
OF_MESSAGE = ("tool_uses", "tool_results", "thinking_blocks", "embeddings", "chunk_embeddings")
OF_CONVERSATION = ("file_edits", "decisions", "mistakes", "requirements", "validations", "methodologies", "research_findings", "solution_patterns")
BUCKET = "_bucket"
#: Buckets up to which rows are counted by one expression each while they are written.
OBSERVED = 32


@dataclass(frozen=True)
class Version:
    """What a table consists of: the folders of each bucket (below the table's own) and their rows."""

    number: int
    keys: list[str]
    n: int
    schema: T.StructType
    folders: dict[int, list[str]]
    rows: dict[int, int]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")


class Tables:
    """Named tables under one folder, each dealt into buckets by a hash of its keys.

    Rows are written to new folders first; then a numbered file that lists the folders of the table takes the place of the last
    one, so a failed write changes nothing; then folders that it does not list any more are deleted, so deleted and replaced rows are in no file. Frames that
    were read before such a write do not outlive it. One writer of a table at a time; a second one that finishes later is refused.

    A table has ``buckets`` buckets until :meth:`compact` gives it as many as its size asks for.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # files
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name, "_versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self, name: str) -> Version | None:
        """The table as it is now; None if there is no such table."""
        numbers = [x for x in self._numbers(name) if x.endswith(".json")]
        if not numbers:
            return None
        stream = self._fs().open(self._path(name, "_versions", numbers[-1]))
        try:
            x = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        by_bucket = lambda d: {int(k): v for k, v in d.items()}
        return Version(int(numbers[-1].split(".")[0]), x["keys"], x["n"], T.StructType.fromJson(x["schema"]), by_bucket(x["folders"]), by_bucket(x["rows"]))

    def _commit(self, name: str, old: Version | None, new: Version) -> None:
        """``new`` is the table from here on; what only ``old`` listed is deleted."""
        fs = self._fs()
        at, made = self._path(name, "_versions", f"{new.number:08d}.json"), self._path(name, "_versions", f".{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(json.dumps({"keys": new.keys, "n": new.n, "schema": new.schema.jsonValue(), "folders": new.folders, "rows": new.rows}).encode())
        out.close()
        if fs.exists(at) or not fs.rename(made, at):
            fs.delete(made, False)
            raise RuntimeError(f"{name} was written by another writer meanwhile")
        if old is not None:
            listed = {f for folders in new.folders.values() for f in folders}
            gone = {f for folders in old.folders.values() for f in folders} - listed
            for folder in gone:
                fs.delete(self._path(name, folder), True)
            writes = lambda folders: {f.rpartition("/")[0] for f in folders}
            for folder in writes(gone) - writes(listed):
                fs.delete(self._path(name, folder), True)
            fs.delete(self._path(name, "_versions", f"{old.number:08d}.json"), False)

    def _written(self, name: str, df: DataFrame, as_version: Version, as_dealt: bool = False) -> tuple[dict[int, list[str]], dict[int, int]]:
        """``df`` written in the buckets of a version; folders and rows of each bucket that has rows. ``as_dealt``: nothing is moved, each task writes its own file of a bucket."""
        folder, seen = f"data/{uuid.uuid4().hex}", Observation()
        dealt = df.withColumn(BUCKET, as_version.bucket())
        dealt = dealt if as_dealt else dealt.repartition(BUCKET)
        few = as_version.n <= OBSERVED
        if few:  # counted on the way
            dealt = dealt.observe(seen, *[F.count_if(F.col(BUCKET) == b).alias(f"n{b}") for b in range(as_version.n)])
        dealt.write.partitionBy(BUCKET).parquet(f"{self.root}/{name}/{folder}")
        if few:
            rows = {b: seen.get[f"n{b}"] for b in range(as_version.n) if seen.get[f"n{b}"]}
        else:  # the files' footers say it
            back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.root}/{name}/{folder}")
            rows = {r[BUCKET]: r["n"] for r in back.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
        return {b: [f"{folder}/{BUCKET}={b}"] for b in rows}, rows

    def staged(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` written aside and read back, and its number of rows, counted on the way; :meth:`unstage` deletes it."""
        path, seen = f"{self.root}/_staged/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def unstage(self, *frames: DataFrame) -> None:
        for df in frames:
            for file in df.inputFiles()[:1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                self._fs().delete(folder, True)

    # reading
    def _of(self, name: str, v: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        chosen = v.folders if buckets is None else {b: v.folders[b] for b in buckets if b in v.folders}
        paths = sorted(f"{self.root}/{name}/{f}" for folders in chosen.values() for f in folders)
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self._of(name, v)

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The buckets that rows of the given keys lie in, and no others."""
        v = self.version(name)
        return None if v is None else self._of(name, v, [r[0] for r in keys.select(v.bucket()).distinct().collect()])

    def count(self, name: str) -> int:
        """Rows, without reading the table."""
        v = self.version(name)
        return 0 if v is None else sum(v.rows.values())

    # writing
    def _keys(self, name: str, columns: list[str], old: Version | None) -> list[str]:
        return old.keys if old is not None else [k for k in schemas.KEYS.get(name, columns[:1]) if k in columns] or columns[:1]

    def write(self, name: str, df: DataFrame, keys: list[str] | None = None, buckets: int | None = None, as_dealt: bool = False) -> None:
        """The whole table anew."""
        old = self.version(name)
        v = Version(old.number + 1 if old else 1, keys or self._keys(name, df.columns, old), buckets or (old.n if old else self.buckets), _wider(df.schema, df.schema), {}, {})
        folders, rows = self._written(name, df, v, as_dealt)
        self._commit(name, old, replace(v, folders=folders, rows=rows))

    def _replaced(self, name: str, old: Version, df: DataFrame, touched: list[int]) -> None:
        """``df`` is all there is in the touched buckets."""
        folders, rows = self._written(name, df, old)
        rest = lambda d: {b: x for b, x in d.items() if b not in touched}
        self._commit(name, old, replace(old, number=old.number + 1, schema=_wider(old.schema, df.schema), folders={**rest(old.folders), **folders}, rows={**rest(old.rows), **rows}))

    def append(self, name: str, new: DataFrame, keys: list[str] | None = None, as_dealt: bool = False) -> int:
        """Rows whose keys are not in the table: no bucket is read or written anew. How many."""
        old = self.version(name)
        if old is None:
            self.write(name, new, keys, as_dealt=as_dealt)
            return self.count(name)
        folders, rows = self._written(name, _conformed(new, old.schema), old, as_dealt)
        both = {b: [*old.folders.get(b, []), *folders.get(b, [])] for b in {*old.folders, *folders}}
        self._commit(name, old, replace(old, number=old.number + 1, schema=_wider(old.schema, new.schema), folders=both, rows={b: old.rows.get(b, 0) + rows.get(b, 0) for b in both}))
        return sum(rows.values())

    def upsert(self, name: str, new: DataFrame, keys: list[str] | None = None) -> int:
        """Last writer wins by key; created_at is kept from the first. Only buckets with new rows are written. How many rows came."""
        keys, old = keys or schemas.KEYS[name], self.version(name)
        if old is None:
            self.write(name, new.dropDuplicates(keys), keys)
            return self.count(name)
        new, n = self.staged(_conformed(new, old.schema).dropDuplicates(keys))
        if n:
            touched = [r[0] for r in new.select(old.bucket()).distinct().collect()]
            keep = ("created_at",) if "created_at" in new.columns and "created_at" in old.schema.names else ()
            self._replaced(name, old, merge(self._of(name, old, touched), new, keys, keep), touched)
        self.unstage(new)
        return n

    def upsert_messages(self, new: DataFrame) -> tuple[int, int]:
        """Messages of known conversations; how many came, and how many were left out because theirs is not known (SNK-3)."""
        known = self.read("conversations")
        if known is None:
            return 0, new.count()
        ids = known.select(F.col("id").alias("conversation_id"))
        n = self.upsert("messages", new.join(ids, "conversation_id", "left_semi"))
        return n, new.join(ids, "conversation_id", "left_anti").count()

    def clear(self, name: str) -> None:
        """No rows any more (SNK-10)."""
        old = self.version(name)
        if old is not None:
            self._commit(name, old, replace(old, number=old.number + 1, folders={}, rows={}))

    def delete(self, name: str, doomed: DataFrame, instead: DataFrame | None = None) -> int:
        """Rows whose values are in ``doomed`` (its columns are the key) go, from every file; how many fewer there are. Neither frame may be read from this table.

        Rows ``instead`` of them, of the same keys, come with the same write.
        """
        old = self.version(name)
        if old is None:
            return 0
        touched = [r[0] for r in self._of(name, old).join(doomed, doomed.columns, "left_semi").select(old.bucket()).distinct().collect()]
        if not touched:
            return 0
        left = self._of(name, old, touched).join(doomed, doomed.columns, "left_anti")
        self._replaced(name, old, left if instead is None else left.unionByName(instead, allowMissingColumns=True), touched)
        return sum(old.rows.values()) - self.count(name)

    def delete_conversations(self, ids: DataFrame) -> dict[str, int]:
        """Conversations (id) and, by their keys, all that hangs on them (SNK-13); rows that went by table."""
        own, _ = self.staged(ids.select(F.col("id").alias("conversation_id")).distinct())
        messages, out, gone = self.read("messages"), {}, None
        if messages is not None:
            gone, _ = self.staged(messages.join(own, "conversation_id", "left_semi").select(F.col("id").alias("message_id")))
            out |= {name: self.delete(name, gone) for name in OF_MESSAGE}
        for kind in ("decisions", "mistakes"):
            facts = self.read(kind)
            if facts is not None:
                lost, _ = self.staged(facts.join(own, "conversation_id", "left_semi").select(F.lit(kind).alias("kind"), "id"))
                out["fact_embeddings"] = out.get("fact_embeddings", 0) + self.delete("fact_embeddings", lost)
                self.unstage(lost)
        out |= {name: self.delete(name, own) for name in ("messages", *OF_CONVERSATION)}
        commits = self.read("git_commits")
        if commits is not None:  # commits stay, without their link
            self.upsert("git_commits", commits.join(own, "conversation_id", "left_semi").withColumn("conversation_id", F.lit(None).cast("string")).select(commits.columns))
        out["conversations"] = self.delete("conversations", own.withColumnRenamed("conversation_id", "id"))
        self.unstage(own, *([gone] if gone is not None else []))
        return out

    def backup(self, ids: DataFrame, to: str) -> dict[str, int]:
        """Selected conversations and all that hangs on them as JSON; rows by table (SNK-14)."""
        out, messages = {}, self.read("messages")
        own = None if messages is None else messages.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(F.col("id").alias("message_id"))
        keys = {"conversations": ids.select("id"), **dict.fromkeys(("messages", *OF_CONVERSATION, "git_commits"), ids.select(F.col("id").alias("conversation_id"))), **dict.fromkeys(OF_MESSAGE, own)}
        for name, key in keys.items():
            df = self.read(name)
            if df is not None and key is not None:
                seen = Observation()
                df.join(key, key.columns, "left_semi").observe(seen, F.count(F.lit(1)).alias("n")).write.json(f"{to}/{name}")
                out[name] = seen.get["n"]
        return out

    def repath(self, name: str, old: str, new: str) -> None:
        """project_path moves from old to new (SNK-15)."""
        df = self.read(name)
        if df is not None:
            self.write(name, df.withColumn("project_path", F.when(F.col("project_path") == old, F.lit(new)).otherwise(F.col("project_path"))))

    def migrate(self, old: str, new: str, alias: bool = True, dry_run: bool = False) -> dict[str, int]:
        """Every table's project_path moves from old to new; rows moved by table (migrate_project). Nothing may stand under ``new`` yet. With ``alias`` the old path still finds the project.

        ``dry_run`` checks and counts alone (SNK-16).
        """
        if not old or not new or old == new:
            raise ValueError("a project moves from one path to another")
        there = [n for n in ("conversations", "working_memory") if (df := self.read(n)) is not None and not df.where(F.col("project_path") == new).isEmpty()]
        if there:
            raise ValueError(f"{new} has rows already in {', '.join(there)}")
        out = {name: df.where(F.col("project_path") == old).count() for name in ("conversations", "working_memory", "session_handoffs", "tags") if (df := self.read(name)) is not None}
        if dry_run:
            return out
        for name, n in out.items():
            if n:
                self.repath(name, old, new)
        if alias:
            made = self.spark.createDataFrame([(old, new)], "alias_path string, canonical_path string").select("alias_path", "canonical_path", F.sha2("canonical_path", 256).alias("project_id"))
            self.upsert("project_aliases", made, ["alias_path"])
        return out

    def bytes(self, name: str) -> int:
        """Size of the files of a table."""
        v, fs = self.version(name), self._fs()
        return sum(fs.getContentSummary(self._path(name, f)).getLength() for folders in v.folders.values() for f in folders) if v else 0

    def compact(self, name: str, file_bytes: int = 128 << 20) -> None:
        """The table rewritten in buckets of about ``file_bytes``, one folder each (SNK-19)."""
        df = self.read(name)
        if df is not None:
            self.write(name, df, buckets=-(-self.bytes(name) // file_bytes) or 1)


def _conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that a table has in the table's types, so that equal keys have equal hashes."""
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns})


def _wider(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both; rows that lack one have null in it."""
    return _as_read(T.StructType([*old.fields, *(f for f in new.fields if f.name not in old.names)]))


def _as_read(kind: T.DataType) -> T.DataType:
    """A type as files give it back: anything may be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_read(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_read(kind.elementType), True)
    return T.MapType(_as_read(kind.keyType), _as_read(kind.valueType), True) if isinstance(kind, T.MapType) else kind
