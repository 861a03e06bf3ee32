"""A stored full-text index: postings in blocks with their maxima, in buckets by term (SNK-7, FTS-5).

A row of the postings table is a block: up to about ``BLOCK`` documents of a term that hold it about as often (powers of two) in
texts of about the same length, with the bounds of both. Adding documents appends blocks for the new ones alone. A search reads the buckets of its terms:
first the bounds only, from which the driver (a few rows a term) knows a score that enough documents reach, then the blocks that can beat it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import search
from sessionloom.sources.store import Tables

BLOCK = 1024
#: Rows up to which ids or groups are broadcast.
SMALL = 1_000_000


class TextIndex:
    """Tables ``<name>_postings``, ``<name>_documents`` and ``<name>_totals`` of a store."""

    def __init__(self, tables: Tables, name: str = "text"):
        self.tables, self.postings, self.documents, self.totals = tables, f"{name}_postings", f"{name}_documents", f"{name}_totals"

    # writing
    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> int:
        """Documents that are not indexed yet, or whose text has changed; how many."""
        t = self.tables
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content_hash")).where("id is not null")
        # texts are moved for ids that come more than once alone
        twice, many = t.staged(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        if many:
            ids = self._small(twice, many)
            rows = rows.join(ids, "id", "left_anti").unionByName(rows.join(ids, "id", "left_semi").dropDuplicates(["id"]))
        known = t.read(self.documents)
        if known is not None:
            rows = rows.join(known.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
        words, n = t.staged(self._counted(rows))
        if n or known is None:
            if known is not None:
                self.remove(words.select("id"))
            lengths = words.select("id", "content_hash", "length")
            counted = words.select("id", F.col("length").cast("int").alias("length"), F.inline(F.arrays_zip("term", "tf")))
            often, size = F.floor(F.log2("tf")).cast("int"), F.floor(F.log2("length")).cast("int")
            counted = counted.withColumn("group", F.xxhash64("term", often, size))
            # groups that fill more than a block; where hashes of groups meet, a block is only smaller
            parts, full = t.staged(counted.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"))
            run = uuid.uuid4().hex
            dealt = counted.join(self._small(parts, full), "group", "left").select("term", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "id", "tf", "length")
            # plain rows are shuffled, by what their group is part of: partial lists of rare terms would be several times as large
            met = dealt.repartition("term", "part").select("term", "part", often.alias("often"), size.alias("size"), "id", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"))
            blocks = self._blocks(met, "often", "size", "part")
            name = F.concat_ws("/", F.lit(run), "often", "size", "part").alias("block")
            t.append(self.postings, blocks.select("term", name, *[c for c in blocks.columns if c not in ("term", "often", "size", "part")]), ["term"], as_dealt=True)
            total = lengths.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
            t.append(self.totals, total.select(F.lit(run).alias("run"), "documents", "tokens"), ["run"])
            t.upsert(self.documents, lengths, ["id"])  # written last: it says that they are indexed
            t.unstage(parts)
        t.unstage(words, twice)
        return n

    @staticmethod
    def _small(df: DataFrame, n: int) -> DataFrame:
        """``df`` (one number or id a row) is sent to all tasks while that is little."""
        return F.broadcast(df) if n <= SMALL else df

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        """id, content_hash, length, and the distinct terms of each text with how often they occur: runs of its sorted tokens, found inside the row."""
        words = rows.select("id", "content_hash", F.sort_array(F.coalesce(T.tokens("text"), F.array().cast("array<string>"))).alias("t"))
        begins = F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i))
        runs = words.select("id", "content_hash", "t", F.filter(begins, lambda i: i.isNotNull()).alias("at"))
        times = F.transform("at", lambda a, k: (F.coalesce(F.get("at", k + 1), F.size("t")) - a))
        return runs.select("id", "content_hash", F.size("t").cast("long").alias("length"), F.transform("at", lambda a: F.get("t", a)).alias("term"), times.alias("tf"))

    @staticmethod
    def _blocks(rows: DataFrame, *by: str) -> DataFrame:
        g = rows.groupBy("term", *by).agg(F.count("*").alias("n"), F.min("tf").alias("low_tf"), F.max("tf").alias("top_tf"), F.min("length").alias("low_length"), F.max("length").alias("top_length"), F.collect_list(F.struct("id", "tf", "length")).alias("docs"))
        return g

    def remove(self, ids: DataFrame) -> int:
        """Documents (id) go from all files of the index; how many were in it."""
        t, known, blocks = self.tables, self.tables.read(self.documents), self.tables.read(self.postings)
        if known is None:
            return 0
        gone, n = t.staged(known.join(ids.select("id").distinct(), "id", "left_semi").select("id", "length"))
        if n:
            every = blocks.select("term", "block", F.explode("docs").alias("d")).select("term", "block", "d.*")
            hit, _ = t.staged(every.join(gone.select("id"), "id", "left_semi").select("term", "block").distinct())
            left, _ = t.staged(self._blocks(every.join(hit, ["term", "block"], "left_semi").join(gone.select("id"), "id", "left_anti"), "block"))
            t.delete(self.postings, hit, left)
            total = gone.agg((-F.count("*")).alias("documents"), (-F.sum("length")).alias("tokens"))
            t.append(self.totals, total.select(F.lit(uuid.uuid4().hex).alias("run"), "documents", "tokens"))
            t.delete(self.documents, gone.select("id"))
            t.unstage(hit, left)
        t.unstage(gone)
        return n

    # reading
    def _of(self, terms: list[str]) -> DataFrame:
        """The blocks of terms, from their buckets."""
        asked = self.tables.spark.createDataFrame([(t,) for t in terms], "term string")
        return self.tables.read_keys(self.postings, asked).where(F.col("term").isin(terms))

    def matching(self, query: str, every: bool = True) -> DataFrame:
        """Ids of the documents that hold all terms of a query, or any (FTS-1, FTS-2); none for an empty query."""
        terms = search.query_terms(query)
        if not terms or self.tables.version(self.postings) is None:
            return self.tables.spark.createDataFrame([], "id string")
        held = self._of(terms).select("term", F.explode("docs.id").alias("id"))
        if len(terms) == 1 or not every:
            return held.select("id").distinct()
        return held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("id")

    def bm25(self, query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of the best documents by BM25 over any term, as :func:`search.bm25` gives it."""
        terms, spark = search.query_terms(query), self.tables.spark
        blocks = self.tables.version(self.postings) and terms and self._of(terms)
        if not blocks:
            return spark.createDataFrame([], "id string, score double")
        n, tokens = self.tables.read(self.totals).agg(F.sum("documents"), F.sum("tokens")).first()
        average = tokens / n if n else 0.0
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        idf = {t: max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for t, d in df.items()}
        if not df:
            return blocks.select(F.col("block").alias("id"), F.lit(0.0).alias("score")).limit(0)

        def score(tf: Column, length: Column) -> Column:
            weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(x)) for t, x in idf.items()])
            return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))

        bounds = blocks.select("term", "n", score(F.col("low_tf"), F.col("top_length")).alias("least"), score(F.col("top_tf"), F.col("low_length")).alias("most"))
        most = {r["term"]: r["most"] for r in bounds.groupBy("term").agg(F.max("most").alias("most")).collect()}
        # a block has one document at least, so the first ``limit`` blocks of a term are enough to find a score that ``limit`` documents reach
        first = bounds.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("least")))).where(F.col("k") <= limit).orderBy("term", "k").collect()
        reached = 0.0
        for t in terms:
            held = 0
            for r in first:
                if r["term"] == t and held < limit:
                    held += r["n"]
                    if held >= limit:
                        reached = max(reached, r["least"])
        others = F.coalesce(*[F.when(F.col("term") == t, F.lit(sum(m for u, m in most.items() if u != t))) for t in most])
        # what a block that is left out holds cannot reach that score with all other terms at their best
        kept = blocks.where(score(F.col("top_tf"), F.col("low_length")) + others >= reached - 1e-9)
        held = kept.select("term", F.explode("docs").alias("d")).select("term", "d.id", score(F.col("d.tf"), F.col("d.length")).alias("s"))
        own = held.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, F.col("s"))).alias(f"s{i}") for i, t in enumerate(terms)])
        total = sum((F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))
        return own.select("id", total.alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)
