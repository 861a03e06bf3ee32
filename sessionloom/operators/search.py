"""Retrieval: exact nearest neighbours, full text, rank fusion, chunk aggregation (VEC, FTS, HYB, AGG-9, SET-2)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from sessionloom.functions import text as T
from sessionloom.functions import vectors as V


def ranked(df: DataFrame, score: str, tie: str, limit: int, rank: str = "rank") -> DataFrame:
    """The ``limit`` best rows with their 1-based rank (WIN-5). The sort is a top-k, so the window sees ``limit`` rows."""
    top = df.orderBy(F.desc(score), F.asc(tie)).limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))


def knn(vectors: DataFrame, query: list[float], limit: int, where: Column | None = None, least: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact k nearest by cosine (VEC-2, VEC-3): filters come first, then one distributed top-k."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("similarity", V.cosine_to(F.col(vector_col), query))
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    return scored.drop(vector_col).orderBy(F.desc("similarity"), F.asc(id_col)).limit(limit)


def knn_join(vectors: DataFrame, queries: DataFrame, limit: int, block_bytes: int = 32 << 20) -> DataFrame:
    """Exact k nearest for each row of ``queries`` (query_id, query), against all vectors. Both sides are measured and dealt into blocks of about ``block_bytes``; a task
    takes a block of each, scores it by matrix products and keeps the best ``limit`` of each query, so k rows a query and block are shuffled, never pairs.

    A product only finds what may be among the best; similarities that rank are summed in the vectors' order in double precision, and equal ones go by vec_id.
    Null vectors, and vectors that hold a null, have no similarity and come last; NaN comes first; 0 when a norm is 0; vectors of unequal length raise.
    """
    measured = lambda df, vector: df.agg(F.sum(8 * F.coalesce(F.size(vector), F.lit(0)) + 24)).first()[0] or 0
    size = measured(vectors, "embedding")
    n_queries = max(1, -(-measured(queries, "query") // block_bytes))
    n_vectors = max(1, -(-size // block_bytes), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, size >> 20))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", F.col("embedding").alias("vector"), dealt("vec_id", n_vectors).alias("_v"), each(n_queries).alias("_q"))
    right = queries.select("query_id", F.col("query").alias("vector"), dealt("query_id", n_queries).alias("_q"), each(n_vectors).alias("_v"))
    schema = K.StructType([K.StructField("query_id", queries.schema["query_id"].dataType), K.StructField("vec_id", vectors.schema["vec_id"].dataType), K.StructField("similarity", K.DoubleType())])
    met = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(_nearest(limit), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _nearest(limit: int, rows: int = 256, columns: int = 4096, slack: float = 1e-9):
    """The task of :func:`knn_join`: the best ``limit`` vectors of a block for each query of a block, by tiles of ``rows`` queries and ``columns`` vectors."""

    def read(column: pa.ChunkedArray):
        """Vectors as a matrix, which of them have no similarity, and their squared lengths."""
        v = pa.chunked_array(column.chunks, column.type).combine_chunks()
        there = v.is_valid().to_numpy(zero_copy_only=False)
        sizes, flat = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64), pc.cast(v.flatten(), pa.float64())
        if len(widths := np.unique(sizes[there])) > 1:
            raise ValueError("vectors differ in length")
        width = int(widths[0]) if len(widths) else 0
        x, unknown = np.zeros((len(v), width)), ~there
        x[there] = pc.fill_null(flat, 0.0).to_numpy().reshape(-1, width) if width else 0.0
        unknown[np.repeat(np.arange(len(v)), sizes)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
        squares = np.zeros(len(v))
        for d in range(width):
            squares += x[:, d] * x[:, d]
        return x, unknown, squares, width if there.any() else None

    def unit(x, unknown, squares):
        """Vectors of length 1 for the products, and which vectors are no matter for products."""
        odd = unknown | ~((squares > 1e-200) & (squares < 1e200))
        return np.where(odd[:, None], 0.0, x / np.sqrt(np.where(odd, 1.0, squares))[:, None]), odd

    def few(x, unknown):
        """Rows without those of equal vectors that ``limit`` rows come before."""
        same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1].ravel() if x.shape[1] else np.zeros(len(x), np.int64)
        same = np.where(unknown, -1, same)
        order = np.argsort(same, kind="stable")
        return np.sort(order[place(same[order]) < limit])

    def place(sorted_keys):
        """Place of each item in its run of equal keys."""
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
        return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(np.append(first, len(sorted_keys))))

    def exact(q, v, i, j):
        """What pairs rank by: the similarity; 2 for NaN, -2 for none."""
        out = []
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            total = np.zeros(len(a))
            for d in range(q[0].shape[1]):
                total += q[0][a, d] * v[0][b, d]
            x, y = q[2][a], v[2][b]
            square = x * y
            length = np.where((square > 0) & (square < np.inf), np.sqrt(square), np.sqrt(x) * np.sqrt(y))
            key = np.where(length == 0, 0.0, np.clip(total / length, -1.0, 1.0)) + 0.0
            out.append(np.where(q[1][a] | v[1][b], -2.0, np.where(np.isnan(key), 2.0, key)))
        return np.concatenate(out) if out else np.zeros(0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            return best(left, right)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("vec_id", "ascending")], null_placement="at_end"))
        v, q = read(left.column("vector")), read(right.column("vector"))
        if v[3] is not None and q[3] is not None and v[3] != q[3]:
            raise ValueError("vectors differ in length")
        if v[3] is None or q[3] is None:  # one side has null vectors only
            v, q = (np.zeros((len(v[0]), 0)), *v[1:]), (np.zeros((len(q[0]), 0)), *q[1:])
        kept = few(v[0], v[1])
        v = tuple(x[kept] for x in v[:3])
        (unit_v, odd_v), (unit_q, odd_q) = unit(*v), unit(*q[:3])
        found = []
        for top in range(0, right.num_rows, rows):
            n = min(rows, right.num_rows - top)
            own = tuple(x[top : top + n] for x in q[:3])
            key, at = np.full((n, limit), -3.0), np.full((n, limit), -1)
            for start in range(0, len(kept), columns):
                score, odd = unit_q[top : top + n] @ unit_v[start : start + columns].T, odd_v[start : start + columns]
                score[:, odd] = -np.inf
                least = key[:, -1]
                if start == 0 and score.shape[1] > limit:
                    least = np.maximum(least, np.partition(score, -limit, axis=1)[:, -limit])
                i, j = np.nonzero((score >= least[:, None] - slack) | odd | odd_q[top : top + n, None])
                if not len(i):
                    continue
                i, j = np.concatenate([i, np.repeat(np.arange(n), limit)]), np.concatenate([j + start, at.ravel()])
                new = len(i) - n * limit
                k = np.concatenate([exact(own, v, i[:new], j[:new]), key.ravel()])
                order = np.lexsort((j, -k, i))
                order = order[place(i[order]) < limit]
                key, at = k[order].reshape(n, limit), j[order].reshape(n, limit)
            i, p = np.nonzero(at >= 0)
            found.append((i + top, kept[at[i, p]], key[i, p]))
        i, j, k = (np.concatenate([f[x] for f in found]) if found else np.zeros(0) for x in range(3))
        similarity = pa.array(np.where(k == 2.0, np.nan, k), mask=k == -2.0, type=pa.float64())
        ids = right.column("query_id").take(pa.array(i.astype(np.int64))), left.column("vec_id").take(pa.array(j.astype(np.int64)))
        return pa.table([*ids, similarity], names=["query_id", "vec_id", "similarity"])

    return run


# full text ---------------------------------------------------------------------------------------------------------


def query_terms(query: str) -> list[str]:
    """Distinct search terms of a query: folded runs of letters and digits (FTS-1, FTS-2)."""
    out, word = [], ""
    for c in T.folded(query) + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


#: Edges of a token, and what lies between two (FTS-6).
_START, _END, _GAP = r"(?<![\p{L}\p{N}\p{M}])", r"(?![\p{L}\p{N}\p{M}])", r"[^\p{L}\p{N}\p{M}]+"


def term_pattern(term: str) -> str:
    """A pattern for a folded term in a lower-case text: each letter with any of its marks. One pass over the text finds it, without cutting the text in tokens."""
    variants = {c: "".join(m for m, p in zip(T.MARKED, T.PLAIN, strict=True) if p == c) for c in set(term)}
    return "".join(f"[{c}{variants[c]}]" + r"\p{M}*" for c in term)


def _lower(text_col) -> Column:
    return F.lower(F.col(text_col) if isinstance(text_col, str) else text_col)


def match_all(text_col, query: str) -> Column:
    """All terms occur (FTS-1); an empty query matches nothing."""
    terms = query_terms(query)
    return reduce(lambda a, b: a & b, [_lower(text_col).rlike(_START + term_pattern(t) + _END) for t in terms]) if terms else F.lit(False)


def match_any(text_col, query: str) -> Column:
    """One term at least occurs (FTS-2)."""
    terms = query_terms(query)
    return _lower(text_col).rlike(_START + "(?:" + "|".join(map(term_pattern, terms)) + ")" + _END) if terms else F.lit(False)


def match_phrase_prefix(text_col, query: str) -> Column:
    """The terms follow each other, the last as a prefix (FTS-3)."""
    terms = query_terms(query)
    return _lower(text_col).rlike(_START + _GAP.join(map(term_pattern, terms))) if terms else F.lit(False)


def bm25(docs: DataFrame, query: str, limit: int, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best documents by BM25 over any term (FTS-5). All texts are measured once; terms are counted only in those that hold one, and no token is shuffled."""
    terms = query_terms(query)
    low = F.coalesce(F.lower(F.col(text_col)), F.lit(""))
    plain = F.when(low.rlike(r"\p{M}"), F.regexp_replace(low, r"\p{M}+", "")).otherwise(low)
    length = F.size(F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    n_and_length = docs.select(length.alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    holding = docs.where(match_any(text_col, query))
    words = holding.select(F.col(id_col).alias("id"), T.tokens(text_col).alias("tokens"))
    counted = words.select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(terms)).alias("found")) if terms else words.select("id", F.lit(0).alias("dl"), F.array().alias("found"))
    counted = counted.select("id", "dl", *[(F.size("found") - F.size(F.array_remove("found", t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    totals = n_and_length.join(counted.agg(F.lit(1).alias("_one"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return counted.join(F.broadcast(totals)).select("id", score.alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def recent_candidates(docs: DataFrame, matches: Column, order: str, limit: int, id_col: str) -> DataFrame:
    """Matches by recency, not relevance (FTS-4)."""
    return docs.where(matches).orderBy(F.desc(order), F.asc(id_col)).limit(limit)


def first_nonempty(*frames: DataFrame) -> DataFrame:
    """The first frame with a row, else the last (FTS-7)."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


# fusion ------------------------------------------------------------------------------------------------------------


def reciprocal_rank_fusion(vector: DataFrame, fts: DataFrame, limit: int, k: int = 60, vector_weight: float = 0.7, fts_weight: float = 0.3, overlap: float | None = 1.2) -> DataFrame:
    """Fuse two ranked lists (id, rank): sum of weight / (k + rank), cut to ``limit``, then a boost for ids in both (HYB-1, HYB-2)."""
    joined = vector.select("id", F.col("rank").alias("vector_rank")).join(fts.select("id", F.col("rank").alias("fts_rank")), "id", "full_outer")
    score = F.coalesce(vector_weight / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(fts_weight / (k + F.col("fts_rank")), F.lit(0.0))
    top = joined.withColumn("score", score).orderBy(F.desc("score"), F.asc("id")).limit(limit)
    if overlap is None:
        return top
    both = F.col("vector_rank").isNotNull() & F.col("fts_rank").isNotNull()
    return top.withColumn("score", F.when(both, F.col("score") * overlap).otherwise(F.col("score"))).orderBy(F.desc("score"), F.asc("id"))


def chunks_to_messages(chunks: DataFrame, least: float) -> DataFrame:
    """Best similarity, number of matched chunks, best chunk's text and the matched chunks, best first, of each message (AGG-9)."""
    hit = chunks.where(F.col("similarity") >= least)
    best = F.max_by("content", F.struct(F.col("similarity"), -F.col("chunk_index")))
    matched = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("chunk_index").alias("i")))), lambda x: x["i"])
    return hit.groupBy("message_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_chunks"), best.alias("snippet"), matched.alias("matched_chunks"))


def merge_hits(chunk_hits: DataFrame, message_hits: DataFrame, limit: int) -> DataFrame:
    """Chunk hits, replaced by message hits that are strictly better, plus the rest (SET-2)."""
    c, m = chunk_hits.select("message_id", F.col("similarity").alias("c")), message_hits.select("message_id", F.col("similarity").alias("m"))
    both = c.join(m, "message_id", "full_outer")
    better = F.col("c").isNull() | (F.col("m") > F.col("c"))
    out = both.select("message_id", F.when(better, F.col("m")).otherwise(F.col("c")).alias("similarity"), F.when(better, F.lit("message")).otherwise(F.lit("chunk")).alias("origin"))
    return out.orderBy(F.desc("similarity"), F.asc("message_id")).limit(limit)


def without_near_repeats(hits: DataFrame, limit: int, least: float = 0.7) -> DataFrame:
    """Greedy removal of hits whose words are like those of a better one (HYB-3): a fold over the ``limit`` rows that a top-k leaves."""
    top = hits.orderBy(F.desc("similarity"), F.asc("id")).limit(limit)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("id"), F.col("content"), T.word_set("content").alias("w")))).alias("rows"))
    empty = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", empty, lambda acc, r: F.when(F.exists(acc, lambda a: T.jaccard(a["w"], r["w"]) >= least), acc).otherwise(F.concat(acc, F.array(r))))
    return packed.select(F.explode(kept).alias("r")).select(F.col("r.id").alias("id"), (-F.col("r.s")).alias("similarity"), F.col("r.content").alias("content"))


def by_conversation(hits: DataFrame) -> DataFrame:
    """Score and number of hits by conversation (AGG-8)."""
    return hits.groupBy("conversation_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_hits"))


def sessions_of(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Conversations of ``hits`` (id, conversation_id, similarity) with their message ids, best first, by page (AGG-8)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), lambda x: x["id"])
    g = hits.groupBy("conversation_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_hits"), ids.alias("message_ids"))
    return g.orderBy(F.desc("similarity"), "conversation_id").offset(offset).limit(limit)
