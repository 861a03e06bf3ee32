"""Benchmark decontamination with spaced seeds.

A mask fixes which of a run of words are read; the others may differ. Every place of every text is hashed
under each mask and joined with the hashes of the benchmark items. Each hit names an item and a diagonal
(place in the document less place in the item); on it the words are compared: the overlap counts
if some window of ``WINDOW`` words of the diagonal has ``LEAST`` equal words at least. For an item of fewer words
than ``WINDOW`` the same share of its own words is asked for, rounded up.

A mask is built by doubling: pairs of words, then pairs of pairs, so that a mask of four words is given by two
distances. Together the masks miss nothing: however the words that differ lie, every overlap that counts, of
items of ``SHORTEST`` words or more, is hit by one of them (a test goes through all cases). An item of fewer words, but ``LEAST_WORDS``
at least, counts where it occurs whole: runs of as many words are hashed for the lengths that the benchmark has.

The benchmark is broadcast when its seeds are ``BROADCAST_ROWS`` rows at most, which is counted, and so are the ids of the documents that
are hit; beyond that Spark joins by shuffle on the hash or the row. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Defined cases: null and empty texts are clean; items of fewer than ``LEAST_WORDS`` words make no contamination, as
everyday phrases are such copies; items that occur twice count under both ids; rows that repeat a
doc_id share the verdict of all of them; rows without doc_id are not looked at and stay; without items every document is clean; other columns are carried along by
:func:`drop_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, ascii_lower, stored, table

#: Distances of the doublings: words read are all sums of subsets.
MASKS = ((1, 2), (1, 3), (1, 5))
WINDOW, LEAST, SHORTEST, LEAST_WORDS = 16, 12, 8, 4
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """array<long>: a hash of each word."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WS_CLASS + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def least_equal(n_words: Column) -> Column:
    """Equal words that an overlap with an item of ``n_words`` words needs."""
    return F.ceil(F.least(n_words, F.lit(WINDOW)) * LEAST / WINDOW)


def _paired(salt: int):
    return lambda a, b: F.xxhash64(F.lit(salt), a, b)


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, seed) of rows with ``words``.

    Each doubling is a column of its own, made once and shared by the masks that begin alike; the arrays of all
    masks are then exploded as one.
    """
    at_least = lambda n: F.greatest(F.col("width") - n, F.lit(0))
    out, made = rows.select(key, "words", F.size("words").alias("width")), {(): "words"}
    for depth in range(1, len(MASKS[0]) + 1):
        new = {}
        for m in {m[:depth] for m in MASKS}:
            source, by, before = F.col(made[m[:-1]]), m[-1], sum(m[:-1])
            left = F.slice(source, F.lit(1), at_least(before + by))
            right = F.slice(source, F.lit(by + 1), at_least(before + by))
            name = made[m] = "m" + "_".join(map(str, m))
            new[name] = F.zip_with(left, right, _paired(hash(m)))
        out = out.select(*out.columns, *[c.alias(n) for n, c in new.items()])
    spans = [sum(m) for m in MASKS]
    first = [F.lit(0)]
    for s in spans[:-1]:
        first.append(first[-1] + at_least(s))
    out = out.select(key, *[f.alias(f"f{i}") for i, f in enumerate(first)], F.posexplode(F.concat(*[F.col(made[m]) for m in MASKS])).alias("at", "seed"))
    place = reduce(lambda a, i: F.when(F.col("at") >= F.col(f"f{i}"), F.col("at") - F.col(f"f{i}")).otherwise(a), range(1, len(MASKS)), F.col("at"))
    return out.select(key, place.alias("place"), "seed")


def runs(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, place, n, seed) of all runs of n words, for each of the lengths."""
    words = F.col("words")
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct((i - 1).alias("place"), F.lit(n).alias("n"), F.xxhash64(F.slice(words, i, F.lit(n))).alias("seed"))))
    none = F.array().cast("array<struct<place:int,n:int,seed:bigint>>")
    return rows.select(key, F.explode(F.concat(*[F.coalesce(of(n), none) for n in lengths])).alias("r")).select(key, "r.*")


def _hinted(ids: DataFrame) -> DataFrame:
    """Stored ids, to be broadcast if they are BROADCAST_ROWS at most, which is counted: then the texts that they are joined with stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched): the most equal words in a window, for each document and item that overlap."""
    items = stored(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= LEAST_WORDS))
    item_seeds = stored(seeds(items.where(F.size("words") >= SHORTEST), "item_id").select("item_id", F.col("place").alias("item_place"), "seed"))
    hint = F.broadcast if item_seeds.count() <= BROADCAST_ROWS else (lambda df: df)
    # a row is known by doc_id and text, as rows may repeat a doc_id
    docs = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("row"), "text")
    hashed = docs.select("row", word_hashes(F.col("text")).alias("words"))
    hits = seeds(hashed, "row").join(hint(item_seeds), "seed").select("row", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"))
    short = items.where(F.size("words") < SHORTEST)
    lengths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())
    if lengths:  # a whole run is the item itself, so its place is the diagonal
        whole = short.select("item_id", F.size("words").alias("n"), F.xxhash64("words").alias("seed"))
        hits = hits.unionByName(runs(hashed, "row", lengths).join(_hinted(whole), ["n", "seed"]).select("row", "item_id", F.col("place").alias("diagonal")))
    hits = stored(hits.distinct())
    touched = docs.join(_hinted(stored(hits.select("row").distinct())), "row", "left_semi").select("row", word_hashes(F.col("text")).alias("doc_words"))
    # the document's words come last and are cut to the item's span at once: what a row holds is bounded by the item
    pairs = hits.join(hint(items.withColumnRenamed("words", "item_words")), "item_id").join(touched, "row")
    start, end = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("item_words"), F.size("doc_words") - F.col("diagonal"))
    own = F.slice("item_words", start + 1, end - start)
    theirs = F.slice("doc_words", start + F.col("diagonal") + 1, end - start)
    equal = pairs.select("row.doc_id", "item_id", least_equal(F.size("item_words")).alias("least"), F.zip_with(own, theirs, lambda a, b: F.when(a == b, 1).otherwise(0)).alias("equal"))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("equal") - WINDOW + 1)), lambda i: F.aggregate(F.slice("equal", i, WINDOW), F.lit(0), lambda s, x: s + x))
    best = equal.select("doc_id", "item_id", "least", F.array_max(sums).alias("matched"))
    return best.where(F.col("matched") >= F.col("least")).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that holds benchmark text: doc_id, items (ids, ascending), matched."""
    return overlaps(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold benchmark text."""
    found = stored(contaminated(docs, benchmark).select("doc_id"))
    return docs.join(_hinted(found), "doc_id", "left_anti").select(docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that holds benchmark text: doc_id, contaminated (true), n_items, items (ids joined by a comma), matched (most equal words in a window)."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.col("matched").cast("long").alias("matched"))
