"""MinHash near-dedup with min-max hashing.

Each permutation gives two values, the smallest and the largest hash of a document's shingles, so one
hash evaluation serves both and the signature's estimate has less variance. Signatures are cut into bands
of ``ROWS`` values; documents that agree on a band share a bucket.

1. Documents with the same shingle set are one class, named by its first hash; its smallest doc_id stands for it.
2. In each bucket every member is paired with the bucket's smallest member (a star, not all pairs). Pairs
   are confirmed on the full shingle sets, confirmed links give connected components.
3. Buckets that still hold several components are compared whole. Their members are gathered by the bucket's main
   (largest) component, each once, and packed in blocks of ``BLOCK``; the blocks of members outside the
   main component meet all blocks. A task filters a pair of blocks by signatures and confirms on the full sets,
   so only links leave it, not pairs.

Step 3 leaves no pair out that a bucket holds: pairs inside one component need no link, and any other pair
has an end outside the main component. A pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^32 < 1e-7; the signature filter of step 3 lies more than five standard deviations below the threshold.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are each judged by their own text, and where one of them is linked to
a smaller doc_id only that row is not kept; rows without doc_id are linked with nothing, have no component and are
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, settled, ship, stored, table
from .words import batch_words, mix, ngrams, texts_of

PERMUTATIONS, BANDS, ROWS = 64, 32, 4  # 64 minima and 64 maxima make 32 bands of 4 values
BLOCK = 64
#: Share of agreeing signature values below which a pair of step 3 is not confirmed on sets.
LEAST_AGREEMENT = 0.62

_A = mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)
_B = mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(1011))


def shingle_sets(texts: list[bytes], words: int):
    """Yields the sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for _, hashes, offsets in batch_words([t.lower() for t in texts]):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.unique(ngrams(hashes[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64)


def set_hashes(shingles: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits of a shingle set."""
    with np.errstate(over="ignore"):
        return mix(shingles).sum(dtype=np.uint64).view(np.int64), mix(shingles ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)


def text_hash(text: Column) -> Column:
    """Which text a row has, among rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signature(shingles: np.ndarray) -> np.ndarray:
    """uint32 values: minimum and maximum of each permutation in turn."""
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            h = ((shingles[i : i + 4096, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
            low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    return np.stack([low, high], 1).ravel()


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1 and h2 (128-bit hash of the shingle set), sig (binary), bands (array<long>)."""
    ship(docs.sparkSession)

    def run(batches):
        band_seed = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                n, h1, h2, sig, bands = [], [], [], [], []
                for s in shingle_sets(texts_of(b.column("text")), words):
                    n.append(len(s))
                    pair = set_hashes(s)
                    h1.append(int(pair[0]))
                    h2.append(int(pair[1]))
                    with np.errstate(over="ignore"):
                        x = signature(s) if len(s) else np.zeros(2 * PERMUTATIONS, np.uint32)
                        rows, key = x.reshape(BANDS, ROWS).astype(np.uint64), band_seed.copy()
                        for k in range(ROWS):
                            key = mix(key * np.uint64(31) + rows[:, k])
                    sig.append(x.tobytes())
                    bands.append(key.view(np.int64) if len(s) else np.zeros(0, np.int64))
                arrays = [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", "bands"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """node (first hash of the set) and its whole shingle set (array<long>)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sets = [s.view(np.int64) for s in shingle_sets(texts_of(b.column("text")), words)]
                nodes = [int(set_hashes(s.view(np.uint64))[0]) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    size_ok = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return pairs.join(left, "a").join(right, "b").where(size_ok & (100 * both >= percent * (F.size("sa") + F.size("sb") - both))).select("a", "b")


class _Block:
    """Members of one packed block, as arrays."""

    def __init__(self, members: pa.ListArray, row: int):
        a, b = members.offsets[row].as_py(), members.offsets[row + 1].as_py()
        rows = members.values.slice(a, b - a)
        self.ids, self.comps = rows.field("rep").to_numpy(), rows.field("comp").to_numpy()
        self.sigs = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint32).reshape(b - a, -1)
        sets = rows.field("shingles")
        self.starts = sets.offsets.to_numpy()
        self.sizes = np.diff(self.starts)
        self.values = sets.values.to_numpy().view(np.uint64)  # sorted as unsigned

    def set_of(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i + 1]]


def _cross_links(blocks: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (a, b) between different components, from pairs of blocks (m, m2): signatures choose the pairs, whole sets confirm them.

    One link for a member and a component of the other block is enough, so no more come out.
    """
    ship(blocks.sparkSession)

    def links(x: _Block, y: _Block):
        for i in range(len(x.ids)):
            near = np.flatnonzero(y.comps != x.comps[i])
            near = near[(y.sigs[near] == x.sigs[i]).mean(1) >= least] if len(near) else near
            if not len(near):
                continue
            own = x.set_of(i)
            size = y.sizes[near]
            near = near[100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own))]
            if not len(near):
                continue
            size = y.sizes[near]
            theirs = np.concatenate([y.set_of(j) for j in near])
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[at] == theirs).astype(np.int64), np.cumsum(size) - size)
            linked = near[100 * both >= percent * (len(own) + size - both)]
            for j in linked[np.unique(y.comps[linked], return_index=True)[1]]:
                yield min(x.ids[i], y.ids[j]), max(x.ids[i], y.ids[j])

    def run(batches):
        for b in batches:
            found = [link for r in range(b.num_rows) for link in links(_Block(b.column("m"), r), _Block(b.column("m2"), r))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _least_of_classes(docs: DataFrame, feats: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """h1, h2 and the smallest doc_id of the component of each class."""
    # the class's first hash names it from here on: a doc_id may have several texts
    reps = feats.join(classes.withColumnRenamed("first", "doc_id"), ["doc_id", "h1", "h2"]).dropDuplicates(["h1"]).withColumn("rep", F.col("h1"))
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1")
    members = stored(banded.join(buckets.select("band", "center"), "band"))
    near = stored(members.select("rep").distinct())
    first = classes.join(near, classes["h1"] == near["rep"], "left_semi").select(F.col("first").alias("doc_id")).distinct()
    sets = stored(sets_of(docs.join(first, "doc_id", "left_semi"), words).join(near.withColumnRenamed("rep", "node"), "node", "left_semi").dropDuplicates(["node"]))
    links = stored(confirmed(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent))
    comps = connected(links, "a", "b")
    # buckets with several components: what shares a bucket with a main component meets that component and all else that does
    labelled = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("size")).where("comps > 1 and size > 2").select("band", F.col("top.comp").alias("main"))
    mixed = stored(labelled.join(main, "band").select("main", "rep", "comp").distinct())
    parts = mixed.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    full = mixed.join(parts, "main").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).join(reps.select("rep", "sig"), "rep").join(sets.withColumnRenamed("node", "rep"), "rep")
    full = stored(full.select("main", "part", "rep", "comp", "sig", "shingles"))
    packed = lambda df, part, m: df.groupBy("main", F.col("part").alias(part)).agg(F.collect_list(F.struct("rep", "comp", "sig", "shingles")).alias(m))
    outside = full.where("comp <> main")
    # pairs of blocks are dealt by the second block, so one group's pairs spread over as many tasks as it has blocks
    pairs = outside.select("main", "part").distinct().join(parts, "main").select("main", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part2"))
    blocks = pairs.join(packed(outside, "part", "m"), ["main", "part"]).join(packed(full, "part2", "m2"), ["main", "part2"]).select("m", "m2")
    more = stored(_cross_links(blocks, percent, LEAST_AGREEMENT))
    comps = connected(links.unionByName(more), "a", "b")
    linked = stored(classes.join(comps, classes["h1"] == comps["node"]).select("h1", "h2", "component", "first"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("least"))
    return classes.join(linked.join(smallest, "component").select("h1", "h2", "least"), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, text_hash (of :func:`text_hash`)."""
    docs = docs.select("doc_id", "text")
    feats = stored(features(docs, words))
    classes = stored(feats.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")))
    # written first: then both sides of the last join are exchanged by themselves, and Spark can split the rows of a large class
    of_class = settled(lambda: _least_of_classes(docs, feats, classes, words, percent))
    out = feats.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("text_hash")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+3], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
