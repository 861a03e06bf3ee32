"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pair of nearest centroids is a
vector's cell in the grid of both codebooks. A vector looks into its own cell and into the cells nearest to it: the centroids
of each half are sorted by how far the vector is from their side of the border to its own centroid, and the two
sequences are walked together while the sum of both squared distances is at most a reach. The reach is measured,
not set: it is the least one with which ``recall`` of ``PLANTED`` planted neighbours at just the cosine asked for, and ``recall``
of the real links between as many vectors of a sample, are met. Cells are ordered by their number and a vector looks into higher ones only, so no pair
of vectors meets twice and links can be counted without writing pairs down.

1. Rows with the same vector are one class, named by a number; classes of valid vectors are written once.
2. The codebooks (k-means) and the reach are fitted on ``SAMPLE`` classes at most, the first by a hash; every class is indexed. The
   number of centroids follows from the number of classes, so that a cell has about ``CELL_ROWS``, up to ``MAX_CENTROIDS``.
3. What lies in a cell and what looks into it is packed in blocks of ``BLOCK`` vectors. A task takes a pair of blocks,
   computes all its cosines in double precision as one product, and gives for each vector the number of its links and the
   smallest member of its group inside the pair: rows grow with vectors, not with pairs. A hot cell is many blocks and so many tasks.
4. Links are summed by class; groups are joined to components, named by their smallest vec_id.

The broadcast is 2 * MAX_CENTROIDS half vectors, the sample SAMPLE vectors, at any input size. A group of vectors that are near but not equal costs the square of its
distinct vectors in numpy (not in rows), as each of its links is counted.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are linked with nothing and are components of their own; vectors are compared
with those of the same length only; equal vectors are linked; rows that repeat a vec_id are vectors of their own, linked as any other; rows
without vec_id are linked with nothing, have no component and are kept; an empty table gives an empty result; other columns, labels too, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, settled, ship, stored, table

COSINE, RECALL = 0.95, 1.0
SAMPLE, PLANTED, MAX_CENTROIDS, CELL_ROWS, BLOCK = 20_000, 2_000, 1_024, 1_024, 512


class Grid:
    """Two codebooks, and how far from a vector the cells are that it looks into."""

    def __init__(self, sample: np.ndarray, centroids: int, cosine: float = COSINE, recall: float = RECALL):
        rng = np.random.default_rng(13)
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(part, centroids, rng) for part in self._halves(sample)]
        self.reach = self._measured(sample[rng.permutation(len(sample))[:PLANTED]], cosine, recall, rng)

    def _halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.half], unit[:, self.half :]

    def _borders(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest centroid, and the squared distance to the border of each other centroid's side."""
        out = []
        for part, book in zip(self._halves(unit), self.books, strict=True):
            far = (book**2).sum(1) - 2 * part @ book.T
            own = far.argmin(1)
            apart = np.sqrt(np.maximum(((book[:, None, :] - book[None, :, :]) ** 2).sum(2) if len(book) <= 64 else _squares(book), 1e-30))
            out.append((own, ((far - far[np.arange(len(own)), own][:, None]) / (2 * apart[own])) ** 2))
            out[-1][1][np.arange(len(own)), own] = 0
        return out

    def cells(self, unit: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self._borders(unit)
        return a * len(self.books[1]) + b

    def _measured(self, unit: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> float:
        """The reach that finds ``recall`` of planted neighbours at ``cosine``, and of the links inside ``unit``."""
        if not len(unit) or len(self.books[0]) * len(self.books[1]) == 1:
            return 0.0
        (_, b1), (_, b2) = self._borders(unit)
        side = rng.standard_normal(unit.shape)
        side -= (side * unit).sum(1, keepdims=True) * unit
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        near = cosine * unit + np.sqrt(max(0.0, 1 - cosine**2)) * side / np.maximum(norm, 1e-30)
        rows = np.arange(len(unit))
        c1, c2 = np.divmod(self.cells(near), len(self.books[1]))
        reach = float(np.quantile(b1[rows, c1] + b2[rows, c2], recall, method="higher"))
        x, y = np.nonzero(unit @ unit.T >= cosine)
        if (other := x != y).any():
            c1, c2 = np.divmod(self.cells(unit), len(self.books[1]))
            reach = max(reach, float(np.quantile(b1[x[other], c1[y[other]]] + b2[x[other], c2[y[other]]], recall, method="higher")))
        return reach

    def looks(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and the higher cells that it looks into."""
        (a, b1), (b, b2) = self._borders(unit)
        width, out = len(self.books[1]), []
        own = a * width + b
        for k in range(len(unit)):
            first, second = (np.flatnonzero(x[k] <= self.reach) for x in (b1, b2))
            first, second = first[np.argsort(b1[k, first])], second[np.argsort(b2[k, second])]
            # both sequences ascend: the further along the first, the fewer of the second
            upto = np.searchsorted(b2[k, second], self.reach - b1[k, first], side="right")
            visited = np.concatenate([i * width + second[:n] for i, n in zip(first, upto, strict=True)])
            out.append(visited[visited > own[k]])
        return own, out


def _squares(book: np.ndarray) -> np.ndarray:
    n = (book**2).sum(1)
    return n[:, None] + n[None, :] - 2 * book @ book.T


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centroids of ``rows``."""
    book = np.unique(rows[rng.permutation(len(rows))[:k]], axis=0)
    for _ in range(rounds):
        own = np.concatenate([((book**2).sum(1) - 2 * rows[i : i + 4096] @ book.T).argmin(1) for i in range(0, len(rows), 4096)])
        n = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, rows)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return np.unique(book, axis=0)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision from rows of packed numbers, single or double."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * width * len(column) else np.float64).reshape(-1, width).astype(np.float64)
    return x / np.linalg.norm(x / (scale := np.abs(x).max(1, keepdims=True)), axis=1, keepdims=True) / scale


def _valid(vector: Column) -> Column:
    """Not null or empty, every component a finite number, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame) -> DataFrame:
    """vec_id, dim and vec (the components packed as they are, single or double) of valid rows."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            v = b.column("v")
            values, sizes = v.flatten().to_numpy() + np.float32(0), np.diff(v.offsets.to_numpy())  # -0.0 becomes 0.0
            raw, wide = values.tobytes(), values.itemsize
            vec = [raw[e - wide * n : e] for e, n in zip((np.cumsum(sizes) * wide).tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(sizes.astype(np.int32)), pa.array(vec, pa.binary())], names=["vec_id", "dim", "vec"])

    return rows.mapInArrow(run, "vec_id long, dim int, vec binary")


def _sampled(classes: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Unit vectors of ``sample`` classes at most, by length."""
    got = classes.orderBy(F.xxhash64("vec"), "node").limit(sample).select("dim", "vec").toArrow()
    dims = np.array(got.column("dim").to_pylist(), np.int64)
    return {int(d): _unit(got.column("vec").combine_chunks().filter(pa.array(dims == d)), int(d)) for d in np.unique(dims)}


def _coded(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """node, n, dim, vec, cell and looks (array of higher cells) of each class."""
    spark = classes.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(grids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                dims = b.column("dim").to_numpy()
                cell, looks = np.zeros(len(dims), np.int64), [np.zeros(0, np.int64)] * len(dims)
                for d in np.unique(dims).tolist():
                    if (grid := shared.value.get(d)) is not None:  # else one cell
                        rows = np.flatnonzero(dims == d)
                        cell[rows], found = grid.looks(_unit(b.column("vec").take(pa.array(rows)), d))
                        for r, f in zip(rows, found, strict=True):
                            looks[r] = f
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(looks, pa.list_(pa.int64()))], names=[*b.schema.names, "cell", "looks"])

    return classes.mapInArrow(run, "node long, n long, dim int, vec binary, cell long, looks array<long>")


def _links(pairs: DataFrame, cosine: float) -> DataFrame:
    """node, links and root of the linked vectors of each pair of blocks (x, y); y is null where a block meets itself."""
    ship(pairs.sparkSession)

    def members(column: pa.Array, row: int, width: int):
        a, b = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
        rows = column.values.slice(a, b - a)
        return rows.field("node").to_numpy(), rows.field("n").to_numpy(), _unit(rows.field("vec"), width)

    def rooted(mask: np.ndarray, x: np.ndarray, y: np.ndarray):
        """The smallest node of each member's group."""
        most = np.iinfo(np.int64).max
        while True:
            low_y = np.minimum(y, np.where(mask, x[:, None], most).min(0))
            low_x = np.minimum(x, np.where(mask, low_y[None, :], most).min(1))
            if np.array_equal(low_x, x) and np.array_equal(low_y, y):
                return x, y
            x, y = low_x, low_y

    def run(batches):
        for b in batches:
            out = [np.zeros((0, 3), np.int64)]
            for r in range(b.num_rows):
                width = b.column("dim")[r].as_py()
                own, n, x = members(b.column("x"), r, width)
                within = not b.column("y")[r].is_valid
                other, m, y = (own, n, x) if within else members(b.column("y"), r, width)
                mask = x @ y.T >= cosine
                if within:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                root, root_y = rooted(mask, own, other)
                some = mask.any(1)
                out.append(np.stack([own, mask @ m, root], 1)[some])
                if not within:
                    some = mask.any(0)
                    out.append(np.stack([other, mask.T @ n, root_y], 1)[some])
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["node", "links", "root"])

    return pairs.mapInArrow(run, "node long, links long, root long")


def _blocks(coded: DataFrame) -> DataFrame:
    """Pairs of blocks (dim, x, y) whose vectors are to be compared."""
    member = coded.select("dim", "cell", F.lit(0).alias("role"), "node", "n", "vec")
    looking = coded.select("dim", F.explode("looks").alias("cell"), F.lit(1).alias("role"), "node", "n", "vec")
    there = member.select("dim", "cell").distinct()
    entries = member.unionByName(looking.join(there, ["dim", "cell"], "left_semi"))
    parts = stored(entries.groupBy("dim", "cell", "role").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    dealt = entries.join(parts, ["dim", "cell", "role"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = stored(dealt.groupBy("dim", "cell", "role", "part").agg(F.collect_list(F.struct("node", "n", "vec")).alias("block")))
    own = blocks.where("role = 0").select("dim", "cell", "part", F.col("block").alias("x"))
    # which blocks meet is worked out without their vectors; pairs are dealt by the second block, so a hot cell's spread over many tasks
    names = blocks.select("dim", "cell", "role", "part")
    first = names.where("role = 0").select("dim", "cell", F.col("part").alias("part"))
    pairs = first.join(names.select("dim", "cell", "role", F.col("part").alias("part2")), ["dim", "cell"]).where("role = 1 or part < part2")
    met = pairs.join(own, ["dim", "cell", "part"]).join(blocks.select("dim", "cell", "role", F.col("part").alias("part2"), F.col("block").alias("y")), ["dim", "cell", "role", "part2"])
    return own.select("dim", "x", F.lit(None).cast(blocks.schema["block"].dataType).alias("y")).unionByName(met.select("dim", "x", "y"))


def _components(classes: DataFrame, cosine: float, recall: float) -> DataFrame:
    """node, links (to vectors of other classes) and least (the smallest vec_id of the component) of each class that is linked."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(64).toLocalIterator()}
    # of tables with very many vector lengths the rarer ones are one cell each
    sample = {d: rows for d, rows in _sampled(classes, SAMPLE).items() if d in counts and d > 1}
    grids = {d: Grid(rows, int(min(MAX_CENTROIDS, max(1, np.ceil(np.sqrt(counts[d] / CELL_ROWS))))), cosine, recall) for d, rows in sample.items()}
    coded = stored(_coded(classes.select("node", "n", "dim", "vec"), grids))
    found = stored(_links(_blocks(coded), cosine))
    comps = connected(found.where("node <> root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stored(links.join(comps, "node").join(classes.select("node", "first"), "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    return named.join(least, "component").select("node", "links", "least")


def near_vectors(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vec_id`` and ``embedding``."""
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & _valid(F.col("v"))
    keys = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")]
    packed = _packed(rows.where(good))
    grouped = packed.select("vec_id", "dim", "vec", *keys).groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    of_node = settled(lambda: _components(classes, cosine, recall))
    of_class = settled(lambda: classes.select("h1", "h2", "first", "n", "node").join(of_node, "node", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")))
    linked = packed.select("vec_id", *keys).join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: DuckDB: every pair, so for small tables only.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
