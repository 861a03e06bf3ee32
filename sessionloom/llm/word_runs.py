"""Periodic run detection: Main-Lorentz divide and conquer on interned word ids.

The words of a batch of texts are interned to numbers and laid end to end, each text closed by a number of
its own. The row of numbers is halved again and again; every run lies whole in the first segment whose midpoint
it crosses, so a segment of length L needs periods up to L / min_exponent only. For each midpoint m and period p the
Z-values of (m - p, m) and (m, m + p) say how far the words at distance p agree to the right and to the left, which
gives the whole run at once. The Z-values of all midpoints and periods of one level are found together: a first
look at the words leaves few shifts, and these are extended by halving steps over hashes of word ranges. Equal intervals are
one run with the smallest of its periods, which is then compared word by word, so hashes decide nothing.

A run is a stretch of words with smallest period q, at least ``max(min_length, min_exponent * q)`` long, that no
neighbouring word extends. Collapsing drops every word that some run contains after its first q words.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; each row is judged by its own
text, so repeated doc_ids and rows without one need no rule; texts of any length are taken whole (memory in a task is
about 60 bytes for each word of the longest text); an empty table gives an empty result; other columns are carried along, but for
those named runs and collapsed, which are replaced.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, ship, table
from .words import mix, texts_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that are looked at together (a longer text is taken by itself), bytes split at once, shifts extended at once.
BATCH_WORDS, PIECE, SHIFTS = 1 << 18, 1 << 20, 1 << 18

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]), False))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into parts of about PIECE bytes, so that few words are objects at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


class _Ranges:
    """Whether ranges of ``x`` at a distance agree, by sums of scrambled values times powers."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            self.n, self.power = len(x), np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(x), _STEP))))
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * self.power[:-1])))

    def agree(self, a: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
        s = self.sums
        with np.errstate(over="ignore"):
            return (s[a + size] - s[a]) * self.power[p] == s[a + p + size] - s[a + p]

    def z(self, a: np.ndarray, p: np.ndarray, longest: int, right: bool) -> np.ndarray:
        """For each (a, p): how many words from ``a`` on (or before ``a``, to the left) equal those at distance p."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(longest, 1).bit_length()
        while step:
            at = a + got if right else a - got - step
            room = np.flatnonzero(at + p + step <= self.n if right else at >= 0)
            got[room[self.agree(at[room], p[room], step)]] += step
            step >>= 1
        return got


def _shifts(n: int, longest: int, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Midpoints and periods of each level of the halving, in blocks of about SHIFTS."""
    size = 1 << max(min_length - 1, 1).bit_length()
    while size < 2 * n:
        middle = np.arange(size // 2, n, size)
        most = min(size, longest) // min_exponent
        if min(size, longest) >= min_length and most < 1:
            most = 1
        for first in range(1, most + 1, SHIFTS):
            periods = np.arange(first, min(first + SHIFTS, most + 1))
            many = max(1, SHIFTS // len(periods))
            for k in range(0, len(middle), many):
                yield np.repeat(middle[k : k + many], len(periods)), np.tile(periods, len(middle[k : k + many]))
        size *= 2


def _whole(x: np.ndarray, a: int, p: int) -> tuple[int, int]:
    """The stretch of period ``p`` around the pair (a, a + p), by comparing words."""
    apart = np.flatnonzero(x[:-p] != x[p:])
    k = np.searchsorted(apart, a)
    return int(apart[k - 1]) + 1 if k else 0, (int(apart[k]) if k < len(apart) else len(x) - p) + p


def find_runs(x: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of every run of ``x``, by start and period; no run is longer than ``longest``."""
    ranges, found = _Ranges(x), []
    for middle, periods in _shifts(len(x), longest, min_length, min_exponent):
        for back in (True, False):
            a, p = (middle - periods if back else middle), periods
            inside = (a >= 0) & (a + p < len(x))
            inside[inside] = x[a[inside]] == x[a[inside] + p[inside]]
            a, p = a[inside], p[inside]
            # a run of two pairs of its period or more holds the next or the last pair too
            after, before = np.minimum(a + 1, len(x) - 1 - p), np.maximum(a - 1, 0)
            near = ((a + 1 + p < len(x)) & (x[after] == x[after + p])) | ((a > 0) & (x[before] == x[before + p]))
            near |= np.maximum(min_length, min_exponent * p) < p + 2
            a, p = a[near], p[near]
            if not len(a):
                continue
            start, end = a - ranges.z(a, p, longest, False), a + p + ranges.z(a, p, longest, True)
            full = end - start >= np.maximum(min_length, min_exponent * p)
            if full.any():
                # of pairs with the same interval and period one is enough
                rows = np.stack([start[full], end[full], p[full], a[full]], 1)
                found.append(rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]])
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]]
    out, done = {}, None
    for start, end, p, a in rows.tolist():
        if (start, end) == done:  # a multiple of the smallest period
            continue
        if np.array_equal(x[start : end - p], x[start + p : end]):
            out[start, end], done = p, (start, end)
        else:  # hashes of different words were equal
            start, end = _whole(x, a, p)
            if end - start >= max(min_length, min_exponent * p):
                out[start, end] = min(p, out.get((start, end), p))
    return np.array(sorted((s, e - s, p) for (s, e), p in out.items()), np.int64).reshape(-1, 3)


def _interned(texts: list[bytes], ids: list, order) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """(first text, word numbers of each of the next texts, the words by number)."""
    numbers = defaultdict(itertools.count().__next__)
    first, batch, size = 0, [], 0
    for i, text in enumerate(texts):
        parts = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in (piece.split() for piece in pieces(text))]
        words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if order is not None and (places := order(ids[i], len(words))) is not None:
            words = words[places]
        batch.append(words)
        size += len(words)
        if size >= BATCH_WORDS or i + 1 == len(texts):
            yield first, batch, list(numbers)
            numbers = defaultdict(itertools.count().__next__)
            first, batch, size = i + 1, [], 0


def collapsed(texts: list[bytes], ids: list, order=None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and its words that stay, joined by one space."""
    for _, batch, words in _interned(texts, ids, order):
        sizes = np.array([len(b) + 1 for b in batch])
        x = np.concatenate([np.append(b, len(words) + k) for k, b in enumerate(batch)])
        runs = find_runs(x, int(sizes.max()) - 1, min_length, min_exponent)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        own = np.searchsorted(runs[:, 0], np.concatenate((begins, ends[-1:])))
        # +1 where a stretch to drop begins, -1 where one ends
        depth = np.zeros(len(x) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        stays = np.cumsum(depth)[:-1] == 0
        for k, numbers in enumerate(batch):
            mine = runs[own[k] : own[k + 1]] - [begins[k], 0, 0]
            left = numbers[stays[begins[k] : ends[k] - 1]]
            parts = [b" ".join(map(words.__getitem__, left[i : i + BATCH_WORDS].tolist())) for i in range(0, len(left), BATCH_WORDS)]
            yield [tuple(r) for r in mine.tolist()], b" ".join(parts)


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period of each, by start and period) and ``collapsed``, the text without their repetitions.

    ``order(doc_id, n)`` may give the places from which the words of a text of n words are read, in place of 0 to n - 1.
    """
    ship(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    made = [pa.field("runs", _ARROW_RUNS), pa.field("collapsed", pa.string())]

    def run(batches):
        for batch in batches:
            # parts of a bounded number of bytes, so that what goes back is bounded too
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, done + 4 * PIECE)))
                b = batch.slice(at, upto - at)
                out = list(collapsed(texts_of(b.column("text")), b.column("doc_id").to_pylist(), order, min_length, min_exponent))
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in out], _ARROW_RUNS)
                text = pa.array([t for _, t in out], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, runs, text], schema=pa.schema([*b.schema, *made]))
                at = upto

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))


def tail_order(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's order of words: for one doc_id in ten the words from a place on repeat with a period, both drawn by the id's CRC-32."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared without rounding; the first of several; null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUNS.elementType), lambda best, r: F.when(better(best, r), r).otherwise(best))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), order=tail_order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n")))
    top = docs.select("doc_id", "runs", "collapsed", most_repeated(F.col("runs")).alias("top"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: DuckDB: pairs of equal words at a distance, joined to stretches; the widest rows are the equal pairs of a text.
SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
g AS (SELECT *, len(own) AS n, h // 10 AS g, h % 10 = 0 AND len(own) > 0 AS planted FROM t),
a AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, own[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
  OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))),
f AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.i = w.i WHERE f.i IS NULL GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
