"""Substring dedup with an FM-index per shard.

A window is 50 consecutive words of a document. It is repeated when its words also start in a document with
a smaller doc_id; each word that a repeated window covers is removed.

1. Each window belongs to its minimiser, the leftmost smallest hash among its runs of ``GRAM`` words. Windows
   that follow each other and share the minimiser's place form a segment. Equal windows have equal
   minimisers, so equal windows are always found under one minimiser.
2. Equal segments are one class; its smallest doc_id stands for it. In the class's other documents every
   window of the segment is repeated.
3. Classes that share their minimiser with another class go, with their words, to a shard by minimiser. Where more
   than ``HOT_CLASSES`` share one (a passage that many documents hold in different surroundings), each is first cut
   to the words around the minimiser that another class has too, counted by a grouped sum over all
   lengths of context: what is left is equal for most of them and goes once. No repeated window is cut off,
   as both its contexts occur in another class.
   The shard's index is the Burrows-Wheeler transform of its segments in a wavelet matrix of packed
   bits with rank counts in two steps (:class:`Bits`). Segments stream through it from right to left: one backward step adds a
   word at the left; before it, the interval is widened to the suffixes that share the 49 words that stay.
   So each window's matching statistic reaches 50 after one step, and the smallest doc_id in the interval says
   whether a smaller document holds the window.
4. Repeated intervals come back to their documents by a join on the class.

Words are compared as 64-bit hashes, segments as 128-bit hashes.

Defined cases: null and empty texts have no words; documents of fewer than 50 words lose nothing; a passage
repeated inside one document only is kept; rows that repeat a doc_id never remove each other, and each loses what is
repeated in its own text; rows without doc_id neither lose words nor make others lose any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, ship, stored, table
from .words import batch_words, mix, ngrams, texts_of

WINDOW, GRAM = 50, 8
#: Words of a shard's index, about.
SHARD_WORDS = 1_000_000
#: Classes of a minimiser beyond which they are cut to shared context first.
HOT_CLASSES = 500
_U = np.uint64
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(1, _U)
        return np.cumprod(np.concatenate((one, np.full(n, _STEP, _U)))), np.cumprod(np.concatenate((one, np.full(n, _BACK, _U))))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, from prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(values))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(values * up[:-1], dtype=_U)))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def segments(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, start, windows, minimiser, h1, h2) arrays of the segments of consecutive texts; start counts in its text."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none, none, none
    grams = ngrams(hashes, gram)
    low = _U((1 << 24) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=_U)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    at = (m & low).astype(np.int64)  # place of the minimiser of each window
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.arange(len(at))
    valid = np.flatnonzero(first + window <= offsets[1:][owner[: len(at)]])
    if not len(valid):
        return none, none, none, none, none, none
    new = np.concatenate(([True], (at[valid][1:] != at[valid][:-1]) | (owner[valid][1:] != owner[valid][:-1])))
    begin = np.flatnonzero(new)
    starts, counts = valid[begin], np.diff(np.concatenate((begin, [len(valid)])))
    ends = starts + counts + window - 1
    h1, h2 = span_hashes(hashes, starts, ends), span_hashes(mix(hashes ^ _U(0x5851F42D4C957F2D)), starts, ends)
    return owner[starts], starts - offsets[owner[starts]], counts, grams[at[starts]].view(np.int64), h1.view(np.int64), h2.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text; both together tell rows apart that repeat a doc_id."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def segment_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n (windows), mini, h1, h2 of each segment of each document."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, own = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for first, hashes, offsets in batch_words(texts_of(batch.column("text"))):
                text, start, n, mini, h1, h2 = segments(hashes, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[first + text], own[first + text], start.astype(np.int32), n.astype(np.int32), mini, h1, h2)], names=["doc_id", "text_hash", "start", "n", "mini", "h1", "h2"])

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, start int, n int, mini long, h1 long, h2 long")


class Bits:
    """A vector of bits with the number of ones before each place, in 1.31 bits a bit.

    Ones are counted up to each 512 bits (32 bits a count) and, inside those, up to each 64 bits (16 bits a count).
    """

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(n + 512 - n % 512, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        ones = np.bitwise_count(self.words).reshape(-1, 8).astype(np.uint16)
        inside = np.cumsum(ones, axis=1, dtype=np.uint16)
        self.inside = (inside - ones).ravel()
        totals = np.cumsum(inside[:, -1], dtype=np.int64)
        assert not len(totals) or totals[-1] < 2**32, "a shard holds fewer than 2^32 words"
        self.blocks = np.concatenate(([0], totals[:-1])).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.inside.nbytes + self.blocks.nbytes

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        word = i >> 6
        part = np.bitwise_count(self.words[word] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))
        return self.blocks[i >> 9].astype(np.int64) + self.inside[word] + part


class FMIndex:
    """Backward search over sequences of words, exact for patterns of up to ``depth`` words.

    ``docs`` gives the doc_id of each sequence. Suffixes are sorted by their first 64 words, which is enough for
    patterns of up to 63; the suffix array itself is not kept.

    What is kept, a word: 1.31 bits for each bit of a symbol, 1.31 bits for each of two vectors that mark where another pattern
    begins, and 4 bytes for each distinct pattern of ``depth - 1`` words and 4 for each of ``depth``, so 9 bytes and 1.31 bits a symbol bit
    at most, beside 24 bytes for each distinct word and 8 for each document (:attr:`nbytes`). The symbols' bits are not coded by frequency.
    """

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, depth: int = WINDOW):
        self.symbols, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        lengths = np.array([len(s) for s in sequences])
        text = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # 0 ends each sequence
        place = np.ones(len(text), bool)
        place[np.cumsum(lengths + 1) - 1] = False
        text[place] = inverse + 1
        n = self.n = len(text)
        small = np.int32 if n < 2**31 else np.int64
        ranks = {1: text.astype(small)}
        rank, order = text, None
        step = 1
        while step < 64:
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            step *= 2
            ranks[step] = rank.astype(small)
        bwt = text[order - 1]
        bits = self.bits = max(1, int(len(self.symbols)).bit_length())
        self.levels, self.zeros = [], []
        level = bwt
        for b in range(bits - 1, -1, -1):  # wavelet matrix, highest bit first
            bit = (level >> b) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        every = np.arange(len(self.symbols) + 1)
        self.base = self._walk(every, np.zeros(len(every), np.int64))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(every)))))[:-1]
        shorter, whole = ~self._same(ranks, order, depth - 1), ~self._same(ranks, order, depth)
        self.shorter, self.whole = Bits(shorter), Bits(whole)
        self.edges = np.concatenate((np.flatnonzero(shorter), [n])).astype(small)
        self.docs, owner = np.unique(docs, return_inverse=True)
        owner = np.repeat(owner, lengths + 1)[order]
        self.least = np.minimum.reduceat(owner, np.flatnonzero(whole)).astype(small)

    @property
    def nbytes(self) -> int:
        """Bytes of all that is kept."""
        vectors = sum(x.nbytes for x in (*self.levels, self.shorter, self.whole))
        return vectors + sum(x.nbytes for x in (self.edges, self.least, self.docs, self.symbols, self.base, self.before))

    @staticmethod
    def _same(ranks: dict[int, np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
        """Whether each suffix in order shares its first ``depth`` words with the one before it."""
        n, out, at = len(order), np.ones(len(order), bool), 0
        out[0] = False
        for size in (32, 16, 8, 4, 2, 1):
            if depth & size:
                r = np.concatenate((ranks[size], np.full(at, -1, ranks[size].dtype)))
                values = r[order + at]
                out[1:] &= (values[1:] == values[:-1]) & (order[1:] + at < n)
                at += size
        return out

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.levels[k].rank(i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after ``symbol`` is put before each pattern."""
        at = self.before[symbol] - self.base[symbol]
        return at + self._walk(symbol, low), at + self._walk(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after the last of ``depth`` words is taken off each pattern."""
        group = self.shorter.rank(low + 1)
        return self.edges[group - 1].astype(np.int64), self.edges[group].astype(np.int64)

    def smallest(self, low: np.ndarray) -> np.ndarray:
        """The smallest doc_id in which each pattern of ``depth`` words starts."""
        return self.docs[self.least[self.whole.rank(low + 1) - 1]]

    def encode(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.symbols, words) + 1

    def repeated(self, sequences: list[np.ndarray], docs: np.ndarray, depth: int = WINDOW) -> list[np.ndarray]:
        """For each sequence, whether each of its windows also starts in a document smaller than its own. All of them must be in the index."""
        codes = self.encode(np.concatenate(sequences))
        lengths = np.array([len(s) for s in sequences])
        ends = np.cumsum(lengths)
        out = [np.zeros(n - depth + 1, bool) for n in lengths]
        live, at = np.arange(len(sequences)), ends - 1
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in range(int(lengths.max())):
            more = k < lengths[live]
            live, at, low, high = live[more], at[more], low[more], high[more]
            if k >= depth:  # the word at the right leaves
                low, high = self.shorten(low)
            low, high = self.extend(codes[at], low, high)
            if k >= depth - 1:
                hit = self.smallest(low) < docs[live]
                for s in live[hit]:
                    out[s][lengths[s] - 1 - k] = True
            at = at - 1
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, text_hash, start, n, mini, h1, h2) with the words of each segment as binary."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column("wanted").to_pylist()
                out: dict[str, list] = {k: [] for k in ("rep", "mini", "h1", "h2", "words")}
                for first, hashes, offsets in batch_words(texts_of(part.column("text"))):
                    for i in range(len(offsets) - 1):
                        own = hashes[offsets[i] : offsets[i + 1]]
                        for w in lists[first + i]:
                            piece = own[w["start"] : w["start"] + w["n"] + WINDOW - 1]
                            if len(piece) == w["n"] + WINDOW - 1:
                                for k in ("rep", "mini", "h1", "h2"):
                                    out[k].append(w[k])
                                out["words"].append(piece.tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("rep", "mini", "h1", "h2")), pa.array(out["words"], pa.binary())], names=list(out))

    lists = wanted.groupBy(F.col("rep").alias("doc_id"), "text_hash").agg(F.collect_list(F.struct("rep", "start", "n", "mini", "h1", "h2")).alias("wanted"))
    rows = keyed(docs).join(lists, ["doc_id", "text_hash"]).select("text", "wanted")
    return rows.mapInArrow(run, "rep long, mini long, h1 long, h2 long, words binary").dropDuplicates(["mini", "h1", "h2"])


def _search(shards: DataFrame) -> DataFrame:
    """mini, h1, h2 and the repeated runs (offset, n) of each class, shard by shard."""

    def run(group: pa.Table) -> pa.Table:
        sequences = [np.frombuffer(w, _U) for w in group.column("words").to_pylist()]
        docs = group.column("rep").to_numpy()
        flags = FMIndex(sequences, docs).repeated(sequences, docs)
        runs = [[{"off": a, "len": n} for a, n in _runs(f)] for f in flags]
        return group.select(["mini", "h1", "h2"]).append_column("runs", pa.array(runs, pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())]))))

    return shards.groupBy("shard").applyInArrow(run, "mini long, h1 long, h2 long, runs array<struct<off:int,len:int>>")


def _minimiser_at(words: np.ndarray) -> int:
    """Place of the minimiser in a segment: the leftmost smallest run of its windows."""
    low = _U((1 << 24) - 1)
    grams = ngrams(words, GRAM)
    return int(((grams & ~low) | np.arange(len(grams), dtype=_U)).argmin())


def _contexts(segs: DataFrame) -> DataFrame:
    """mini, h1, h2, side, hs: hashes of the 1, 2, ... words left (side 0) and right (side 1) of each segment's minimiser."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows, sides, hashes = [], [], []
                for row, data in enumerate(part.column("words").to_pylist()):
                    w = np.frombuffer(data, _U)
                    p = _minimiser_at(w)
                    for side, near in ((0, w[:p][::-1]), (1, w[p + GRAM :])):
                        rows.append(row)
                        sides.append(side)
                        hashes.append(span_hashes(near, np.zeros(len(near), np.int64), np.arange(1, len(near) + 1)).view(np.int64))
                keys = [part.column(k).take(pa.array(rows, pa.int64())) for k in ("mini", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sides, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["mini", "h1", "h2", "side", "hs"])

    return segs.mapInArrow(run, "mini long, h1 long, h2 long, side int, hs array<long>")


def _cut(segs: DataFrame) -> DataFrame:
    """segs (with left and right, words of context to keep): rep, mini, h1, h2, off, n, t1, t2, words of what is left, where it has a window."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("rep", "mini", "h1", "h2", "off", "n", "t1", "t2", "words")}
            for row in b.to_pylist():
                w = np.frombuffer(row["words"], _U)
                p = _minimiser_at(w)
                own = w[p - row["left"] : p + GRAM + row["right"]]
                if len(own) >= WINDOW:
                    digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                    for k in ("rep", "mini", "h1", "h2"):
                        out[k].append(row[k])
                    for k, v in (("off", p - row["left"]), ("n", len(own) - WINDOW + 1), ("t1", int(digest[0])), ("t2", int(digest[1])), ("words", own.tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "words" else pa.int32() if k in ("off", "n") else pa.int64()) for k, v in out.items()], names=list(out))

    return segs.mapInArrow(run, "rep long, mini long, h1 long, h2 long, off int, n int, t1 long, t2 long, words binary")


def _shared_parts(segs: DataFrame) -> DataFrame:
    """The segments of hot minimisers, cut to the context that another class shares."""
    key = ["mini", "h1", "h2"]
    contexts = stored(_contexts(segs))
    each = contexts.select("mini", "side", F.posexplode("hs").alias("r", "h")).select("mini", "side", (F.col("r") + 1).alias("_r"), F.col("h").alias("_h"))
    shared = stored(each.groupBy("mini", "side", "_r", "_h").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k"))
    # a context that is shared is shared at every smaller length, so its length is found bit by bit: one look-up a class, side and bit
    found = contexts.withColumn("reach", F.lit(0))
    for bit in range((WINDOW - GRAM).bit_length() - 1, -1, -1):
        there = F.size("hs") >= F.col("reach") + 2**bit
        probe = found.withColumn("_r", F.when(there, F.col("reach") + 2**bit).otherwise(-1)).withColumn("_h", F.when(there, F.get("hs", F.col("reach") + 2**bit - 1)).otherwise(F.col("h1")))
        met = probe.join(shared.withColumn("_met", F.lit(2**bit)), ["mini", "side", "_r", "_h"], "left")
        found = met.select(*contexts.columns, (F.col("reach") + F.coalesce("_met", F.lit(0))).alias("reach"))
    of_side = lambda side: F.max(F.when(F.col("side") == side, F.col("reach")).otherwise(0))
    reach = found.groupBy(*key).agg(of_side(0).alias("left"), of_side(1).alias("right"))
    return stored(_cut(segs.join(reach, key)))


def _class_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """mini, h1, h2 and the repeated runs of each wanted class that has any."""
    key = ["mini", "h1", "h2"]
    segs = stored(_with_words(docs, wanted)).join(wanted.select(*key, "hot"), key)
    cold, hot = segs.where("not hot").select("rep", *key, "words"), wanted.where("hot")
    parts = None
    if not hot.isEmpty():
        parts = _shared_parts(stored(segs.where("hot").select("rep", *key, "words")))
        whole = stored(parts.groupBy("mini", "t1", "t2").agg(F.min("rep").alias("rep"), F.first("words").alias("words")))
        cold = cold.unionByName(whole.select("rep", "mini", F.col("t1").alias("h1"), F.col("t2").alias("h2"), "words"))
    segs = stored(cold)
    size = segs.agg((F.sum(F.length("words")) / 8).alias("w")).first()["w"] or 0
    n_shards = int(max(1, -(-size // SHARD_WORDS), min(12, size // 20_000)))
    runs = stored(_search(segs.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(n_shards))))).where(F.size("runs") > 0)
    if parts is None:
        return runs.select(*key, "runs")
    least = whole.select("mini", "t1", "t2", F.col("rep").alias("least")).join(runs.select("mini", F.col("h1").alias("t1"), F.col("h2").alias("t2"), "runs"), ["mini", "t1", "t2"], "left")
    all_of = F.array(F.struct(F.col("off"), F.col("n").alias("len")))
    some = F.transform("runs", lambda r: F.struct((F.col("off") + r["off"]).alias("off"), r["len"].alias("len")))
    of_hot = parts.drop("words").join(stored(least), ["mini", "t1", "t2"]).select(*key, F.when(F.col("rep") > F.col("least"), all_of).otherwise(some).alias("runs")).where("runs is not null")
    return runs.join(wanted.where("not hot").select(*key), key, "left_semi").select(*key, "runs").unionByName(of_hot)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs): the runs (start, n) of repeated windows of each document that has any."""
    segs = stored(segment_rows(docs))
    key = ["mini", "h1", "h2"]
    classes = stored(segs.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "text_hash", "start")).alias("at"), F.first("n").alias("n")).select(*key, "rep", "last", "n", "at.text_hash", "at.start"))
    several = stored(classes.groupBy("mini").agg(F.count("*").alias("classes"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("classes > 1 and lo < hi").select("mini", (F.col("classes") > HOT_CLASSES).alias("hot")))
    wanted = stored(classes.join(several, "mini").select("rep", "text_hash", "start", "n", *key, "hot"))
    found = settled(lambda: _class_runs(docs, wanted))
    touched = stored(classes.join(found, key, "left").where("last > rep or runs is not null").select(*key, "rep", "runs"))
    whole = F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("len")))
    of_doc = F.when(F.col("doc_id") > F.col("rep"), whole).otherwise(F.col("runs"))
    hits = segs.join(touched, key).select("doc_id", "text_hash", F.explode(F.transform(of_doc, lambda r: F.struct((F.col("start") + r["off"]).alias("start"), r["len"].alias("n")))).alias("run"))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("runs"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, joined by one space) of each document."""
    ship(docs.sparkSession)
    found = repeated_runs(docs)

    def run(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for text, runs in zip(texts_of(b.column("text")), b.column("runs").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        edge[min(r["start"], len(words))] += 1
                        edge[min(r["start"] + r["n"] + WINDOW - 1, len(words))] -= 1
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    rows = keyed(docs).join(found, ["doc_id", "text_hash"], "left")
    return rows.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN first USING (h) WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
