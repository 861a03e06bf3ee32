"""Language-model scoring by online logistic context mixing.

A token (a word, or the end of a text) is a code of ``BITS`` bits and its place among the known tokens of that
code. The bits are predicted one after the other: ``CONTEXTS`` hashed contexts (none, the previous word, the
previous two, the last short word, the shapes of the previous two words) each give a counter's probability for the
bit; a weight vector, chosen by a gate (bit, and how well the two-word context is known), mixes their logits;
an adaptive probability map refines the result. The first half of a code tells a word's shape (first and
last byte), the second half hashes the word. Inside a code a token has probability
(c + 0.1) / (C + 0.1 (V + 1)), with C and V the occurrences and distinct tokens of the code, and one share for all
unknown tokens. The probabilities of all tokens sum to one.

What is gathered grows with the corpus: a count for each distinct word, and for each word that is not among the
``HOT_WORDS`` most frequent a count for each code that follows it. Both are grouped sums of Spark that meet the
scored tokens in a join. After such a word its most frequent follower gets the share q, learnt for each class of
counts by leaving each occurrence out, and the mixed prediction the rest: q [code = follower] + (1 - q) p. A learnt
text's own occurrence is taken out of the follower's count, so that a rare passage is not predicted by itself.

Learning is online and in parallel: each task goes through its training texts, predicts a slice of tokens, corrects its
weights by the errors and counts the slice; predictions see the counts of all blocks before. Counters and maps of
all tasks are added up, weights are averaged by tokens seen. Scoring uses the frozen sum.

A counter's run holds the 16 leaves of four bits; each node's zeros and ones are sums of leaves, and the four logits
on the way to a leaf are one 32-bit entry of a table, so a context costs one look-up for four bits.

What is broadcast has a fixed bound: counters of frequent contexts (``RUN_BITS``), maps, weights, 2 ** BITS code sums and
the ``HOT_WORDS`` most frequent words. The joined words are rare by this, so none of them is a hot key.
Words are compared as 64-bit hashes.

Defined cases: null and empty texts are one end token; without training rows every count is 0 and every bit has
probability one half; repeated rows are scored alike; rows with a null doc_id are scored and, having no
remainder, learnt from; an empty table gives an empty result; other columns are carried along, except those that have the
name of a column of the result, which are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, ship, stored, table
from .words import mix, texts_of, word_table

BITS, SHAPE_BITS, RUN_BITS, CONTEXTS = 12, 6, 17, 5
GROUP = 4  # bits of a run
GROUPS = BITS // GROUP
OWN_RUNS = sum(1 << GROUP * g for g in range(GROUPS))  # of the empty context
RUNS = (1 << RUN_BITS) + OWN_RUNS
HOT_WORDS = 100_000
BLOCK_BYTES = 1 << 19
MOST_TOKENS = 1 << 20  # after which a task's predictions see its new counts
PENDING_WORDS = 1_000_000  # distinct words that a learning task holds before it passes their counts on
STEPS, LIMIT = 33, 8.0  # of the adaptive map, over logits from -LIMIT to LIMIT
UNIT = 127 / LIMIT  # logits are kept as whole numbers of 1 / UNIT
SURE = int(4.5 * UNIT)  # of the two-word context: nothing known, something, nearly always the same
GATES = BITS * 3
RATE = 0.4
PIECE_RUNS = 1 << 12  # runs of one row of merged counters
SLICE = 1 << 13  # tokens that are worked on at once, so that their arrays stay in the processor's cache
#: Classes of follower counts: CLASSES // 3 sizes, each for followers that are the only one, the most, or less.
CLASSES = 18
_U = np.uint64
_END = _U(0x1F83D9ABFB41BD6B)
_SALTS = mix(np.arange(1, 17, dtype=_U))


def tokens_of(texts: list[bytes]):
    """code, context hashes (CONTEXTS, tokens), hash (``_END`` for an end) of all tokens of the texts, and the number of tokens of each text. Texts are lower case."""
    data = b"\n".join(texts)
    hashes, starts, lengths = word_table(data)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, ends)  # words up to and with each text
    n_words = np.diff(np.concatenate(([0], offsets)))
    first, last = (raw[starts], raw[starts + lengths - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    put = lambda x, v: np.insert(x, offsets, v)
    h, size = put(hashes, _END), put(lengths, 99)
    shape = put(mix((first.astype(_U) << _U(8)) | last) >> _U(64 - SHAPE_BITS), 0)
    code = ((shape << _U(BITS - SHAPE_BITS)) | (h >> _U(64 - BITS + SHAPE_BITS))).astype(np.int64)
    code[h == _END] = 0
    n = len(h)
    owner = np.repeat(np.arange(len(texts)), n_words + 1)
    begin = np.concatenate(([0], np.cumsum(n_words + 1)))[:-1][owner]

    def before(x, k, fill):
        out = np.full(n, fill, x.dtype)
        out[k:] = x[:-k]
        out[np.arange(n) - k < begin] = fill
        return out

    p1, p2 = before(h, 1, _END), before(h, 2, _END)
    short = np.where(size <= 3, np.arange(n), -1)
    at = np.concatenate(([-1], np.maximum.accumulate(short)[:-1]))
    s1 = np.where(at >= begin, h[np.maximum(at, 0)], _END)
    with np.errstate(over="ignore"):
        shapes = before(shape, 1, _U(0)) * _U(64) + before(shape, 2, _U(0))
        contexts = np.stack([np.zeros(n, _U), mix(p1 + _SALTS[1]), mix(p1 * _U(0x9E3779B97F4A7C15) + p2), mix(s1 + _SALTS[3]), mix(shapes + _SALTS[4])])
    return code, contexts, h, n_words + 1


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class State:
    """Counters, weights and maps; learns, merges and predicts.

    ``leaves`` counts how often each leaf of a run was reached. :meth:`freeze` makes ``paths`` from them: four signed
    logits for each leaf, of the bit that was taken and not of a one. So are all logits here: z > 0 favours the bit
    that came, and the same z with the other sign belongs to the other bit.
    """

    def __init__(self):
        self.leaves = np.zeros((RUNS, 1 << GROUP), np.int32)
        self.weights = np.full((GATES, CONTEXTS), 0.3, np.float32)
        self.map = np.zeros((GATES, STEPS), np.float64)  # how often each logit came
        self.seen = self.waiting = 0
        self.freeze()

    def freeze(self) -> None:
        paths = np.empty((RUNS, 1 << GROUP, GROUP), np.int8)
        step = 1 << 11
        for i in range(0, RUNS, step):
            c = self.leaves[i : i + step].astype(np.float32)
            for k in range(GROUP - 1, -1, -1):  # c: counts of the 2 ** (k + 1) nodes below bit k
                log = np.log(c + np.float32(0.02))
                way = (log[:, 1::2] - log[:, ::2]) * np.float32(UNIT)
                way = np.rint(np.clip(way, -127, 127, out=way), out=way).astype(np.int8)
                both = np.stack([-way, way], 2).reshape(len(c), -1)
                paths[i : i + step, :, k] = np.repeat(both, 1 << (GROUP - 1 - k), axis=1) if k < GROUP - 1 else both
                c = c[:, ::2] + c[:, 1::2]
        self.paths = paths.view(np.uint32).reshape(-1)
        self.waiting = 0

    @staticmethod
    def leaf(code: np.ndarray, keys: np.ndarray, g: int) -> np.ndarray:
        """Leaf (CONTEXTS, tokens) of each context in bits GROUP * g to GROUP * (g + 1) of the codes."""
        node = (code >> (BITS - GROUP * g)) | (1 << GROUP * g)
        with np.errstate(over="ignore"):
            x = (keys + node.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - RUN_BITS)
        x[0] = (1 << RUN_BITS) + node - (1 << GROUP * g) + sum(1 << GROUP * i for i in range(g))
        x <<= np.uint32(GROUP)
        x |= ((code >> (BITS - GROUP * (g + 1))) & ((1 << GROUP) - 1)).astype(np.uint32)
        return x.astype(np.int64)

    def predict(self, code: np.ndarray, keys: np.ndarray):
        """For each bit: leaves if it begins a group, bit, logits of the contexts in 1 / UNIT, masks of the first and last gate, mixed logit."""
        for g in range(GROUPS):
            at = self.leaf(code, keys, g)
            ways = np.take(self.paths, at, mode="clip").view(np.int8).reshape(CONTEXTS, len(code), GROUP)
            sure = np.abs(ways[2])
            new, firm = (sure == 0).T, (sure >= SURE).T
            for k in range(GROUP):
                b = GROUP * g + k
                x = ways[:, :, k].astype(np.float32)
                z = (self.weights[3 * b : 3 * b + 3] * np.float32(1 / UNIT)) @ x
                out = z[1]
                np.copyto(out, z[0], where=new[k])
                np.copyto(out, z[2], where=firm[k])
                yield at if k == 0 else None, b, x, new[k], firm[k], np.clip(out, -LIMIT, LIMIT, out=out)

    @staticmethod
    def cell(b: int, z: np.ndarray, new: np.ndarray, firm: np.ndarray) -> np.ndarray:
        """Place in the map: the gate's row and the nearest step."""
        at = (z * np.float32((STEPS - 1) / (2 * LIMIT)) + np.float32((STEPS - 1) / 2 + 0.5 + (3 * b + 1) * STEPS)).astype(np.int64)
        return at + (firm.view(np.int8) - new.view(np.int8)) * np.int8(STEPS)

    @staticmethod
    def keys(contexts):
        return (contexts >> _U(32)).astype(np.uint32)

    def learn(self, code, contexts) -> None:
        """Predict, correct and count slice by slice. Predictions see the weights from before the slice, and the counts from before the last :meth:`freeze`, which comes as often as tokens double, then every ``MOST_TOKENS``."""
        keys, leaves = self.keys(contexts), self.leaves.reshape(-1)
        for i in range(0, len(code), SLICE):
            part, own = code[i : i + SLICE], keys[:, i : i + SLICE]
            slope, cells = np.empty((GATES, CONTEXTS), np.float32), []
            sizes = np.empty(GATES, np.float32)
            errors = np.empty((3, len(part)), np.float32)
            for at, b, x, new, firm, z in self.predict(part, own):
                if at is not None:
                    np.add.at(leaves, at.reshape(-1), np.int32(1))
                cells.append(self.cell(b, z, new, firm))
                e = errors[1]
                np.exp(z, out=e)
                e += 1
                np.reciprocal(e, out=e)  # 1 less the probability of the bit that came
                np.multiply(e, new, out=errors[0])
                np.multiply(e, firm, out=errors[2])
                s = errors @ x.T
                s[1] -= s[0] + s[2]
                slope[3 * b : 3 * b + 3] = s
                n0, n2 = np.count_nonzero(new), np.count_nonzero(firm)
                sizes[3 * b : 3 * b + 3] = n0, len(part) - n0 - n2, n2
            self.weights += np.float32(RATE / UNIT) * slope / np.maximum(sizes, 256)[:, None]
            self.map += np.bincount(np.concatenate(cells), minlength=self.map.size).reshape(self.map.shape)
            self.seen += len(part)
            self.waiting += len(part)
            if self.waiting >= min(self.seen // 2, MOST_TOKENS):
                self.freeze()

    def refined(self) -> np.ndarray:
        """What the map makes of each logit: log odds of those that came against those of the other sign, drawn to the logit itself where few came."""
        other, middle = self.map[:, ::-1], np.linspace(-LIMIT, LIMIT, STEPS)
        total = self.map + other
        return ((np.log((self.map + 0.4) / (other + 0.4)) * total + middle * 50) / (total + 50)).astype(np.float32).reshape(-1)

    def log10(self, code, contexts) -> np.ndarray:
        """log10 of the probability of each code."""
        out, refined, keys = np.zeros(len(code)), self.refined(), self.keys(contexts)
        for i in range(0, len(code), SLICE):
            product = np.ones(len(code[i : i + SLICE]), np.float32)
            for _, b, _, new, firm, z in self.predict(code[i : i + SLICE], keys[:, i : i + SLICE]):
                z += np.take(refined, self.cell(b, z, new, firm), mode="clip")
                z *= np.float32(-0.5)
                np.exp(z, out=z)
                z += 1
                product *= z
                if (b + 1) % GROUP == 0:
                    out[i : i + SLICE] -= np.log10(product)
                    product.fill(1)
        return out


def text_blocks(texts: list[bytes], size=lambda: BLOCK_BYTES):
    """Lists of consecutive texts of about ``size()`` bytes, which is asked before each."""
    i = 0
    while i < len(texts):
        j, got, most = i, 0, size()
        while j < len(texts) and (j == i or got + len(texts[j]) < most):
            got += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 10; rows where it is 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


class Counts:
    """Occurrences and codes of distinct words, as sorted arrays."""

    def __init__(self):
        self.hashes, self.codes, self.counts = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        own, at, counts = np.unique(hashes, return_index=True, return_counts=True)
        every = np.concatenate((self.hashes, own))
        self.hashes, first, place = np.unique(every, return_index=True, return_inverse=True)
        self.codes = np.concatenate((self.codes, codes[at]))[first]
        self.counts = np.bincount(place, np.concatenate((self.counts, counts)), len(first)).astype(np.int64)


def gathered(docs: DataFrame) -> DataFrame:
    """What learning tasks pass on, stored: (word, code, c) of distinct words, and (block, payload) of the counters, weights and map of each task."""
    ship(docs.sparkSession)

    def rows(words: Counts, blocks, payloads):
        n, m = len(words.hashes), len(blocks)
        columns = [pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)]) for x, t in ((words.hashes.view(np.int64), pa.int64()), (words.codes, pa.int32()), (words.counts, pa.int64()))]
        columns += [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in ((blocks, pa.int32()), (payloads, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "code", "c", "block", "payload"])

    def learn(batches):
        s, words, waiting, size = State(), Counts(), [], 0

        def count():
            words.add(np.concatenate([h for h, _ in waiting]), np.concatenate([c for _, c in waiting]))
            waiting.clear()

        for batch in batches:
            for texts in text_blocks([t.lower() for t in texts_of(batch.column("text"))]):
                code, contexts, hashes, _ = tokens_of(texts)
                s.learn(code, contexts)
                inner = hashes != _END
                waiting.append((hashes[inner], code[inner]))
                size += len(code)
                if size >= MOST_TOKENS:
                    count()
                    size = 0
                if len(words.hashes) > PENDING_WORDS:
                    yield rows(words, [], [])
                    words = Counts()
        if s.seen:
            if waiting:
                count()
            yield rows(words, [-1], [zlib.compress(np.concatenate([[s.seen], s.weights.ravel().astype(np.float64) * s.seen, s.map.ravel()]).tobytes(), 1)])
            for i in range(0, RUNS, PIECE_RUNS):
                yield rows(Counts(), [i], [zlib.compress(s.leaves[i : i + PIECE_RUNS].tobytes(), 1)])

    return stored(docs.select("text").mapInArrow(learn, "word long, code int, c long, block int, payload binary"))


def merged(parts: DataFrame) -> State:
    """The sum of the tasks' counters and maps, and the mean of their weights by tokens seen."""
    ship(parts.sparkSession)
    schema = "block int, payload binary"

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                payload = zlib.decompress(payload)
                x = np.frombuffer(payload, np.float64) if block < 0 else np.frombuffer(payload, np.int32).astype(np.int64)
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "payload"])

    out = State()
    out.leaves = out.leaves.astype(np.int64)
    for row in parts.where("block is not null").select("block", "payload").repartition(64, "block").mapInArrow(add, schema).collect():  # RUNS * 16 counters, at any size of the corpus
        if row["block"] >= 0:
            x = np.frombuffer(bytes(row["payload"]), np.int64).reshape(-1, 1 << GROUP)
            out.leaves[row["block"] : row["block"] + len(x)] = x
        else:
            x = np.frombuffer(bytes(row["payload"]), np.float64)
            out.seen = int(x[0])
            out.weights = (x[1 : 1 + out.weights.size] / x[0]).reshape(out.weights.shape).astype(np.float32)
            out.map = x[1 + out.weights.size :].reshape(out.map.shape).copy()
    out.freeze()
    return out


def code_sums(vocab: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct tokens of each code, end tokens included."""
    c, v = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in vocab.groupBy("code").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        c[r["code"]], v[r["code"]] = r["c"], r["v"]
    if n_texts:
        c[0] += n_texts
        v[0] += 1
    return c, v


def hot_words(vocab: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words of at least 2 ** k occurrences, for the smallest k that leaves ``most`` words at most."""
    most = HOT_WORDS if most is None else most
    sizes = {r["k"]: r["n"] for r in vocab.groupBy(F.floor(F.log2("c") + 1e-9).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    k = next(k for k in range(max(sizes, default=0) + 2) if sum(n for at, n in sizes.items() if at >= k) <= most)
    rows = vocab.where(F.col("c") >= 2**k).select("word", "c").collect()
    return np.array([r["word"] for r in rows], np.int64).view(_U), np.array([r["c"] for r in rows], np.int64)


class Logs:
    """log10(c + 0.1) by word hash: tables of one place a hash; words that find theirs taken go to the next table."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bits: int = 19):
        self.levels, self.shift = [], _U(64 - bits)
        logs = np.log10(counts + 0.1)
        while len(hashes) or not self.levels:
            at = (hashes >> self.shift).astype(np.int64)
            first = np.unique(at, return_index=True)[1]
            check, values = np.zeros(1 << bits, _U), np.zeros(1 << bits)
            check[at[first]], values[at[first]] = hashes[first], logs[first]
            self.levels.append((check, values))
            left = np.ones(len(hashes), bool)
            left[first] = False
            hashes, logs = hashes[left], logs[left]

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs of the words (0 where there is none), and whether there is one."""
        out, found = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        rest = np.arange(len(hashes))
        for check, values in self.levels:
            at = (hashes[rest] >> self.shift).astype(np.int64)
            hit = check[at] == hashes[rest]
            out[rest[hit]], found[rest[hit]] = values[at[hit]], True
            rest = rest[~hit]
        return out, found


class Scorer:
    """What scoring tasks share."""

    def __init__(self, state: State, sums: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray], n_texts: int):
        self.state, self.logs, self.n_texts = state, Logs(*hot), n_texts
        state.leaves = None  # the paths are enough
        self.shares = np.log10(sums[0] + 0.1 * (sums[1] + 1))

    def __call__(self, texts: list[bytes]) -> list[pa.Array]:
        """For each text: tokens, known tokens, sum of log10(c + 0.1), log10 of codes less shares, bytes; known and sum are without words that are not hot, which follow as a list with the code after each and its log10."""
        code, contexts, hashes, sizes = tokens_of(texts)
        logs = self.state.log10(code, contexts)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        own, found = self.logs(hashes)
        is_end = hashes == _END
        own[is_end], found[is_end] = np.log10(self.n_texts + 0.1), True
        known = np.add.reduceat(found.astype(np.int64), begin) - (0 if self.n_texts else 1)
        rare = np.flatnonzero(~found)
        offsets = pa.array(np.concatenate((np.searchsorted(rare, begin), [len(rare)])), pa.int32())
        lists = [pa.array(hashes[rare].view(np.int64)), pa.array(code[rare + 1], pa.int32()), pa.array(logs[rare + 1], pa.float32())]
        numbers = [sizes, known, np.add.reduceat(own, begin), np.add.reduceat(logs - self.shares[code], begin), [len(t) for t in texts]]
        return [*(pa.array(x) for x in numbers), *(pa.ListArray.from_arrays(offsets, x) for x in lists)]


#: Columns that scoring tasks add, and those of the result.
_OWN = [("n_tokens", "long"), ("known", "long"), ("total", "double"), ("coded", "double"), ("bytes", "long"), ("rare", "array<long>"), ("next", "array<int>"), ("logs", "array<float>")]
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def count_class(top: Column, total: Column) -> Column:
    """Class of a follower that came ``top`` of ``total`` times: its size, and whether it is the only one, the most, or less; null for 0."""
    size = F.when(top <= 3, top - 1).when(top < 8, 3).when(top < 16, 4).otherwise(5)
    return F.when(top > 0, 3 * size + F.when(top == total, 0).when(2 * top > total, 1).otherwise(2)).cast("int")


def followers(rare: DataFrame) -> DataFrame:
    """(word, total, top, follower) from the learnt rows (word, next): occurrences of each word, and of the code that follows it most."""
    pairs = rare.repartition("word").groupBy("word", "next").agg(F.count("*").alias("n"))
    best = pairs.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "next")).alias("best"))
    return stored(best.select("word", "total", F.col("best.n").alias("top"), F.col("best.next").alias("follower")))


def follower_shares(found: DataFrame) -> list[float]:
    """How often the follower came in each class, every occurrence left out of its own counts; 0 for a class without any."""
    hits = found.select(count_class(F.col("top") - 1, F.col("total") - 1).alias("kind"), F.col("top").alias("hit"), F.lit(0).cast("long").alias("miss"))
    misses = found.select(count_class(F.col("top"), F.col("total") - 1).alias("kind"), F.lit(0).cast("long").alias("hit"), (F.col("total") - F.col("top")).alias("miss"))
    sums = hits.unionByName(misses).where("kind is not null").groupBy("kind").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss")).collect()
    out = [0.0] * CLASSES
    for r in sums:
        if r["hit"] + r["miss"]:
            out[r["kind"]] = (r["hit"] + 0.5) / (r["hit"] + r["miss"] + 1)
    return out


def score(docs: DataFrame, learnt: Column) -> DataFrame:
    """``docs`` (text, others kept) without text and with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, learnt from the rows where ``learnt`` is true."""
    spark = docs.sparkSession
    learn_from = docs.where(learnt).select("text")
    parts = gathered(learn_from)
    vocab = stored(parts.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"), F.min("code").alias("code")))
    n_texts = learn_from.count()
    sums = code_sums(vocab, n_texts)
    n, v = int(sums[0].sum()), int(sums[1].sum())
    shared = spark.sparkContext.broadcast(Scorer(merged(parts), sums, hot_words(vocab), n_texts))
    discard(parts)
    discard(vocab)
    carried = [f for f in docs.schema.fields if f.name != "text" and f.name not in RESULT]
    # carried columns go by number until the end, so that no name meets those of this module
    rows = docs.select(F.coalesce(learnt, F.lit(False)).alias("learnt"), *(docs[f"`{f.name}`"].alias(f"_{i}") for i, f in enumerate(carried)), "text")
    kept = [f"_{i}" for i in range(len(carried))]

    def run(batches):
        for batch in batches:
            at = 0
            for block in text_blocks([t.lower() for t in texts_of(batch.column("text"))]):
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([part.column("learnt"), *(part.column(k) for k in kept), *shared.value(block)], names=["learnt", *kept, *(k for k, _ in _OWN)])

    schema = T.StructType([T.StructField("learnt", T.BooleanType()), *(T.StructField(k, f.dataType) for k, f in zip(kept, carried, strict=True)), *T.StructType.fromDDL(", ".join(f"{k} {t}" for k, t in _OWN)).fields])
    done = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = done.select("row", "learnt", F.explode(F.arrays_zip("rare", "next", "logs")).alias("x")).select("row", "learnt", F.col("x.rare").alias("word"), F.col("x.next").alias("next"), F.col("x.logs").alias("log"))
    after = followers(each.where("learnt").select("word", "next"))
    shares = F.array(*[F.lit(x) for x in follower_shares(after)])
    hit, own = F.col("next") == F.col("follower"), F.col("learnt").cast("int")
    kind = count_class(F.col("top") - F.when(hit, own).otherwise(0), F.col("total") - own)
    q = F.coalesce(F.get(shares, kind), F.lit(0.0))
    gain = F.when(hit, F.log10(q + (1 - q) * F.pow(F.lit(10.0), F.col("log"))) - F.col("log")).otherwise(F.log10(1 - q))
    # a word's occurrences are those of what follows it, as an end follows the last
    met = each.join(after, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("total", F.lit(0)) + 0.1)).alias("more"), F.count("total").alias("met"), F.sum(F.coalesce(gain, F.lit(0.0))).alias("gain"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    scored = F.col("coded") + total + F.coalesce("gain", F.lit(0.0))
    norm = float(np.log10(n + 0.1 * (v + 1)))
    out = done.join(met, "row", "left").select(
        *kept,
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * norm).alias("base_score"),
        scored.alias("score"),
        (scored * (-1 / np.log10(2)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
    return out.select(*(F.col(k).alias(f.name) for k, f in zip(kept, carried, strict=True)), *RESULT)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"))
