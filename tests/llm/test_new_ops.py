"""Importance resampling, periodic runs and embedding near-dedup against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import embedding_dedup, importance, word_runs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " ", "\n\t", "One", "a-b_c 1.5 É日本 x y", "!!!", "z" * 70_000, "Ab " * 3_000]


def frame(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("score", F.lit(2.0)).withColumn("Rank", F.lit("x")).withColumn("runs", F.lit(0)).withColumn("bucket", F.lit(1))


# importance resampling


def features(text, order):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, order, buckets, percent, min_words, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, order):
                counts[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out, drawn = [], []
    for i, x in docs:
        f = features(x, order)
        weight = sum(gain[bucket(y)] for y in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(features(x, 1)) >= min_words:
                drawn.append((-score, i, x))
        out.append((i, len(f), weight, score))
    return out, sorted(drawn)[: percent * len(drawn) // 100]


def test_crc_algebra():
    rng = random.Random(2)
    known = importance._Crcs()
    for n in (0, 1, 2, 7, 40):
        words = ["".join(rng.choices("abcxyz0129é日", k=rng.choice([1, 3, 9, 300]))) for _ in range(n)]
        crcs, lengths = importance.word_crcs(" ".join(words).encode(), known)
        assert lengths.tolist() == [len(w.encode()) for w in words]
        for order in (1, 2, 3, 5):
            want = [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, order + 1) for i in range(n - k + 1)]
            assert importance.feature_crcs(crcs, lengths, order).tolist() == want


def test_words_across_pieces(monkeypatch):
    text = ("Word É x" * 50 + "-" + "q" * 500 + ". ") * 4
    want = [zlib.crc32(w.encode()) for w in WORDS.findall(text.translate(LOWER))]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        assert importance.word_crcs(text.encode(), importance._Crcs())[0].tolist() == want


@pytest.mark.parametrize("order", [1, 3])
def test_resampling(spark, order):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(60)] + ["é", "7", "日本"]
    docs = [(i, x) for i, x in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(docs[30][0], docs[40][1]), (None, docs[50][1]), docs[60]]  # a repeated id, no id, a repeated row
    target = [" ".join(rng.choices(vocab[:12], k=30)) for _ in range(8)] + [None, ""]
    got = importance.resampled(frame(spark, [x for _, x in docs], [i for i, _ in docs]), frame(spark, target), order, 50, 10, 20, 2024).collect()
    want, drawn = by_hand(docs, target, order, 50, 10, 20, 2024)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranked == [(k + 1, s, i) for k, (s, i, _) in enumerate(drawn)] and len(drawn) > 5


def test_resampling_of_empty_tables(spark):
    docs, none = frame(spark, ["a b c", None]), frame(spark, ["x"]).where("false")
    assert importance.resampled(none, docs).count() == 0
    rows = importance.resampled(docs, none, min_words=1, percent=100).collect()
    assert {(r["doc_id"], r["rank"]) for r in rows} == {(0, 1), (1, None)}


# periodic runs


def runs_of(w, min_length=6, min_exponent=4):
    out = {}
    for p in range(1, len(w)):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(min_length, min_exponent * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def repeating(rng, n, letters):
    w = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (4, 3), (20, 4)])
def test_runs_against_all_periods(least):
    rng = random.Random(7)
    for _ in range(400):
        w = repeating(rng, rng.randint(0, 80), range(rng.choice([1, 2, 3, 5])))
        got = word_runs.find_runs(np.array([*w, 99]), len(w), *least)
        assert [tuple(r) for r in got.tolist()] == runs_of(w, *least)


def test_runs_when_hashes_are_equal(monkeypatch):
    """Words decide, not their hashes."""
    monkeypatch.setattr(word_runs, "mix", lambda x: x % np.uint64(2))
    rng = random.Random(8)
    for _ in range(300):
        w = repeating(rng, rng.randint(0, 60), range(rng.choice([2, 4, 6])))
        got = [tuple(r) for r in word_runs.find_runs(np.array([*w, 99]), len(w)).tolist()]
        want = runs_of(w)
        assert set(got) <= set(want) and all(w[s + p : s + n] == w[s : s + n - p] for s, n, p in got)


@pytest.mark.parametrize("piece,size", [(1 << 20, 1 << 18), (3, 100)])
def test_collapsed_texts(spark, monkeypatch, piece, size):
    monkeypatch.setattr(word_runs, "PIECE", piece)
    monkeypatch.setattr(word_runs, "BATCH_WORDS", size)
    rng = random.Random(9)
    texts = ODD + ["\x0b".join(repeating(rng, rng.randint(0, 120), ["a", "B", "é", "日本"])) for _ in range(60)] + ["w " * 9_000]
    texts += [texts[-1], texts[-5]]
    out = list(word_runs.collapsed([(t or "").encode() for t in texts], list(range(len(texts)))))
    for t, (runs, left) in zip(texts, out, strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        want = runs_of(w) if len(w) < 500 else [(0, len(w), 1)]
        assert runs == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert left.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_op12_query(spark, tmp_path):
    rng = random.Random(10)
    texts = ODD + [" ".join(repeating(rng, rng.randint(0, 90), ["a", "b", "c"])) for _ in range(120)]
    ids = [*range(len(texts) - 2), 3, None]  # a repeated id and none
    frame(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in word_runs.op12_word_runs(spark, str(tmp_path)).collect()), key=str)
    want, planted = [], 0
    for i, t in zip(ids, texts, strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            planted += 1
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(len(w))]
        runs = runs_of(w) if len(w) < 500 else [(0, len(w), 1)] * (len(set(w)) == 1)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str) and planted > 3


def test_collapse_keeps_other_columns(spark):
    docs = frame(spark, ["a " * 9 + "b", None])
    rows = word_runs.collapse_runs(docs)
    assert rows.columns == ["doc_id", "text", "n", "score", "Rank", "bucket", "runs", "collapsed"]
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows.collect()}
    assert got == {0: ([(0, 9, 1)], "a b"), 1: ([], "")}
    assert word_runs.collapse_runs(docs.where("false")).count() == 0


# embedding near-dedup


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("n_links", F.lit("x"))


def linked_by_hand(rows, cosine=0.95):
    good = [k for k, (i, v, _) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in good}
    out = []
    for k, (i, _, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            new = [j for j in near.get(todo.pop(), []) if j not in reach]
            reach.update(new)
            todo += new
        least = min(rows[j][0] for j in reach) if i is not None else None
        out.append((i, len(near.get(k, [])), least, i == least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    rows, ids = [], itertools.count()
    for group in range(40):
        base = rng.standard_normal(24)
        for _ in range([1, 2, 5, 60][group % 4]):  # chains too: not every member is near to every other
            base = base + 0.22 * rng.standard_normal(24) * (group % 3 > 0)
            rows.append((next(ids), (base * rng.uniform(0.1, 9)).tolist(), group))
    rows += [(next(ids), rng.standard_normal(24).tolist(), 0) for _ in range(400)]
    return rows


def test_near_vectors_with_many_cells(spark, planted, monkeypatch):
    """Cells and blocks so small that most links lie between them."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(vectors(spark, planted)).collect()), key=str)
    want = linked_by_hand(planted)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a[2:] == b[2:] for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_near_vectors_in_one_cell(spark, planted, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 10_000)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    assert sorted((tuple(r) for r in embedding_dedup.near_vectors(vectors(spark, planted[::-1])).collect()), key=str) == linked_by_hand(planted)


def test_near_vectors_of_single_precision(spark, planted, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 10_000)
    rows = [(i, [float(np.float32(x)) for x in v], n) for i, v, n in planted]
    got = embedding_dedup.near_vectors(vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked_by_hand(rows)


def test_near_vectors_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(5, one, 1), (6, [2.0, 0.0, -0.0], 1), (7, two, 2), (8, [0.0, 0.0, 0.0], 1), (9, None, 1), (10, [], 1), (11, [1.0, None, 0.0], 1), (12, [1.0, float("nan"), 0.0], 1), (13, [float("inf"), 0.0, 0.0], 1)]
    rows += [(14, [1.0], None), (15, [3.0], 1), (16, [-1.0], 1), (17, [1.0, 0.0], 1), (None, one, 1), (7, [0.0, 1.0, 0.0], 1), (5, one, 1), (18, [0.0, 1e-200, 0.0], 1), (3, [1e-300, 0.0, 0.0], 1)]
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()), key=str)
    want = linked_by_hand([(i, [x * 1e200 if x else x for x in v] if v and i in (3, 18) else v, n) for i, v, n in rows])
    assert got == want
    assert embedding_dedup.near_vectors(vectors(spark, rows).where("false")).count() == 0


def test_grid_finds_what_it_was_asked_for():
    """Recall of planted neighbours at just the cosine, which the grid has not seen."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((6_000, 64)))
    side = rng.standard_normal(x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side
    grid = embedding_dedup.Grid(x[:3_000], 12, 0.95, 0.99)
    (a, looks_a), (b, looks_b) = grid.looks(x[3_000:]), grid.looks(y[3_000:])
    met = [p == q or q in lp or p in lq for p, q, lp, lq in zip(a, b, looks_a, looks_b, strict=True)]
    assert np.mean(met) >= 0.98 and np.mean([len(n) for n in looks_a]) < 0.25 * 144
