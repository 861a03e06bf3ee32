"""Corpus operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontaminate, exact_dedup, html_extract, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup
from sessionloom.llm import common
from sessionloom.llm import words as word_hashes

WS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return [w for w in WS.split(t or "") if w]


def frame(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("score", F.lit(2.0))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = [f"Word{i}" for i in range(400)] + ["the", "of", "é", "日本", "😀!"]
    line = " ".join(rng.choices(vocab, k=12))
    passage = " ".join(rng.choices(vocab, k=90))
    out = [None, "", "   ", "\n\n", "one", "ONE ", "a b c", "A  b\tc"]
    for i in range(60):
        t = " ".join(rng.choices(vocab, k=rng.randint(1, 160)))
        if i % 3 == 0:
            t = t + "\n" + line + "\n" + line.upper()
        if i % 4 == 0:
            k = rng.randint(0, 30)
            t = t + " " + " ".join(passage.split()[k : k + 60])
        out.append(t)
    base = rng.choices(vocab, k=120)
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [out[20], out[20], "x" * 30_000, " ".join(["w"] * 8_000)]
    return out


def test_word_table():
    """Equal words have equal hashes wherever they stand, pieces and words longer than a piece included."""
    rng = random.Random(3)
    long = bytes(rng.choices(b"abc", k=3 * word_hashes.PIECE + 5))
    cases = [b"", b" ", b"a", b" a", b"a ", long, b"q " + long + b"\n" + long + b" q", long[:-1] + b"x " + long]
    cases += [bytes(rng.choices(b"ab \n\x0b", k=n)) for n in [*range(1, 40), 3 * word_hashes.PIECE]]
    seen = {}
    for data in cases:
        hashes, starts, lengths = word_hashes.word_table(data)
        assert [data[s : s + n] for s, n in zip(starts, lengths, strict=True)] == data.split()
        for w, h in zip(data.split(), hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_line_dedup(spark, texts):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    keys = collections.defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    norm = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    for i, lines in split.items():
        for x in lines:
            keys[norm(x)].add(i)
    for i, lines in split.items():
        drop = [len(norm(x)) >= 20 and len(keys[norm(x)]) >= 3 and max(keys[norm(x)]) != i for x in lines]
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(lines), sum(drop))
        assert got[i]["text"] == "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
    assert "pos" in got[0].asDict()


def test_exact_dedup(spark, texts):
    got = {r["doc_id"]: r for r in exact_dedup.dedup(frame(spark, texts)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[WS.sub("", t or "")].append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_near_dedup(spark, texts):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, texts), words=4).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)


def test_substring_dedup(spark, texts):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert got[i]["text"] == " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, n).astype(np.uint64) for n in (60, 55, 80, 50)]
    seqs.append(seqs[2][10:70].copy())
    docs = np.array([3, 9, 5, 1, 7])
    index = substring_dedup.FMIndex(seqs, docs)
    low, high = np.array([0]), np.array([index.n])
    for w in reversed(seqs[2][:6]):
        low, high = index.extend(index.encode(np.array([w])), low, high)
    assert high[0] - low[0] == sum(tuple(s[k : k + 6]) == tuple(seqs[2][:6]) for s in seqs for k in range(len(s) - 5))
    hits = index.repeated(seqs, docs)
    assert hits[4].all() and not any(h.any() for h in hits[:4])


def test_fm_index_bits_and_memory():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        bits = rng.integers(0, 2, n).astype(bool)
        b = substring_dedup.Bits(bits)
        assert b.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert 8 * b.nbytes <= 1.32 * (n + 512)
    seqs = [rng.integers(0, 500, 300).astype(np.uint64) for _ in range(200)]
    seqs += [np.concatenate((x[:120], y[100:])) for x, y in zip(seqs[:100], seqs[100:], strict=True)]
    docs = rng.permutation(len(seqs)) * 7
    index = substring_dedup.FMIndex(seqs, docs)
    words = sum(map(len, seqs)) + len(seqs)
    assert index.nbytes <= words * (9 + 1.32 * index.bits / 8) + 24 * len(index.symbols) + 8 * len(docs) + 100 * (index.bits + 4)
    first = {}
    for s, d in zip(seqs, docs, strict=True):
        for k in range(len(s) - 49):
            key = s[k : k + 50].tobytes()
            first[key] = min(first.get(key, d), d)
    for s, d, flags in zip(seqs, docs, index.repeated(seqs, docs), strict=True):
        assert flags.tolist() == [first[s[k : k + 50].tobytes()] < d for k in range(len(s) - 49)]


def test_sharding(spark, texts):
    docs = frame(spark, texts * 20, range(len(texts) * 20))
    rows = sharding.assign(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"] % len(texts)] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 0.5 * len(rows) / 17 < moved < 1.6 * len(rows) / 17


def test_sharding_weights_confine_movement(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    one, two = sharding.tree(16), sharding.tree(16)
    two["r3"]["r3k1"] = [*two["r3"]["r3k1"], 16]  # heavier rack: rows may move into region 3, never between others
    rows = ids.select(sharding.shard_of(F.col("doc_id"), one).alias("a"), sharding.shard_of(F.col("doc_id"), two).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] // 4 == 3 or r["b"] == 16 for r in rows)


def test_bpe(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|> it's 12,345\n\n  \t x", "   nbsp", "aaaa" * 3000]
    all_texts = [*texts, *more]
    docs = frame(spark, all_texts)
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    ids = bpe.encode(docs)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(ids).collect()}
    for i, t in enumerate(all_texts):
        want = tk.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert back[i] == (t or "").encode()


def test_bpe_random_pieces():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    tk = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(1)
    tokens = [t for t in v.ranks if t.isascii()]
    for _ in range(1500):
        piece = b"".join(rng.choices(tokens, k=rng.randint(1, 6)))
        assert v.encode_piece(piece) == tk.encode_ordinary(piece.decode())


def test_decontamination(spark):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [rng.choices(vocab, k=n) for n in (16, 30, 50, 8)]
    clean = [" ".join(rng.choices(vocab, k=200)) for _ in range(30)] + [None, "", "the of and"]
    dirty = []
    for it in items[:3]:
        swapped = list(it)
        for k in range(3, len(it), 9):
            swapped[k] = "other"
        around = rng.choices(vocab, k=40)
        dirty += [" ".join(around + it + around), " ".join(swapped).upper(), " ".join(it + around)]
    docs = frame(spark, clean + dirty)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {len(clean) + k: [k // 3] for k in range(9)}
    assert decontaminate.drop_contaminated(docs, bench).count() == len(clean)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(clean) + 9


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = {q: [r["predicted"] == q for r in got if r["quality"] == q] for q in (0, 1)}
    assert np.mean(right[1]) > 0.95 and np.mean(right[0]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, [None, "", "x"])
    assert [r["p"] for r in quality.with_scores(docs, quality.fit(docs, labels), "p").collect()] == [0.5] * 3


def test_html(spark):
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><header><a href=/>Home</a></header><nav><a>One</a></nav>
    <div class="cookie-banner">We use cookies</div><main><h1>A &amp; B</h1><p>First   para&shy;graph with
    words.<p>Second <b>bold</b> text, 5 &lt; 6 and more words to read.<aside>Related: other</aside><ul><li>point one of the list</li></ul>
    <form><input>Sign up</form></main><div id="comments"><p>Nice post, I liked it a lot!</p></div><footer>&copy; me"""
    w = html_extract.fit(html_extract.labelled_pages())
    assert html_extract.extract(page, w) == "A & B\nFirst para\xadgraph with words.\nSecond bold text, 5 < 6 and more words to read.\npoint one of the list"
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p></p><!-- x"), (4, "u", page), (4, "u", page)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["n_chars"]) for r in html_extract.main_text(rows).collect())
    assert got[:3] == [(1, 0), (2, 0), (3, 0)] and got[3] == got[4] and got[3][1] > 80


def test_html_best_run_against_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(rng.randint(0, 14))]
        sums = {(a, b): sum(scores[a : b + 1]) for a in range(len(scores)) for b in range(a, len(scores))}
        got = html_extract.best_run(scores)
        if got is None:
            assert max(sums.values(), default=0) <= 0
        else:
            assert sums[got] == max(sums.values()) > 0


PROSE = ("The river rose in the night and the lower fields were under water by dawn, said the keeper of the lock.", "Engineers will look at the dam on Monday and the road stays shut until they have come to a view of it.")


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><header><h1>Flood</h1><p>By A. Writer</p></header><p>{0}</p></article>", "Flood\n{0}"),
        ("<header><h1>The Paper</h1></header><article><p>{0}</p></article>", "{0}"),
        ("<div class='article-header'><h1>Flood</h1></div><p>{0}</p>", "Flood\n{0}"),
        ("<div><p>{0}</p></div><nav><ul>" + "<li><a href='/x'>Some other page of ours</a></li>" * 80 + "</ul></nav><div><p>{1}</p></div>", "{0}\n{1}"),
        ("<p title=it's>{0}</p>", "{0}"),
        ("<p title='a > b' class=\"x\">{0}</p>", "{0}"),
        ("<form id=f><p>x</p></form><div>" + "<div>" * 3000 + "<p>{0}</p>", "{0}"),
        ("<p>{0}</p>" + "<p>{1}</p>" * 3000, "{0}" + "\n{1}" * 3000),
    ],
)
def test_html_regions(page, want):
    """An article's own title, parts around a menu, stray quotes, deep nesting and long pages."""
    w = html_extract.fit(html_extract.labelled_pages())
    assert html_extract.extract(f"<html><body>{page.format(*PROSE)}</body></html>", w) == want.format(*PROSE)


def test_mixing(spark):
    sf = "/root/testdata/sf0.001"
    rows = mixing.op1_context_mixing(spark, sf).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = collections.Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = docs[r["doc_id"]]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(want) and r["held_out"] == held[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def learnt_state(*texts):
    s = mixing.State()
    for _ in range(3):
        s.learn(*mixing.tokens_of(list(texts))[:2])
    s.freeze()
    return s


def test_mixing_is_a_distribution():
    """Over all codes the probabilities sum to one, after any context."""
    s = learnt_state(b"the cat sat on the mat", b"a dog ran")
    codes = np.arange(1 << mixing.BITS)
    contexts = mixing.tokens_of([b"the cat"])[1]
    for k in range(contexts.shape[1]):
        assert np.sum(10 ** s.log10(codes, np.repeat(contexts[:, k : k + 1], len(codes), 1))) == pytest.approx(1, rel=1e-4)


def test_mixing_against_scalar_code():
    """log10 of each code, bit by bit from leaf counts, weights and map."""
    s = learnt_state(b"the cat sat on the mat", b"the cat ran to the dog", b"a dog ran")
    code, contexts, *_ = mixing.tokens_of([b"the cat ran on", b""])
    keys = s.keys(contexts)
    refined = s.refined().reshape(mixing.GATES, mixing.STEPS)
    got = s.log10(code, contexts)
    for t in range(len(code)):
        want = 0.0
        for b in range(mixing.BITS):
            g, k = divmod(b, mixing.GROUP)
            logits = []
            for leaf in s.leaf(code[t : t + 1], keys[:, t : t + 1], g)[:, 0]:
                run, end = divmod(int(leaf), 16)
                width = 8 >> k
                first = end // width * width  # leaves below the bit that came
                other = first ^ width
                came, not_came = (int(s.leaves[run, f : f + width].sum()) for f in (first, other))
                logits.append(max(-127, min(127, round(math.log((came + 0.02) / (not_came + 0.02)) * mixing.UNIT))))
            gate = 0 if logits[2] == 0 else 2 if abs(logits[2]) >= mixing.SURE else 1
            z = sum(float(w) * x / mixing.UNIT for w, x in zip(s.weights[3 * b + gate], logits, strict=True))
            z = max(-mixing.LIMIT, min(mixing.LIMIT, z))
            z = (z + refined[3 * b + gate, int(z * 2 + 16.5)]) / 2
            want -= math.log10(1 + math.exp(-z))
        assert got[t] == pytest.approx(want, abs=1e-3)


def test_mixing_followers(spark, monkeypatch):
    """Words that are not hot: the gain of each text is that of their followers, counted over the learnt texts without its own."""
    monkeypatch.setattr(mixing, "HOT_WORDS", 0)
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randint(0, 40))) for _ in range(40)]
    texts += [texts[3], texts[4], texts[4]]
    docs = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id long, text string, use boolean")
    got = {r["doc_id"]: r["score"] for r in mixing.score(docs, F.col("use")).collect()}
    real = mixing.followers
    monkeypatch.setattr(mixing, "followers", lambda rare: real(rare).withColumn("top", F.lit(0).cast("long")).withColumn("follower", F.lit(-1)))
    plain = {r["doc_id"]: r["score"] for r in mixing.score(docs, F.col("use")).collect()}
    codes = {i: mixing.tokens_of([t.encode()])[0].tolist() for i, t in enumerate(texts)}
    pairs, kinds = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t in enumerate(texts):
        if i % 4:
            for w, c in zip(t.split(), codes[i][1:], strict=True):
                pairs[w][c] += 1
    best = {w: max((n, c) for c, n in f.items()) for w, f in pairs.items()}

    def kind(top, total):
        size = top - 1 if top <= 3 else 3 if top < 8 else 4 if top < 16 else 5
        return 3 * size + (0 if top == total else 1 if 2 * top > total else 2) if top else None

    for w, f in pairs.items():
        for c, n in f.items():
            for _ in range(n):
                kinds[kind(best[w][0] - (c == best[w][1]), sum(f.values()) - 1), c == best[w][1]] += 1
    for i, t in enumerate(texts):
        lo = hi = 0.0
        for w, c in zip(t.split(), codes[i][1:], strict=True):
            if w in best:
                top, follower = best[w]
                k = kind(top - (c == follower and i % 4 > 0), sum(pairs[w].values()) - (i % 4 > 0))
                n = kinds[k, True] + kinds[k, False]
                q = (kinds[k, True] + 0.5) / (n + 1) if k is not None and n else 0.0
                if c != follower:
                    lo, hi = lo + math.log10(1 - q), hi + math.log10(1 - q)
                else:
                    hi += math.log10(q + 1e-9) + 9 if q else 0.0
        assert lo - 1e-6 <= got[i] - plain[i] <= hi + 1e-6
        if all(c != best.get(w, (0, c))[1] for w, c in zip(t.split(), codes[i][1:], strict=True)):
            assert got[i] - plain[i] == pytest.approx(lo, abs=1e-6)


def test_mixing_odd_rows(spark):
    """Nulls, empty and long texts, repeats, no training rows, and columns that have the names of the module's own."""
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a " * 5000), (None, "x")], "doc_id long, text string")
    odd = docs.withColumn("row", F.lit("r")).withColumn("n_tokens", F.lit("mine")).withColumn("learnt", F.lit(7)).withColumn("a.b", F.lit(1)).withColumn("_0", F.lit(2)).withColumn("word", F.lit("w"))
    got = mixing.score(odd, F.col("doc_id") == 3).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 5001]
    assert {(r["row"], r["learnt"], r["a.b"], r["_0"], r["word"]) for r in got} == {("r", 7, 1, 2, "w")}
    none = mixing.score(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    assert mixing.score(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("texts", [[], [None], [None, None, "", "same text", "same text"]])
def test_small_tables(spark, texts):
    docs = frame(spark, texts, [7] * len(texts)) if texts[:1] != [] else frame(spark, ["x"]).limit(0)
    for op in (line_dedup.dedup_lines, exact_dedup.dedup, near_dedup.near_duplicates, substring_dedup.remove_repeats, sharding.assign, bpe.digests):
        assert op(docs).count() == len(texts), op


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert docs.count() <= seen
        seen = docs.count()
    assert cp.run(spark, sf).count() == seen > 100


def test_substring_dedup_hot_passage(spark, texts, monkeypatch):
    """Cutting the segments of hot minimisers to shared context changes nothing."""
    docs = frame(spark, texts)
    want = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "HOT_CLASSES", 2)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want


@pytest.mark.parametrize("inner", ["<dl>" + "<dt>a term<dd>its meaning" * 40 + "</dl>", "<dl>" + "<dt>a term<dd>its meaning" * 40, "<table>" + "<tr><td>one cell" * 40 + "</table>", "<table>" + "<tr><td>one cell" * 40, "<ul>" + "<li><b>point" * 80, "<div>" * 70])
@pytest.mark.parametrize("closed", ["aside", "header", "form", "nav"])
def test_html_omitted_end_tags(closed, inner):
    """The end tag of an element is found however many elements were left open in it."""
    w = html_extract.fit(html_extract.labelled_pages())
    prose = "The river rose in the night and the lower fields were under water by dawn."
    assert html_extract.extract(f"<html><body><{closed}>{inner}</{closed}><article><p>{prose}</p></article></body></html>", w) == prose


def test_html_implied_ends():
    """A cell, row, term or point ends the one before it, and not those of an outer table or list."""
    def places(page):
        return {what.strip(): place for kind, what, *rest in html_extract.events(page) if kind == "text" for place in rest}

    assert places("<table><tr><td><form>x<td>y<tr><th>z</table>") == {"x": "form", "y": "td", "z": "th"}
    assert places("<dl><dt><a>x<dd>y<dt>z</dl>w") == {"x": "dt+a", "y": "dd", "z": "dt", "w": ""}
    assert places("<ul><li>a<ol><li>b<li>c</ol>d<li>e</ul>f") == {"a": "li", "b": "li", "c": "li", "d": "li", "e": "li", "f": ""}


def test_decontamination_masks_miss_nothing():
    """Whatever words differ, each overlap that counts holds all words of some mask."""
    masks = [{sum(c) for r in range(len(m) + 1) for c in itertools.combinations(m, r)} for m in decontaminate.MASKS]
    for n in range(8, 17):
        for equal in map(set, itertools.combinations(range(n), math.ceil(n * 12 / 16))):
            assert any({at + k for k in m} <= equal for m in masks for at in range(n)), (n, equal)


def test_decontamination_against_brute_force(spark):
    """Copies with replaced words, in items of 8 to 40 words: all that reach the threshold are found, shorter ones where they are whole, and no others."""
    rng = random.Random(8)
    items = [[f"i{i}w{k}" for k in range(n)] for i, n in enumerate([*range(2, 20), 40])]
    docs, want = [], {}
    for i, item in enumerate(items):
        n = len(item)
        away = [set(), set(range(3, n, 4)), *(set(rng.sample(range(n), min(k, n))) for k in (1, 2, 3, 4, 5) for _ in range(6))]
        for a in away:
            own = [k not in a for k in range(n)]
            best = max(sum(own[k : k + 16]) for k in range(max(1, n - 15)))
            if best >= math.ceil(min(n, 16) * 12 / 16) if n >= 8 else n >= 4 and not a:
                want[len(docs)] = ([i], best)
            docs.append(" ".join(["before"] * 9 + [w if o else "other" for w, o in zip(item, own, strict=True)] + ["after"] * 9))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["matched"]) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == want


@pytest.mark.parametrize("start", ["<body class='has-sidebar'>", "<body class='sidebar'>", "<article class='post comments-open'>", "<article class='comments'>", "<main id=content class=related>", "<div class='content-with-sidebar'>", "<div class='popular'>"])
def test_html_names_do_not_empty_a_page(start):
    """Names of layouts cost no text; listed ones are still left out inside the article."""
    w = html_extract.fit(html_extract.labelled_pages())
    one, two = "The river rose in the night and the lower fields were under water by dawn.", "Engineers will look at the dam on Monday and the road stays shut."
    got = html_extract.extract(f"<html>{start}<p>{one}</p><div class='ad'>Buy one now.</div><p>{two}</p><div class='comments'><p>Great piece, thanks!</p></div>", w)
    assert one in got and two in got
    if "popular" not in start:
        assert got == f"{one}\n{two}"


PAGE = "Flood\nThe river rose in the night and the lower fields were under water by dawn, said the keeper.\nEngineers will look at the dam on Monday and the road stays shut until then."
ARTICLE = "<article><h1>{}</h1><p>{}</p><p>{}</p></article>".format(*PAGE.split("\n"))
OTHERS = "<p>Great piece, thanks for it, I liked it!</p><p>Me too, said another reader.</p>"


@pytest.fixture(scope="module")
def html_weights():
    return html_extract.fit(html_extract.labelled_pages())


@pytest.mark.parametrize("start", ["<html><head><title>x</title><body>", "<html><head><meta charset=utf-8><title>x</title><link href=y><script>var a='<p>';</script>", "<head><title>x</title><div>", "<html><head><noscript><link href=y></noscript><style>p{}</style></head><body>"])
def test_html_head_ends_by_itself(html_weights, start):
    assert html_extract.extract(start + ARTICLE, html_weights) == PAGE


@pytest.mark.parametrize("inner", [ARTICLE, ARTICLE.replace("article", "div"), f"<div class=main-content>{ARTICLE}</div><label>Your name</label><fieldset>Pick one of these</fieldset>"])
def test_html_form_around_a_page(html_weights, inner):
    page = f"<html><body><form id=aspnetForm action=/><input name=v><nav><a href=/>Home</a></nav>{inner}<footer>Copyright nobody</footer></form></body></html>"
    assert html_extract.extract(page, html_weights) == PAGE
    assert html_extract.extract(f"<html><body>{ARTICLE}<form id=f><p>Leave us your address.</p><input></form></body></html>", html_weights) == PAGE


@pytest.mark.parametrize("where", ["before", "after", "inside"])
@pytest.mark.parametrize("names", ["class='comment-list'", "id='comments-section'", "class='site-sidebar'", "class='main-menu'", "id='gdpr-banner'", "class='commentList'", "id=disqus_thread", "class='sidebar-right col-4'", "class='related-posts'", "class='social-share-bar'", "class='cookieConsent'", "class='newsletter-box'", "class='site-footer-inner'", "class='ad-container'", "role='complementary'", "class='popup-overlay'"])
def test_html_names_are_learnt_by_part(html_weights, names, where):
    other = f"<div {names}>{OTHERS}</div>"
    body = {"before": other + ARTICLE, "after": ARTICLE + other, "inside": ARTICLE.replace("<p>Eng", other + "<p>Eng")}[where]
    assert html_extract.extract(f"<html><body>{body}</body></html>", html_weights) == PAGE


@pytest.mark.parametrize("names", ["class='content-with-sidebar'", "class='page has-sidebar'", "class='post-12 post type-post hentry'", "class='col-md-8 container'", "class='l-content clearfix'", "id='bodyContent'", "class='layout-sidebar-left'", "class='navbar-fixed'"])
def test_html_names_around_an_article(html_weights, names):
    for inner in (ARTICLE, ARTICLE.replace("article", "div")):
        assert html_extract.extract(f"<html><body><nav><a href=/>x</a></nav><div {names}>{inner}</div></body></html>", html_weights) == PAGE


def test_html_comments_as_articles(html_weights):
    many = f"<section><article class='comment'>{OTHERS * 9}</article></section>"
    assert html_extract.extract(f"<html><body>{ARTICLE}{many}</body></html>", html_weights) == PAGE


def test_html_whole_rule_by_hand(html_weights):
    """Random flat pages: the blocks that the rule keeps, worked out from the weights without the scan."""
    w, rng = html_weights, random.Random(12)

    def by_hand(blocks, use_names):
        scores, left = [], html_extract.BREAK
        for k, (tag, text) in enumerate(blocks):
            name, _, names = tag.partition(" ")
            closed, cost = name in html_extract.CLOSED, min(0.0, w.names.score(" " + names)) if names and use_names else 0.0
            weight = w.word(name + (f"~{cost:.2f}" if cost else ""))
            kept = not closed and (not cost or weight > 0)
            for score, is_text in ((w.tag(name), False), (len(text.split()) * weight, True), (w.tag("/" + name), False)):
                if is_text and kept:
                    left = html_extract.BREAK
                elif is_text:
                    score = max(score, -left)
                    left += min(score, 0.0)
                scores.append((score, text if is_text and kept else None))
        runs = [(sum(s for s, _ in scores[a : b + 1]), a, b) for a in range(len(scores)) for b in range(a, len(scores))]
        best = max(r[0] for r in runs)
        _, a, b = min((r for r in runs if r[0] > best - 1e-9), key=lambda r: (r[2], r[1]))
        return "\n".join(t for _, t in scores[a : b + 1] if t) if best > 0 else ""

    for _ in range(60):
        tags = [rng.choice(["p", "nav", "p", "footer", "p class=sidebar", "p class=comment-list"]) for _ in range(rng.randint(1, 9))]
        blocks = [(tag, " ".join(f"w{k}x{j}" for j in range(rng.randint(1, 12)))) for k, tag in enumerate(tags)]
        page = "".join(f"<{tag}>{text}</{tag.split()[0]}>" for tag, text in blocks)
        want = by_hand(blocks, True)
        if not want and any(" " in tag for tag in tags):
            want = by_hand(blocks, False)
        assert html_extract.extract(page, w) == want, page


def test_line_dedup_counts_documents_not_rows(spark):
    """A line of two documents stays in both, however many rows one of them has."""
    line = "a line that is long enough to count"
    ids, texts = [1, 1, 2, 3, 4, 5], [f"x\n{line}", f"y\n{line}", line, *[line + " twice over"] * 3]
    got = sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, texts, ids)).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0)]


def odd_frame(spark, rows):
    """(doc_id, text) with columns that the modules use themselves."""
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_id", "_hash", "_lines", "_drops", "n_lines", "lines", "text_hash", "score", "_score", "kept", "rep", "digest", "salt", "block", "words", "_0"):
        out = out.withColumn(name, F.lit("mine"))
    return out


ODD = [(None, None), (None, "one two three"), (1, ""), (2, "a b c d e f " * 30), (2, "other words that say nothing at all to anyone here"), (3, "a b c d e f " * 30), (3, "a b c d e f " * 30), (4, "z" * 100_000), (4, None)]


def test_clashing_columns_nulls_and_repeats(spark):
    """Every operator returns one row a row, whatever the other columns are called."""
    docs = odd_frame(spark, ODD)
    for op in (line_dedup.dedup_lines, exact_dedup.dedup, near_dedup.near_duplicates, substring_dedup.remove_repeats, sharding.assign, bpe.digests):
        assert op(docs).count() == len(ODD), op
        assert op(docs.limit(0)).count() == 0, op
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert {r["_id"] for r in kept.collect()} == {"mine"}
    bench = spark.createDataFrame([(1, "a b c d e f a b c d")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), len(r["text"] or "")) for r in left.collect()) == [(0, 0), (0, 13), (1, 0), (4, 0), (4, 100_000)]
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_exact_dedup_repeats_and_collisions(spark, monkeypatch):
    """Repeated ids, rows without id, salted groups, and digests that several texts have."""
    texts = ["a", " a", "b b", "bb ", None, "", "c", "cc"]
    rows = [(i % 7 if i % 9 else None, texts[i % 8] if i % 5 else "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def brute():
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[WS.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
        best = {k: min(g) for k, g in groups.items()}
        return sorted((i if i is not None else -1, best[k][2] if not best[k][1] else -1, len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [WS.sub("", t or "")])

    def got():
        return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"], r["text_sha256"]) for r in exact_dedup.dedup(docs).collect())

    assert got() == brute()
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert got() == brute()
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.when(norm.isin("a", "bb"), F.lit("same")).otherwise(norm))
    assert [x[:3] for x in got()] == [x[:3] for x in brute()]


def test_exact_dedup_levels(spark):
    """Compaction of runs and of levels made before gives the same entries as of all at once; the filter lets all of them through."""
    docs = frame(spark, [f"t{i % 17}" for i in range(60)])
    a, b = exact_dedup.flush(docs.where("doc_id < 25")), exact_dedup.flush(docs.where("doc_id >= 25"))
    once, twice = exact_dedup.compact(a, b), exact_dedup.compact(exact_dedup.compact(a), b)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    few = once.where("size > 3")
    passed = exact_dedup.with_pass(once, *exact_dedup.filter_of(few)).where("may")
    assert passed.join(few, "digest", "left_semi").count() == few.count() and passed.count() < once.count()


def test_repeated_ids_with_other_texts(spark):
    """Rows that share a doc_id are judged by their own text."""
    rng = random.Random(9)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, a)], "doc_id long, text string")
    gone = {(r["doc_id"], r["text"]): r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert gone == {(1, a): 0, (2, ""): 60, (2, b): 0, (None, a): 0}
    near = sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert near == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True)]
    lines = spark.createDataFrame([(1, a), (2, a), (3, a), (3, b), (None, a)], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["n_dropped"]) for r in line_dedup.dedup_lines(lines).collect()) == [(0, 0), (1, 1), (2, 1), (3, 0), (3, 0)]


def test_near_dedup_links_of_repeated_ids(spark):
    """Both texts of a repeated doc_id keep their links."""
    rng = random.Random(10)
    a, b = ([f"w{rng.randrange(9000)}" for _ in range(100)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "more"])), (7, " ".join([*b, "more"])), (8, "something else entirely, of few words")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in ((5, 96), (6, 97), (7, 97))] == [5, 5, 5]


def test_quality_odd_rows(spark):
    """Labels that disagree, repeated rows, rows without id, empty tables."""
    docs = spark.createDataFrame([(i, f"good text number {i} with words") for i in range(0, 40)] + [(i, "BUY!!! 1234 $$$ NOW") for i in range(40, 80)] + [(0, "another text"), (None, "x"), (None, None)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(0, 0), (1, None), (999, 1)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, quality.with_scores(docs, quality.fit(docs, labels), "score").select("doc_id", "text", "score").na.fill(-1).na.fill("").collect())) for _ in range(2))
    assert one == two and len(one) == 83
    assert np.mean([s for i, t, s in one if t.startswith("good")]) > 0.8 > 0.2 > np.mean([s for i, t, s in one if t.startswith("BUY")])
    assert quality.with_scores(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_quality_against_full_sort():
    """The vote of each text is that of its nearest neighbours by a full sort of all cosines."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "12", "!!", "é"], 12)).encode() for _ in range(90)]
    rows = [quality.terms(t) for t in texts]
    labels = rng.integers(0, 2, 90)
    model = quality.Neighbours(np.stack([r[0] for r in rows]), np.array([r[1] for r in rows]), labels)
    for t, got in zip(texts[:20], model.score(texts[:20], block=7), strict=True):
        x = model.embed(np.stack([quality.terms(t)[0]]), np.array([quality.terms(t)[1]]))[0]
        cosine = sorted(((float(v @ x), int(q)) for v, q in zip(model.vectors, labels, strict=True)), reverse=True)
        weight = [max(c, 1e-6) ** quality.SHARPNESS for c, _ in cosine]
        edge = cosine[quality.NEIGHBOURS - 1][0]
        if cosine[quality.NEIGHBOURS][0] < edge - 1e-5:  # no tie at the edge
            k = quality.NEIGHBOURS
            assert got == pytest.approx(sum(w * q for w, (_, q) in zip(weight[:k], cosine[:k], strict=True)) / sum(weight[:k]), abs=1e-4)


def test_sharding_against_drawn_tree(spark):
    """Every row's shard by descending the tree outside Spark, rows without doc_id and repeated rows included."""
    import struct

    xxhash = pytest.importorskip("xxhash")

    def draw(key, children):
        costs = []
        for name, weight, value in children:
            seed = xxhash.xxh64_intdigest(name.encode(), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed) if key is not None else seed
            costs.append((-math.log(((h >> 11) + 1.0) / 2**53) / weight, value))
        return min(costs)[1] if len(children) > 1 else children[0][2]

    def shard(key, shape):
        region = draw(key, [(r, sum(map(len, racks.values())), r) for r, racks in shape.items()])
        rack = draw(key, [(k, len(s), k) for k, s in shape[region].items()])
        return draw(key, [(f"{rack}s{s}", 1, s) for s in shape[region][rack]])

    docs = spark.createDataFrame([(i, "t") for i in [*range(300), 5, 5]] + [(None, None)], "doc_id long, text string")
    rows = sharding.assign(docs).collect()
    assert len(rows) == 303
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], sharding.tree(16)), shard(r["doc_id"], sharding.tree(16, extra=1)))


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_shared_folder_of_a_local_session_without_setting():
    """A folder of one's own is set once, on the context, as the setting cannot be changed in a running session."""

    class Context:
        master, folder = "local[2]", None

        @staticmethod
        def getConf():
            return {}

        @classmethod
        def getCheckpointDir(cls):
            return cls.folder

        @classmethod
        def setCheckpointDir(cls, folder):
            assert cls.folder is None
            cls.folder = folder + "/app"

    class Session:
        sparkContext, conf = Context, {}

    one, two = common.shared_dir(Session), common.shared_dir(Session)
    assert one != two and one.startswith(Context.folder + "/") and two.startswith(Context.folder + "/")


def test_discard(spark):
    import os

    df = common.stored(spark.range(3))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    common.discard(df)
    assert not os.path.exists(folder)


def test_pipeline_against_brute_force(spark, monkeypatch):
    """Rows, not counts, of all stages on a small corpus with odd rows and columns."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    shared = "this line stands in many documents of the corpus"
    base = rng.choices(vocab, k=80)
    item = rng.choices(vocab, k=20)
    texts = {1: " ".join(base), 2: " ".join([*base, "tail"]), 3: f"{shared}\n" + " ".join(rng.choices(vocab, k=50)), 4: f"{shared}\n" + " ".join(rng.choices(vocab, k=50)), 5: f"{shared}\n" + " ".join(rng.choices(vocab, k=50)), 6: "x y " + " ".join(item) + " z", 7: "BAD", 8: "", None: "no id"}
    docs = odd_frame(spark, list(texts.items()))
    monkeypatch.setattr(quality, "fit", lambda docs, labels: None)
    monkeypatch.setattr(quality, "with_scores", lambda docs, model, name: docs.withColumn(name, F.when(F.col("text") == "BAD", 0.1).otherwise(0.9)))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    monkeypatch.setattr(cp, "table", lambda spark, sf_dir, name: {"documents": docs, "benchmark": bench}.get(name))
    columns, at = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        at = common.stored(stage(spark, at, ""))
        assert at.columns == columns, name
        assert {r["_id"] for r in at.collect()} == {"mine"} and {r["n_lines"] for r in at.collect()} == {"mine"}
    want = {1: texts[1], 3: texts[3].split("\n")[1], 4: texts[4].split("\n")[1], 5: texts[5], 8: "", None: "no id"}
    assert {r["doc_id"]: r["text"] for r in at.collect()} == want
    assert {r["doc_id"]: r["decoded_sha256"] for r in cp.run(spark, "").collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_settled_leaves_only_the_result(spark, tmp_path, monkeypatch):
    """What was stored on the way is gone, within a settled frame of a settled frame too; what was stored before stays."""
    folders = (f"file://{tmp_path}/{k}" for k in itertools.count())
    monkeypatch.setattr(common, "shared_dir", lambda spark: next(folders))
    outside = common.stored(spark.range(3))

    def inner():
        return common.stored(outside.where("id > 0")).unionByName(common.stored(spark.range(9, 10)))

    out = common.settled(lambda: common.settled(inner).unionByName(common.stored(outside)))
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 1, 2, 2, 9]
    assert len(list(tmp_path.iterdir())) == 2 and outside.count() == 3
    assert common.settled(lambda: common.stored(outside).limit(0)).count() == 0
