"""The fitted embedding against a plain one in numpy, and against hashing on planted paraphrases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions import vectors as V
from sessionloom.operators import embedding as E

TOPICS, SIZE = 30, 4


@pytest.fixture(scope="module")
def texts(spark):
    """Paraphrases: four words of six of a topic, in another order, among common words."""
    r = random.Random(7)
    common = [f"common{i}" for i in range(40)]
    rows = []
    for topic in range(TOPICS):
        own = [f"t{topic}w{i}" for i in range(6)]
        for _ in range(SIZE):
            words = r.sample(own, 4) + r.choices(common, weights=[1 / (i + 1) for i in range(40)], k=20)
            r.shuffle(words)
            rows.append((len(rows), topic, " ".join(words)))
    return rows


def _near(rows, vectors) -> float:
    """Share of the three nearest texts that are of the text's own topic."""
    m = np.array([vectors[i] for i, _, _ in rows])
    sim = m @ m.T
    np.fill_diagonal(sim, -9)
    topic = np.array([t for _, t, _ in rows])
    return float(np.mean([np.mean(topic[np.argsort(-s)[: SIZE - 1]] == t) for s, t in zip(sim, topic)]))


def test_paraphrases_are_nearer_than_by_hashing(spark, texts):
    df = spark.createDataFrame(texts, "id int, topic int, text string")
    tokens = T.tokens("text")
    fitted = {r["id"]: r["v"] for r in E.embedded(df, tokens, E.fit(spark, df, tokens), "v").collect()}
    hashed = {r["id"]: r["v"] for r in df.select("id", V.hashed_embedding(tokens).alias("v")).collect()}
    a, b = _near(texts, fitted), _near(texts, hashed)
    assert a > 0.85 and a > b + 0.3, (a, b)


def test_model_against_numpy(spark, texts):
    df = spark.createDataFrame(texts, "id int, topic int, text string").repartition(3)
    tokens, dims = T.tokens("text"), 16
    model = E.fit(spark, df, tokens, dims, 2)
    got = {r["id"]: r["v"] for r in E.embedded(df, tokens, model, "v", dims).collect()}
    words = sorted({w for _, _, t in texts for w in t.split()})
    at = {r["w"]: (r["p"], r["b"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", V.place(F.col("w"), dims).alias("p"), E.bucket(F.col("w")).alias("b")).collect()}
    n = len(texts)
    held = [{at[w][1] for w in t.split()} for _, _, t in texts]
    raw = np.zeros((n, dims))
    for i, (_, _, t) in enumerate(texts):
        for w in t.split():
            p, b = at[w]
            raw[i, abs(p) - 1] += math.copysign(math.log((n + 1) / (sum(b in h for h in held) + 1)), p)
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    first = np.linalg.eigh(raw.T @ raw)[1][:, ::-1][:, :2]
    want = raw - raw @ first @ first.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-6)


def test_defined_cases(spark):
    shape = "id int, text string"
    none = spark.createDataFrame([], shape)
    model = E.fit(spark, none, T.tokens("text"))
    assert model.first()["directions"] == [] and set(model.first()["weights"]) == {0.0}
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (4, "other words")]
    df = spark.createDataFrame(rows, shape).withColumn("weights", F.lit(1)).withColumn("directions", F.lit("d"))
    got = E.embedded(df, T.tokens("text"), E.fit(spark, df, T.tokens("text"), common=0), "v")
    assert got.columns == ["id", "text", "weights", "directions", "v"] and got.count() == 5
    length = {(r["id"]): round(sum(x * x for x in r["v"]), 9) for r in got.collect()}
    assert length == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}
    assert E.embedded(none, T.tokens("text"), model, "v").count() == 0


def test_directions_of_low_rank():
    assert E.directions([[0.0, 0.0], [0.0, 0.0]], 2) == []
    v = E.directions([[4.0, 2.0], [2.0, 1.0]], 2)
    assert len(v) == 1 and np.allclose(np.abs(v[0]), [2 / math.sqrt(5), 1 / math.sqrt(5)])


def test_engine_embeds_by_the_fitted_model(spark, tmp_path):
    """A fit embeds messages and facts anew, once; later messages and questions use the model."""
    import json

    from sessionloom.api import Engine

    folder = tmp_path / "p"
    folder.mkdir()

    def say(session, *texts):
        rows = [{"type": "assistant", "uuid": f"{session}{i}", "sessionId": session, "timestamp": f"2025-01-17T10:0{i}:00.000Z", "cwd": "/w", "message": {"role": "assistant", "content": t}} for i, t in enumerate(texts)]
        (folder / f"{session}.jsonl").write_text("\n".join(map(json.dumps, rows)))

    say("a", "We decided to use redis because it is fast.", "the plan is to write the parser", "the plan is to read the queue")
    e = Engine(spark, str(tmp_path / "store"))
    e.index("/proj", [str(folder)], 1)
    vectors = lambda name, key="message_id": {r[key]: r["embedding"] for r in e.tables.read(name).collect()}
    hashed, facts = vectors("embeddings"), vectors("fact_embeddings", "id")
    assert e.fit_embedding() == 3 and e.fit_embedding() == 0
    fitted = vectors("embeddings")
    assert {len(v) for v in hashed.values()} == {64} and {len(v) for v in fitted.values()} == {E.DIMENSIONS}
    assert {len(v) for v in vectors("chunk_embeddings").values()} == {E.DIMENSIONS}
    assert facts and {k: len(v) for k, v in vectors("fact_embeddings", "id").items()} == dict.fromkeys(facts, E.DIMENSIONS)
    say("b", "the queue is read by the parser")
    e.index("/proj", [str(folder)], 2)
    assert {k: v for k, v in vectors("embeddings").items() if k in fitted} == fitted and len(vectors("embeddings")) == 4
    assert e.tables.read("index_runs").where("at = 2").first()["embedded"] == 1
    assert e.search("parser").count() >= 2 and e.decisions("redis").count() == 1
