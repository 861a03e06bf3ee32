"""The stored text index against the scan of all texts."""

import random

from sessionloom.operators import search, text_index
from sessionloom.sources.store import Tables


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def test_text_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)] + ["Caché", "common"]
    said = lambda: " ".join(rng.choices(vocab, weights=[1] * 31 + [12], k=rng.randint(0, 40)))
    texts = {f"d{i:03}": said() for i in range(150)} | {"none": None, "empty": "", "odd": "... !"}
    index = text_index.TextIndex(Tables(spark, str(tmp_path), buckets=8))
    files = lambda: {f for f in tmp_path.rglob("part-*")}

    def agrees(*queries, limit=7):
        frame = docs(spark, list(texts.items()))
        for query in queries or ("w3 common",):
            got = [(r["id"], round(r["score"], 9)) for r in index.bm25(query, limit).collect()]
            want = [(r["id"], round(r["score"], 9)) for r in search.bm25(frame, query, limit).collect()]
            assert got == want, query
            want = {r["id"] for r in frame.where(search.match_all("text", query)).collect()}
            assert {r["id"] for r in index.matching(query).collect()} == want

    assert index.add(docs(spark, list(texts.items()))) == 153
    agrees("w3", "w1 cache common", "nowhere w7", "nowhere", "")
    before = files()
    assert index.add(docs(spark, list(texts.items()))) == 0 and files() == before
    # new documents are appended, and no file of others is touched
    texts |= {f"e{i}": said() for i in range(20)}
    assert index.add(docs(spark, list(texts.items()))) == 20
    postings = {f for f in before if "_postings" in str(f)}
    assert postings <= files()
    agrees()
    texts["d001"], texts["d002"] = "w3 w3 w3 rewritten", None
    assert index.add(docs(spark, list(texts.items()))) == 2
    agrees()
    gone = ["d001", "d003", "e4", "odd"]
    for k in gone:
        texts.pop(k)
    assert index.remove(docs(spark, [(k, "") for k in [*gone, "unknown"]])) == 4
    agrees()
    held = [str(r) for f in tmp_path.rglob("part-*") for r in spark.read.parquet(str(f)).collect()]
    assert not any(f"'{k}'" in r for r in held for k in gone) and not any("rewritten" in r for r in held)
    # a search reads the buckets of its terms
    every = index.tables.read(index.postings).inputFiles()
    assert 0 < len(index._of(["w3"]).inputFiles()) < len(every)


def test_text_index_of_nothing(spark, tmp_path):
    index = text_index.TextIndex(Tables(spark, str(tmp_path)))
    assert index.bm25("x", 3).count() == 0 and index.matching("x").count() == 0 and index.remove(docs(spark, [("a", "")])) == 0
    assert index.add(docs(spark, [])) == 0 and index.bm25("x", 3).count() == 0 and index.matching("x").count() == 0


def test_text_index_moves_little(spark, tmp_path):
    """Building an index shuffles and writes a few times the texts; ids that come twice count once, null texts have no terms."""
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(4000)]
    texts = [(f"d{i:05}", " ".join(rng.choices(vocab, k=150))) for i in range(2000)]
    read = spark.createDataFrame([*texts, texts[0], texts[1], ("none", None)], "id string, text string")
    read.repartition(4).write.parquet(f"{tmp_path}/in")
    index = text_index.TextIndex(Tables(spark, f"{tmp_path}/out", buckets=4))
    jvm = spark.sparkContext._jvm
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    moved = lambda seen: sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (seen.apply(i) for i in range(seen.size())))
    before = moved(stages())
    assert index.add(spark.read.parquet(f"{tmp_path}/in")) == 2001
    assert moved(stages()) - before < 3 * sum(len(t) for _, t in texts)
    got = {(r["term"], d["id"]): (d["tf"], d["length"]) for r in index.tables.read(index.postings).collect() for d in r["docs"]}
    assert got == {(w, k): (t.split().count(w), 150) for k, t in texts for w in set(t.split())}
    assert {r["id"]: r["length"] for r in index.tables.read(index.documents).collect()} == {k: 150 for k, _ in texts} | {"none": 0}
    assert not any((tmp_path / "out" / "_staged").glob("*"))
