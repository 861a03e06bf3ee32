"""Every query with SQL agrees with DuckDB on the small tables."""

import random

import duckdb
import pytest

from sessionloom.operators import search
from sessionloom.plans import relational, retrieval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**relational.QUERIES, **retrieval.QUERIES}
ORACLE = {**relational.ORACLE, **retrieval.ORACLE}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        names = [d[0] for d in r.description]
        want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
        assert got == want
    else:
        assert got


def test_knn_join_of_odd_vectors(spark, duck, tmp_path):
    """Scaled copies (equal but for rounding), copies, infinity and NaN rank as SQL ranks them; pairs are not rows."""
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = []
    for i in range(200):
        k = rng.choice([1.0, 3.0, 0.7, 1.1])
        rows.append((i, [x * k for x in base[i % 12]]))
    rows += [(201, [float("nan")] * 5), (202, base[3]), (203, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["knn_join"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    sql = ORACLE["knn_join"].replace("embeddings", f"read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(duck.execute(sql).fetchall()) and len(got) == 10 * 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_knn_join_of_vectors_without_similarity(spark):
    """Null vectors and vectors with a null come last, zero vectors are at 0; unequal lengths raise."""
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, query array<double>")
    got = {q: [] for q in "qzn"}
    for r in sorted(search.knn_join(vectors, queries, 5).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["similarity"]))
    last = [(4, None), (5, None)]
    assert got == {"q": [(1, 1.0), (3, 0.0), (2, -1.0), *last], "z": [(1, 0.0), (2, 0.0), (3, 0.0), *last], "n": [(i, None) for i in range(1, 6)]}
    with pytest.raises(Exception, match="differ in length"):
        search.knn_join(vectors, queries.selectExpr("query_id", "array(1D) AS query"), 5).collect()
