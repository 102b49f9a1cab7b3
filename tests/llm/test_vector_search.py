import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm.vector_search import OneBitCodes, SearchParams, nearest, rotation


def test_rotation_is_orthogonal_and_bounds_hold():
    r = rotation(48, 1)
    assert np.allclose(r @ r.T, np.eye(48))
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 48)), rng.standard_normal(48)
    low, high = OneBitCodes(x, r).bounds(q, 3.0)
    exact = ((x - q) ** 2).sum(axis=1)
    assert ((low <= exact + 1e-6) & (exact <= high + 1e-6)).mean() > 0.99
    assert np.corrcoef((low + high) / 2, exact)[0, 1] > 0.7


def test_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(16)]) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(40)]  # ties
    bad = [(700, None), (701, []), (702, [0.0] * 16), (703, [1.0] * 15 + [None]), (704, [float("nan")] + [1.0] * 15), (705, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (800, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, vector array<double>").selectExpr("*", "1 as block", "2 as dims").repartition(3)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for p in (SearchParams(), SearchParams(block=100, query_block=3), SearchParams(block=30, centroids=12, fit_rows=200)):
        got = {}
        for r in nearest(df, F.col("vec_id") % 50 == 0, p).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        hit = total = 0
        for q in ids[ids % 50 == 0]:
            d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
            d[ids == q] = np.inf
            want = ids[np.lexsort((ids, d))[:10]].tolist()
            mine = [v for _, v, _ in sorted(got[q])]
            assert len(mine) == 10
            hit, total = hit + len(set(want) & set(mine)), total + 10
        assert hit / total >= 0.99 and set(got) == set(ids[ids % 50 == 0].tolist()) | {800} - {800}
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, vector array<double>")
    assert [(r["rank"], r.vec_id) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def clustered(n=900):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((9, 8)) * 20
    x = centres[rng.integers(0, 9, n)] + rng.standard_normal((n, 8))
    return x, [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def test_far_centroids_are_ruled_out_without_loss(spark):
    """In clusters a query meets few centroids, and its result is that of brute force."""
    x, rows = clustered()
    p = SearchParams(block=100, centroids=9, fit_rows=900)
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 30 == 0, p).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 900, 30):
        d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        assert [got[q][k + 1] for k in range(10)] == [(int(i), float(d[i])) for i in want]


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from cuelake.llm import queries as Q

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = sorted(con.execute(Q.ORACLES["op6_vector_search"]).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in Q.op6_vector_search(spark, path).collect()) == want
