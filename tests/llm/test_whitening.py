import os
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from cuelake.llm.whitening import WhiteningParams, bit_planes, fit_whitening, scatter, whiten


def test_planes_and_scatter_equal_products():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 2**b, 201) for b in (1, 7, 20, 40, 0)], axis=1).astype(np.uint64)
    planes = bit_planes(x[:, 1])
    assert planes.shape == (int(x[:, 1].max()).bit_length(), 4)
    sums, cross = scatter(x)
    exact = x.astype(object)
    assert sums == exact.sum(axis=0).tolist()
    for i in range(5):
        for j in range(i, 5):
            assert cross[i][j] == int((exact[:, i] * exact[:, j]).sum())


def brute(rows, p=WhiteningParams()):
    """(n, S, deviation of each row, covariance as fractions) by plain integers."""
    x = [[int(np.floor(p.scale * c)) + p.offset for c in v] for v in rows]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(d)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    cov = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit), n**3)) for j in range(d)] for i in range(d)]
    return n, sums, deviation, np.array(cov), np.array(x, float)


def check(got, ids, rows, components=16):
    n, sums, deviation, cov, x = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, {})[r.component] = r
    k = min(components, len(sums))
    assert sorted(mine) == sorted(ids) and all(sorted(m) == list(range(1, k + 1)) for m in mine.values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert all(r.n == n for r in got)
    for at, i in enumerate(ids):
        assert {r.deviation for r in mine[i].values()} == {deviation[at]}
    for c in range(1, k + 1):
        w = np.array([mine[i][c].whitened for i in ids])
        sign = np.sign(w @ want[:, c - 1])
        assert np.allclose(w, sign * want[:, c - 1], rtol=1e-7, atol=1e-9)
        assert abs(mine[ids[0]][c].explained - values[c - 1] / np.trace(cov)) < 1e-12


def test_equals_exact_covariance(spark):
    rng = np.random.default_rng(2)
    turn = rng.standard_normal((20, 20)) * np.linspace(0.2, 3, 20)
    rows = [[float(np.float32(c)) for c in rng.standard_normal(20) @ turn] for _ in range(300)]
    rows += [rows[3]] * 200  # repeats are fitted once
    ids = list(range(len(rows)))
    bad = [(9000, None), (9001, []), (9002, [None] * 20), (9003, [float("nan")] * 20), (9004, [float("inf")] + [0.0] * 19), (9005, [1.0, 2.0]), (9006, [1e30] + [0.0] * 19)]
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)) + bad, "vec_id long, vector array<float>").selectExpr("*", "1 as x", "2 as dims", "3 as component").repartition(6)
    for p in (WhiteningParams(), WhiteningParams(chunk=37, components=25)):
        check(whiten(df, p).collect(), ids, rows, p.components)


def test_degenerate_tables(spark):
    schema = "vec_id long, vector array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    (a, b) = whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).orderBy("component").collect()
    assert (a.n, a.deviation, a.whitened, a.explained, a.identity_error) == (1, 0, None, None, None) and b.component == 2
    line = [(i if i else None, [i / 8, i / 4]) for i in range(5)] * 2  # one direction only, repeated, a null id
    got = whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 20 and {r.n for r in got} == {5}
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9
    far = whiten(spark.createDataFrame([(1, [2.0**45]), (2, [0.0])], schema)).collect()
    assert {r.deviation for r in far} == {None} and {round(abs(r.whitened), 9) for r in far} == {1.0}


def test_large_values_stay_exact(spark):
    rows = [(float(2**40 + i), float(i % 3)) for i in range(50)]
    distinct = spark.createDataFrame([([int(64 * a), int(64 * b)],) for a, b in rows], "x array<long>")
    model = fit_whitening(distinct, 2)
    xs = [[int(64 * a), int(64 * b)] for a, b in rows]
    sums = [sum(x[i] for x in xs) for i in range(2)]
    assert list(model.sums) == sums
    assert [list(r) for r in model.scatter] == [[50 * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j] for j in range(2)] for i in range(2)]


def test_query_equals_exact_covariance(spark):
    from cuelake.llm import queries as Q

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    got = Q.op13_embedding_whitening(spark, path).collect()
    t = pq.read_table(f"{path}/embeddings.parquet")
    check(got, t["vec_id"].to_pylist(), t["embedding"].to_pylist())
