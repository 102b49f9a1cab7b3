import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm.hard_negatives import Columns, HardNegativeParams, hard_negatives, keep_top, keep_windows, window_of


def brute(rows, anchors, p=HardNegativeParams()):
    """Contract by plain loops over (vec_id, label, integer vector)."""
    out = []
    for a, label, x in anchors:
        scored = sorted((-sum(i * j for i, j in zip(x, y)), v, other) for v, other, y in rows if v != a and len(y) == len(x))
        for s, pos, _ in [t for t in scored if t[2] == label][: p.positives]:
            fit = [t for t in scored if t[2] != label and p.low[0] * -s <= p.low[1] * -t[0] and t[0] >= s][: p.negatives]
            out += [(a, pos, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")


def test_scan_reads_less_and_loses_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((32, 4000)) * 40).astype(np.int64)
    anchor = np.floor(rng.standard_normal(32) * 40 * np.exp(-np.arange(32) / 4)).astype(np.int64)
    block = Columns(np.arange(4000), np.zeros(4000, np.int64), x)
    exact = anchor @ x
    rows, score, read = block.scan(anchor, np.ones(4000, bool), keep_top(5), 4)
    assert rows[block.best(rows, score, 5)].tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist()
    assert (score == exact[rows]).all() and read < 0.8 * x.size
    windows = [window_of(int(np.sort(exact)[-k]), HardNegativeParams()) for k in (3, 40)]
    rows, score, read = block.scan(anchor, np.ones(4000, bool), keep_windows(windows, 5), 4)
    for a, b in windows:
        inside = np.flatnonzero((exact >= a) & (exact <= b))
        want = inside[np.lexsort((inside, -exact[inside]))[:5]]
        mine = np.flatnonzero((score >= a) & (score <= b))
        assert rows[mine[block.best(rows[mine], score[mine], 5)]].tolist() == want.tolist()
    assert read < 0.9 * x.size


def test_windows_of_positive_zero_and_negative_scores():
    p = HardNegativeParams()
    assert window_of(10, p) == (8, 10) and window_of(11, p) == (9, 11) and window_of(0, p) == (0, 0)
    a, b = window_of(-10, p)
    assert a > b


def test_equals_brute_force_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        v = rng.standard_normal(12) * 0.2 + (0.2 if i % 3 else -0.1)
        rows.append((i, int(rng.integers(0, 4)), [float(np.float32(c)) for c in v]))
    rows += [(1000 + i, 1, rows[20][2]) for i in range(150)]  # ties by score
    rows += [(2000, 2, [0.0] * 12), (2050, 3, [1.0, 2.0]), (2100, 3, [1.0, 1.0]), (2150, 1, [1.0, 1.5])]  # zero, another length
    bad = [(3000, None, rows[0][2]), (3050, 1, None), (3100, 1, [None] * 12), (3150, 1, [float("nan")] * 12), (3200, 1, [float("-inf")] + [0.0] * 11), (3250, 1, []), (3300, 1, [1e30] * 12), (None, 1, rows[0][2])]
    whole = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in rows]
    want = brute(whole, [r for r in whole if r[0] % 50 == 0])
    df = table(spark, rows + bad).selectExpr("*", "1 as block", "2 as dims", "'x' as part").repartition(5)
    for p in (HardNegativeParams(), HardNegativeParams(block=90, part=3, stride=1)):
        got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, p).collect())
        assert got == want and len(got) > 100


def test_few_rows_repeats_and_empty_table(spark):
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.25]), (2, 2, [1.0, 0.25])]
    got = sorted(tuple(r) for r in hard_negatives(table(spark, rows), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 2, 98304, 81920), (0, 1, 2, 2, 98304, 81920)]
    assert hard_negatives(table(spark, rows).limit(0), F.lit(True)).count() == 0
    assert hard_negatives(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from cuelake.llm import queries as Q

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = sorted(con.execute(Q.ORACLES["op11_hard_negatives"]).fetchall())
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in Q.op11_hard_negatives(spark, path).collect())
    assert got == want and got
