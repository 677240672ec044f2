import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import ann

VECTORS = "vec_id long, embedding array<float>, rank int"


def brute(rows, k):
    good = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    out = {}
    for q, x in good:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(np.cumsum((x - y) ** 2)[-1])), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out[q] = [(i, s) for s, i in near]
    return {q: v for q, v in out.items() if v}


def check(spark, rows, k=4, **kw):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], VECTORS)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k, **kw).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert found == brute(rows, k)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[40:80] = x[40]  # equal vectors: ties
    x[100:120] = x[99] + rng.normal(size=(20, 16)) * 1e-6
    x[200] *= 1e6
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    check(spark, rows)
    check(spark, rows, query_block=7, block_values=16 * 40)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 2.0]), (6, []), (7, [1.0, None]), (10, [1.0, 2.0, 3.0]), (15, [3.0, 2.0, 1.0]), (20, [9.0] * 4)]
    check(spark, rows, k=10)
    assert ann.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_wide_vectors_are_exact():
    rng = np.random.default_rng(2)
    a = rng.integers(-127, 128, (3, 3000)).astype(np.float32)
    assert (ann.products(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()


def test_repeated_rows_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [5.0, 1.0]), (3, [9.0, 9.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], VECTORS)
    want = sorted((float(np.hypot(a[0] - b[0], a[1] - b[1])), j) for i, a in rows for j, b in rows if i == 0 and j != 0)[:4]
    got = ann.nearest(df, F.col("vec_id") == 0, 4).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(n + 1, v) for n, (_, v) in enumerate(want)]
    for scale in (1e200, 1e-200, 1.5e308):
        x = [(0, [scale, 0.0]), (1, [scale, scale / 4]), (2, [scale / 2, 0.0]), (3, [-scale, 0.0]), (4, [1.0, 1.0])]
        df = spark.createDataFrame([(i, v, 1) for i, v in x], VECTORS.replace("float", "double"))
        got = ann.nearest(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()
        assert [r.vec_id for r in got] == ([1, 2, 3] if scale < 1 else [1, 2, 4])
        assert np.isclose(got[0].score, scale / 4) and np.isclose(got[1].score, scale / 2)
