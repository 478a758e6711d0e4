import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.llm import postings

SCHEMA = "vec_id long, embedding array<float>, rank int"


def vectors(n, dim=16, seed=2):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(30, dim)) * r.uniform(0.5, 2, (30, 1))
    x = (centers[r.integers(0, 30, n)] + r.normal(size=(n, dim)) * 0.3).astype(np.float32)
    x[10:40] = x[10]  # exact copies
    return x


def brute(x, ids, q, k=20):
    s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_recall_and_scores(spark):
    x = vectors(3000)
    ids = np.arange(3000)
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (None, x[0].tolist(), 1),
             (5060, [1.0] * 3, 1), (5080, [None] * 16, 1), rows[7]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in postings.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        want = brute(x, ids, q)
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(f[2] - float(x[q].astype(float) @ x[f[1]].astype(float))) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & {w[0] for w in want})
    assert hits / (20 * len(got)) > 0.95
    assert [f[1] for f in got[20]][:5] == [i for i, _ in brute(x, ids, 20)][:5]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(20 * i, [1.0 + i, 2.0], 0) for i in range(n)], SCHEMA)
    assert postings.search(df, F.col("vec_id") % 20 == 0).count() == n * max(0, n - 1)
