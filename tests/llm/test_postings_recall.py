import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_postings import SCHEMA, brute
from uqframe.llm import postings


def test_recall_without_clusters_and_with_many_lists(spark):
    n = 4000
    x = np.random.default_rng(4).normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(3)
    got: dict[int, set] = {}
    for r in postings.search(df, F.col("vec_id") % 20 == 0, postings.Settings(list_rows=16)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found & {i for i, _ in brute(x, np.arange(n), q)}) for q, found in got.items())
    assert len(got) == n // 20 and hits / (20 * len(got)) > 0.97


def test_recall_of_queries_that_were_not_calibrated_on(spark):
    """64 of 300 queries set the ratio, on vectors of very different lengths."""
    n = 6000
    r = np.random.default_rng(8)
    x = r.normal(size=(n, 32)) * r.uniform(0.2, 3, (n, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(3)
    got: dict[int, set] = {}
    s = postings.Settings(list_rows=32, calibrated=64)
    for row in postings.search(df, F.col("vec_id") % 20 == 0, s).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = sum(len(found & {i for i, _ in brute(x, np.arange(n), q)}) for q, found in got.items())
    assert len(got) == n // 20 and hits / (20 * len(got)) > 0.95


def test_the_graph_finds_the_centroids_within_a_ratio():
    r = np.random.default_rng(5)
    graph = postings.Graph(r.normal(size=(700, 24)).astype(np.float32), 24, 64)
    q = np.vstack([r.normal(size=(99, 24)), graph.centers[:1]]).astype(np.float32)
    far = graph.distances(q)
    for ratio in (1.0, 1.1, 1.3, 9.0):
        want = far <= ratio * np.maximum(far.min(axis=1, keepdims=True), 1.0)
        want[np.arange(100), far.argmin(axis=1)] = True
        got = np.zeros(far.shape, bool)
        got[graph.within(q, ratio, 1.0)] = True
        assert (got & want).sum() > 0.99 * want.sum() and not (got & ~want & (far > ratio * 1.001 * np.maximum(far.min(axis=1, keepdims=True), 1))).any()
