from dataclasses import replace
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.llm import multi_index
from uqframe.llm.multi_index import Settings

SCHEMA = "vec_id long, embedding array<double>, label int, cell string"


def brute(rows, s=Settings(), step=10):
    usable = {}
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or any(x is None or not isfinite(x) for x in v):
            continue
        one = (str(label), [floor(256 * x) for x in v])
        usable[i] = min(usable.get(i, one), one)
    out = set()
    for a, (label, q) in usable.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, own != label)
                        for i, (own, v) in usable.items() if i != a)
        for p, positive, _ in [r for r in scored if not r[2]][:s.positives]:
            fit = [(n, i) for n, i, other in scored if other and -s.low * p <= -100 * n <= -s.high * p]
            out |= {(a, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit[:s.negatives])}
    return out


def clustered(n, dim=8, seed=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    x = centers[r.integers(0, 12, n)] + 0.2 * r.normal(size=(n, dim))
    x[20:90] = x[20]  # equal vectors
    return [(int(i), v.tolist(), int(r.integers(0, 4)), "x") for i, v in enumerate(x)]


def mined(spark, rows, s=Settings(), step=10, n=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(n)
    whole = multi_index.whole_vectors(df, F.col("label"))
    got = [tuple(r) for r in multi_index.mine(whole, F.col("vec_id") % step == 0, s).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, small):
    rows = clustered(600)
    rows += [(1000, None, 1, "x"), (1010, [float("nan")] * 8, 1, "x"), (None, rows[0][1], 1, "x"),
             (1020, [None] * 8, 1, "x"), (1030, [1.0] * 8, None, "x"), (1040, [0.0] * 8, 2, None),
             (1050, [-1.0] * 8, 9, "x"), rows[10], (30, rows[5][1], 3, "x")]
    s = replace(Settings(), cell_rows=4, part_rows=16, probe_rows=40, block_anchors=8) if small else Settings()
    assert mined(spark, rows, s) == brute(rows)


def test_cells_are_left_out():
    """A tight cluster's anchor looks into few parts, and no row outside them scores enough."""
    r = np.random.default_rng(5)
    books = (r.normal(size=(8, 4)) * 100, r.normal(size=(8, 4)) * 100)
    radii = (np.full(8, 1.0), np.full(8, 1.0))
    index = multi_index.MultiIndex(books, radii, [range(c, c + 1) for c in range(64)], [10] * 64)
    anchor = np.concatenate([books[0][3], books[1][5]])
    visited = list(index.visit(anchor))
    assert [b for b, _ in visited] == sorted((b for b, _ in visited), reverse=True)
    assert sorted(c for _, c in visited) == list(range(64))
    score = {c: float(anchor[:4] @ books[0][c // 8] + anchor[4:] @ books[1][c % 8]) for c in range(64)}
    assert all(b >= score[c] for b, c in visited)
    needed = int(sorted(score.values())[-3])
    parts = index.parts_for(anchor, needed, None)
    assert len(parts) < 16 and {c for c, v in score.items() if v >= needed} <= set(parts)
    assert len(index.parts_for(anchor, multi_index.LOWEST, 25)) == 3


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1, "x")], [(0, [1.0], 1, "x"), (10, [2.0], 1, "x")],
                                  [(0, [2.0], 1, "x"), (10, [2.0], 1, "x"), (3, [1.5], 2, "x")]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_exact_beyond_doubles(spark):
    big = float(1 << 45)
    rows = [(i, [big + 64 * i, 0.5 * i, 1.0], i % 2, "x") for i in range(12)]
    q = spark.createDataFrame(rows, SCHEMA)
    v = {r.vec_id: r.v for r in multi_index.whole_vectors(q, F.col("label")).collect()}
    assert v[3] == [int(256 * (big + 192)), 384, 256]
    s = replace(Settings(), low=1, high=1000)
    small = [(i, [float(1 << 22) + i / 256, 0.5 * i, 1.0], i % 2, "x") for i in range(12)]
    assert mined(spark, small, s) == brute(small, s)
