import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from uqframe.operators.quantiles import exact_quantiles, long_values, nth_smallest, quantile_columns, rank_values
from uqframe.sources.session import new_path

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]


def samples():
    rng = random.Random(7)
    yield "ties", [float(rng.randrange(4)) for _ in range(500)]
    yield "signs", [rng.gauss(0, 3) for _ in range(400)] + [0.0, -0.0, 1e-300, -1e300, 1e300]
    yield "narrow", [1e9 + rng.random() for _ in range(300)]
    yield "one", [4.25]
    yield "two", [1.0, 2.0]
    yield "epoch", [1.7e9 + rng.randrange(86_400) for _ in range(30_000)]
    yield "wide", [10.0 ** rng.uniform(-300, 300) for _ in range(25_000)]
    yield "sorted", [float(i // 3) for i in range(60_000)]
    yield "skewed", [0.0] * 20_000 + [float(rng.randrange(3)) for _ in range(4_000)] + [rng.random() for _ in range(500)]
    yield "hot", [5.0] * 300 + [rng.random() for _ in range(200)]


@pytest.mark.parametrize("name,values", list(samples()))
def test_equals_numpy(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = {r["prob"]: r["q"] for r in exact_quantiles(df, ["v"], PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_groups_with_null_key_nan_and_inf(spark):
    rng = random.Random(3)
    rows = [(g, rng.gauss(i, 1), rng.random()) for i, g in enumerate(["a", "b", None]) for _ in range(60)]
    rows += [("a", math.nan, 1.0), ("b", math.inf, None), ("c", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {(r["g"], r["variable"]): r for r in quantile_columns(
        df, ["x", "y"], {"lo": 0.1, "hi": 0.8}, ["g"]).collect()}
    assert ("c", "x") not in out and out["c", "y"]["n"] == 1
    for g in ("a", "b", None):
        for i, c in ((1, "x"), (2, "y")):
            v = [r[i] for r in rows if r[0] == g and r[i] is not None and math.isfinite(r[i])]
            assert out[g, c]["n"] == len(v)
            assert out[g, c]["lo"] == pytest.approx(np.quantile(v, 0.1))
            assert out[g, c]["hi"] == pytest.approx(np.quantile(v, 0.8))


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]).count() == 0


def test_ranks_beside_the_brackets(spark):
    """Positions by count, in groups of few and of many rows, two scans of the rows in all."""
    df = spark.range(90_000).select((F.col("id") % 2).alias("g"), F.pmod(F.col("id") * 7919, F.lit(90_001)).cast("double").alias("v"))
    df = df.unionByName(spark.range(50).select(F.lit(2).cast("long").alias("g"), (F.col("id") / 3).alias("v")))
    rank = F.least(F.ceil((F.col("n") + 1) * F.lit(0.9)), F.col("n")) - 1
    long = long_values(df, ["v"], ["g"])
    got = {r["g"]: r["v_lo"] for r in rank_values(long, ["g"], [rank], [0.9], False).collect()}
    rows = df.collect()
    for g in (0, 1, 2):
        v = sorted(r["v"] for r in rows if r["g"] == g)
        assert got[g] == v[min(math.ceil((len(v) + 1) * 0.9), len(v)) - 1]
    assert nth_smallest(df, "v", F.col("n") - 1, 1.0).first()["value"] == max(r["v"] for r in rows)
    path = new_path(spark, "scan")
    df.select("v").write.parquet(path)
    plan = exact_quantiles(spark.read.parquet(path), ["v"], [0.1, 0.5])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Scan parquet") <= 2
