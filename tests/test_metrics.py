import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.operators import intervals, metrics, profile


def frame(spark, rows, schema="y double, p double"):
    return spark.createDataFrame(rows, schema)


def test_r2_edges(spark):
    rows = [("one", 1.0, 2.0), ("const", 3.0, 3.0), ("const", 3.0, 4.0), ("same", 3.0, 3.0),
            ("same", 3.0, 3.0), ("ok", 1.0, 1.5), ("ok", 2.0, 1.5), ("ok", 4.0, 5.0), ("ok", None, 1.0),
            ("ok", 2.0, math.nan), ("null", None, 1.0)]
    out = {r["g"]: r for r in metrics.parity_metrics(frame(spark, rows, "g string, y double, p double"), ["g"]).collect()}
    assert out["one"]["r2"] is None and out["one"]["nrmse"] is None
    assert out["const"]["r2"] == 0.0 and out["same"]["r2"] == 1.0 and "null" not in out
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 1.5, 5])
    assert out["ok"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert out["ok"]["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))


def test_interval_and_group_reports(spark):
    rows = [("a", 1.0, 1.0, 0.0, 2.0), ("a", 2.0, 2.5, 2.1, 3.0), ("a", 3.0, 3.0, None, None),
            ("b", 1.0, 1.0, 0.0, 2.0), (None, 1.0, 1.0, 0.0, 2.0)]
    df = frame(spark, rows, "target string, y double, p double, lo double, hi double")
    out = {r["target"]: r for r in metrics.interval_report(df).collect()}
    assert out["a"]["coverage"] == pytest.approx(1 / 3) and out["b"]["r2"] is None and out["b"]["n"] == 1
    groups = metrics.problem_groups(df, "target", 1).collect()
    assert {r["target"] for r in groups} == {"a", "b"}
    assert next(r for r in groups if r["target"] == "a")["coverage"] == pytest.approx(0.5)
    assert metrics.group_report(df, "target", 3).count() == 1


def test_histogram_edges(spark):
    df = frame(spark, [(0.0,), (1.0,), (2.0,), (4.0,)], "v double")
    out = metrics.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["cnt"] for r in out] == list(np.histogram([0, 1, 2, 4], 4)[0])
    flat = metrics.histogram(frame(spark, [(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    count, edges = np.histogram([2.0] * 3, 4)
    assert [r["cnt"] for r in flat] == list(count)
    assert [r["low"] for r in flat] == pytest.approx(list(edges[:-1]))


def test_density_curve(spark):
    rng = np.random.default_rng(0)
    big, small = rng.normal(5, 2, 60), np.array([3.0, 5.0, 6.0])
    rows = [("train", float(v)) for v in big] + [("test", float(v)) for v in small]
    out = metrics.density_curve(frame(spark, rows, "split string, v double"), "v", ["split"], 50).orderBy("i").collect()
    x = np.linspace(min(big.min(), 3.0), max(big.max(), 6.0), 50)
    h = big.std(ddof=1) * len(big) ** -0.2
    kde = np.exp(-0.5 * ((x[:, None] - big) / h) ** 2).sum(1) / (len(big) * h * math.sqrt(2 * math.pi))
    assert [r["density"] for r in out if r["split"] == "train"] == pytest.approx(list(kde))
    hist, edges = np.histogram(small, 30, density=True)
    ys = np.interp(x, (edges[:-1] + edges[1:]) / 2, hist, left=0.0, right=0.0)
    assert [r["density"] for r in out if r["split"] == "test"] == pytest.approx(list(ys), abs=1e-9)


@pytest.mark.parametrize("n, far", [(5, 0.0), (20_000, 0.0), (3_000, 1e4)])
def test_density_of_different_values(spark, n, far):
    """Cells and their moments give the direct sum, also with one value far away."""
    values = np.append(np.random.default_rng(n).normal(3, 2, n - 1), 4 + far)
    df = frame(spark, [("a", float(v)) for v in values] + [("flat", 4.0)] * 9, "g string, v double")
    out = metrics.density_curve(df, "v", ["g"], 40).orderBy("i").collect()
    x = np.linspace(values.min(), values.max(), 40)
    h = values.std(ddof=1) * n ** -0.2
    direct = np.array([np.exp(-0.5 * ((p - values) / h) ** 2).mean() for p in x]) / (h * math.sqrt(2 * math.pi))
    got = np.array([r["density"] for r in out if r["g"] == "a"])
    assert len(got) == 40 and np.abs(got - direct).max() < 5e-12 / h
    assert sum(r["g"] == "flat" for r in out) == 40


def test_qq_and_residuals(spark):
    rng = np.random.default_rng(1)
    err = np.round(rng.normal(0, 2, 300), 1)
    df = frame(spark, [(float(i), float(i + e)) for i, e in enumerate(err)])
    z = metrics.standardized_residuals(df).orderBy("y").collect()
    assert [r["z"] for r in z] == pytest.approx(list(err / (err.std(ddof=1) + 1e-9)), abs=1e-7)
    runs = metrics.qq_runs(frame(spark, [(float(e),) for e in err], "z double")).orderBy("value").collect()
    values, counts = np.unique(err, return_counts=True)
    last = np.cumsum(counts)
    assert [r["value"] for r in runs] == pytest.approx(list(values))
    assert [(r["first"], r["last"]) for r in runs] == list(zip(last - counts + 1, last))


def test_conformal_widths(spark):
    resid = [float(v) for v in range(1, 100)]
    df = frame(spark, [("t", v, 0.0) for v in resid], "target string, y double, p double")
    base = intervals.conformal_residuals(df)
    assert intervals.conformal_width(base, 0.1).collect()[0]["q"] == pytest.approx(np.quantile(resid, 0.9))
    assert intervals.conformal_width(base, 0.1, finite_sample=True).collect()[0]["q"] == 90.0
    few = intervals.conformal_residuals(df.where("y <= 3"))
    assert intervals.conformal_width(few, 0.1, finite_sample=True).collect()[0]["q"] == 3.0
    out = intervals.global_conformal(df, intervals.conformal_width(base, 0.1))
    assert out.where("lo > hi").count() == 0


def test_fitted_line(spark):
    x = np.arange(10.0)
    y = 2 * x + 1 + np.sin(x)
    df = frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y)], "split string, y double, p double")
    out = metrics.fitted_line(df, points=5).orderBy("i").collect()
    slope, icept = np.polyfit(x, y, 1)
    assert [r["fit"] for r in out] == pytest.approx([slope * r["x"] + icept for r in out])
    s = math.sqrt(((y - slope * x - icept) ** 2).sum() / 8)
    half = 2.306 * s * math.sqrt(0.1 + (out[0]["x"] - 4.5) ** 2 / ((x - 4.5) ** 2).sum())
    assert out[0]["hi"] - out[0]["fit"] == pytest.approx(half, rel=5e-3)


def test_profile_and_bootstrap(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("row_id"), (F.col("id") * 1.0).alias("y"),
                                 (F.col("id") + F.col("id") % 7).alias("p"))
    got = profile.bootstrap_rmse(df).collect()[0]
    assert got["lo"] < got["rmse"] < got["hi"] and got["replicates"] == 40
    corr = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, ["y", "p"]).collect()}
    a = np.arange(500.0)
    assert corr["y", "p"] == pytest.approx(np.corrcoef(a, a + a % 7)[0, 1])
    out = {r["variable"]: r for r in profile.quality_profile(
        frame(spark, [(1.0, None), (2.0, None), (3.0, None), (100.0, None)], "a double, b double"), ["a", "b"]).collect()}
    assert out["a"]["n_outliers"] == 1 and out["b"]["n_missing"] == 4 and out["b"]["n_outliers"] == 0
    assert profile.duplicate_rows(frame(spark, [(1.0, 2.0)] * 3 + [(1.0, 3.0)]), ["y", "p"]).collect()[0]["copies"] == 3


def test_result_summary(spark):
    rows = spark.createDataFrame([("b_y", 0.5), ("o_c_biooil", 0.1), ("c_b", 0.2), ("x", None)], "target string, r2_rf double")
    derived = spark.createDataFrame([("o_c_biooil", 0.9)], "target string, r2_rf double")
    none = {r["target"]: r["category"] for r in metrics.result_summary(rows).collect()}
    assert none == {"b_y": "Yield", "c_b": "Energy", "x": "Other"}
    assert metrics.result_summary(rows, "direct").count() == 4
    got = metrics.result_summary(rows, "derived", derived).where("target = 'o_c_biooil'").collect()
    assert got[0]["r2_rf"] == 0.9
    with pytest.raises(KeyError):
        metrics.metric_matrix(rows, "r2")


def test_overlap_window(spark):
    rows = [("train", float(v)) for v in range(100)] + [("test", float(v)) for v in range(50, 150)]
    got = metrics.overlap_window(frame(spark, rows, "split string, y double")).collect()[0]
    assert got["overlap"] and got["lo"] == pytest.approx(np.quantile(range(50, 150), 0.05))
    few = metrics.overlap_window(frame(spark, rows[:103], "split string, y double")).collect()[0]
    assert not few["overlap"] and (few["lo"], few["hi"]) == (0.0, 99.0)
