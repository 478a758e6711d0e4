import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.operators import surfaces
from uqframe.plans.surfaces import surface_report, with_ratio


def block(doi, points, fn):
    return [(doi, "f", float(x), float(y), float(fn(x, y)), float(fn(x, y))) for x, y in points]


SCHEMA = "doi string, feedstock string, temp_c double, t_min double, b_y double, p_b_y double"
GRID = [(x, y) for x in (200, 240, 280, 320, 360) for y in (5, 15, 25, 35)]


def inside(x, y):
    return 60 - ((x - 290) / 40) ** 2 - ((y - 21) / 8) ** 2 + (x - 290) * (y - 21) / 900


def test_quadratic_is_recovered(spark):
    rows = block("a", GRID, inside) + block("b", GRID, lambda x, y: 0.1 * x + 0.2 * y)
    rows += block("few", GRID[:5], inside)
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = surfaces.fit_surfaces(surfaces.block_rows(df, "temp_c", "t_min", "b_y", "p_b_y"))
    got = {r["doi"]: r for r in fitted.collect()}
    assert set(got) == {"a", "b"} and got["a"]["full_rank"]
    points = fitted.join(df, ["doi", "feedstock"]).select(
        "b_y", surfaces.surface_value(F.col("temp_c"), F.col("t_min")).alias("z")).collect()
    assert [r["z"] for r in points] == pytest.approx([r["b_y"] for r in points], abs=1e-8)
    best = {r["doi"]: r for r in surfaces.surface_optimum(fitted, "b_y").collect()}
    assert best["a"]["opt_location"] == "interior" and best["b"]["opt_location"] == "edge"
    assert best["a"]["z_opt"] == pytest.approx(60, abs=0.05)
    assert best["b"]["x_opt"] == pytest.approx(360 + 0.05 * 160)


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(180, 380, 80), rng.uniform(5, 90, 80)
    z = 3 + 0.1 * x - 0.2 * y + rng.normal(0, 2, 80)
    df = spark.createDataFrame([("a", "f", float(a), float(b), float(c), float(c)) for a, b, c in zip(x, y, z)], SCHEMA)
    fitted = surfaces.fit_surfaces(surfaces.block_rows(df, "temp_c", "t_min", "b_y", "p_b_y"))
    u, v = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    design = np.stack([np.ones(80), u, v, u * u, u * v, v * v], axis=1)
    beta = np.linalg.lstsq(design, z, rcond=None)[0]
    got = fitted.collect()[0]
    assert [got[f"b{i}"] for i in range(6)] == pytest.approx(list(beta), abs=1e-8)


def test_rank_deficient_block(spark):
    points = [(x, y) for x in (200, 300) for y in (5, 10, 15, 20)]
    df = spark.createDataFrame(block("a", points, lambda x, y: x / 10 + y), SCHEMA)
    fitted = surfaces.fit_surfaces(surfaces.block_rows(df, "temp_c", "t_min", "b_y", "p_b_y"))
    assert not fitted.collect()[0]["full_rank"]
    z = fitted.join(df, ["doi", "feedstock"]).select("b_y", surfaces.surface_value(
        F.col("temp_c"), F.col("t_min")).alias("z")).collect()
    assert [r["z"] for r in z] == pytest.approx([r["b_y"] for r in z], abs=1e-8)


def test_report_and_ranges(spark):
    df = spark.createDataFrame(block("a", GRID, inside) + block("b", GRID[:8], inside)
                               + block("c", [(200, 5)] * 9, inside), SCHEMA)
    df = df.withColumn("cat_acid", F.lit(0.0)).withColumn("cat_metal", (F.col("doi") == "b").cast("double"))
    out = surface_report(df, "b_y", "p_b_y", k=1).collect()
    assert [r["doi"] for r in out] == ["a"] and out[0]["catalyst"] == "none" and out[0]["solvent"] == "water"
    assert out[0]["r2"] == 1.0 and out[0]["units"] == "% w/w"
    both = {r["doi"]: r["catalyst"] for r in surface_report(df, "b_y", "p_b_y").collect()}
    assert both == {"a": "none", "b": "metal"}
    assert [surfaces.physical_range(t) for t in ("b_y", "hhv_biooil", "o_c_biooil", "c_biooil", "e_b")] == [
        (0.0, 100.0), (0.0, 50.0), (0.0, 3.0), (0.0, 100.0), (0.0, None)]
    assert surfaces.target_label("n_biochar") == ("wt %", "Nitrogen in biochar (wt%)")
    assert surfaces.target_label("zzz") == ("", "zzz")


def test_ratio_columns(spark):
    df = spark.createDataFrame([(20.0, 60.0, 21.0, 61.0)], "o_biooil double, c_biooil double, p_o_biooil double, p_c_biooil double")
    got = with_ratio(df, "o_c_biooil").collect()[0]
    assert got["o_c_biooil"] == pytest.approx(20 / 15.999 / (60 / 12.011))
    with pytest.raises(KeyError):
        with_ratio(df, "h_c_biooil")
