import pytest
from pyspark.sql import functions as F

from uqframe.operators import envelopes, physics

YIELDS = "b_y double, c_y double, a_y double, g_y double"


def test_closure(spark):
    rows = [(50.0, 30.0, 20.0, 100.0), (-10.0, 30.0, 20.0, 50.0), (0.0, 0.0, 0.0, 0.0),
            (None, None, None, None), (None, 30.0, 20.0, 50.0), (25.0, 25.0, 25.0, 25.0), (-5.0, -5.0, None, 0.0)]
    df = spark.createDataFrame(rows, YIELDS)
    got = [tuple(r) for r in physics.yield_closure(df).collect()]
    assert got[0] == pytest.approx((25, 15, 10, 50))
    assert got[1] == pytest.approx((0, 30, 20, 50))
    assert got[2] == (0, 0, 0, 0) and got[3] == (None,) * 4
    assert got[4][0] is None and sum(got[4][1:]) == pytest.approx(100)
    assert got[5] == pytest.approx((25,) * 4) and got[6] == (0.0, 0.0, None, 0.0)
    full = physics.yield_closure(df, clip=False, partial=False, suffix="_phys").collect()
    assert full[4]["c_y_phys"] == 30.0 and full[1]["b_y_phys"] == pytest.approx(-10 / 90 * 100)
    errors = [r["closure_error"] for r in physics.closure_error(df).collect()]
    assert errors == pytest.approx([100, -10, -100, -100, 0, 0, -110])
    none = physics.closure_error(spark.range(1)).collect()[0]["closure_error"]
    assert none is None


def test_derived(spark):
    df = spark.createDataFrame([(50.0, 30.0, 20.0), (None, 30.0, 20.0)], "b_y double, c_y double, hhv_biooil double")
    got = physics.derived_energy(df).collect()
    assert got[0]["e_b_phys"] == pytest.approx(10) and got[0]["e_h_phys"] is None and got[1]["e_b_phys"] is None
    assert "e_h_phys" not in physics.derived_energy(df, strict=False).columns


def test_evaluation_minimum(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("b_y"), (F.col("id") + 1.0).alias("p_b_y"),
                                F.when(F.col("id") < 5, 1.0).alias("a_y"), F.lit(1.0).alias("p_a_y"))
    got = {r["target"]: r for r in physics.physics_evaluation(df, ["b_y", "a_y"]).collect()}
    assert got["b_y"]["rmse_raw"] == 1.0 and got["a_y"]["rmse_raw"] is None and got["a_y"]["n"] == 5
    assert got["closure_raw"]["n"] == 20


def test_envelopes(spark):
    full = '{"QA":{"envelope":{"E_B_range":[1,2],"E_H_range":[3,4],"C_B_range":[0.1,0.2],"C_H_range":[0.3,0.4]}}}'
    part = '{"QA":{"envelope":{"E_B_range":[1,2]}}}'
    rows = [(full, "HTC", None, 50.0, 20.0), (part, "HTC", None, 50.0, 20.0), ("bad", "Liquefaction", None, 50.0, 20.0),
            (None, None, " HTL ", None, 20.0), (None, "fast Pyrolysis", None, 50.0, None),
            (None, None, None, -5.0, 20.0), ('{"QA":{"envelope":{}}}', "x", None, 50.0, 20.0)]
    df = spark.createDataFrame(rows, "extra string, process_type_a string, process_type_b string, b_y double, hhv_biooil double")
    got = [(r["e_b_lo"], r["e_b_hi"], r["e_h_hi"]) for r in envelopes.add_envelopes(df).collect()]
    assert got[0] == (1, 2, 4) and got[1] == (1, 2, 22)
    assert got[2] == pytest.approx((0, 10.5, 8)) and got[3] == (0, 25, 8) and got[4] == (0, 22, 18)
    assert got[5] == (0, 0, 22) and got[6] == pytest.approx((0, 10.5, 22))


def test_yield_envelopes_and_balance(spark):
    rows = [("HTC", 40.0, 30.0, 20.0, 10.0), ("HTC", None, 30.0, 20.0, 10.0), ("HTC", 60.0, 60.0, 60.0, 1.0)]
    df = spark.createDataFrame(rows, "process_type_a string, " + YIELDS)
    out = envelopes.add_envelopes(df, "yield").collect()
    assert (out[0]["c_y_lo"], out[0]["c_y_hi"]) == pytest.approx((0, 30.6))
    assert (out[1]["c_y_lo"], out[1]["c_y_hi"]) == (20.0, 90.0)
    assert out[1]["b_y_hi"] == pytest.approx(40.8) and out[2]["g_y_hi"] == 0.0
    got = envelopes.mass_balance(df).collect()[0]
    assert (got["checked"], got["violations"]) == (2, 1)


def test_rules(spark):
    df = spark.createDataFrame([(-1.0, 0.5, 26.0), (50.0, 2.0, None), (None, None, 1.0)],
                               "b_y double, h_c double, e_h double")
    got = {r["rule"]: r["n_rows"] for r in envelopes.rule_counts(df).collect()}
    assert got["b_y_range"] == 1 and got["h_c_range"] == 2 and got["e_h_high"] == 1 and got["c_b_high"] == 0
    assert envelopes.rule_violations(df, ["b_y"]).count() == 4
