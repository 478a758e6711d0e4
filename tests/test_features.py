import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.functions import exprs
from uqframe.operators import encode


def test_interactions(spark):
    rows = [("2", 3.0), ("x", 3.0), ("2", None), ("nan", 1.0), ("inf", 1.0), (None, None)]
    df = spark.createDataFrame(rows, "temp_c string, ic double")
    out, names = encode.add_interactions(df)
    assert names == ["int_t_ic", "int_t_ic_missing"]
    got = [(r["int_t_ic"], r["int_t_ic_missing"]) for r in out.collect()]
    assert got == [(6.0, 0), (0.0, 1), (0.0, 1), (0.0, 1), (0.0, 1), (0.0, 1)]


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("unseen",)], "family string")
    domain = ["", "a", "b"]
    out = encode.one_hot(df, "family", domain, "family_")
    names = [f"family_{v}" for v in domain] + ["family_nan"]
    out = out.select(encode.decode_one_hot(names, "family_"),
                     encode.decode_one_hot(names, "family_", training=False))
    assert [tuple(r) for r in out.collect()] == [
        ("b", "b"), ("a", "a"), ("Unknown", "nan"), ("Unknown", "Unknown"), ("Unknown", "Unknown")]
    tie = spark.createDataFrame([(1.0, 1.0)], "f_a double, f_b double")
    assert tie.select(encode.decode_one_hot(["f_a", "f_b"], "f_")).collect()[0][0] == "a"
    assert encode.learn_domain(df, "family") == ["", "a", "b", "unseen"]
    many = spark.range(1500).select(F.format_string("label %04d", "id").alias("family"))
    assert len(encode.learn_domain(many, "family")) == 1500


def test_logits(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 1e-4, 0.9999, -1.0, 0.3]], "v double")
    got = [r[0] for r in df.select(exprs.logit_to_frac(exprs.frac_to_logit("v"))).collect()]
    assert got == pytest.approx([1e-3, 0.999, 1e-3, 0.999, 1e-3, 0.3])
    pct = [r[0] for r in df.select(exprs.logit_to_pct(exprs.pct_to_logit(F.col("v") * 100))).collect()]
    assert pct == pytest.approx([0.1, 99.9, 0.1, 99.9, 0.1, 30.0])
    none = spark.createDataFrame([(None,)], "v double").select(exprs.frac_to_logit("v"))
    assert none.collect()[0][0] is None


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.7, 1.0, 2.0, 3.2])
def test_power_inverse(spark, lam):
    values = [-4.0, -0.5, 0.0, 0.3, 2.0, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    z = df.withColumn("z", exprs.yeo_johnson("v", lam))
    got = [r[0] for r in z.select(exprs.yeo_johnson_inverse("z", lam)).collect()]
    assert got == pytest.approx(values, abs=1e-9)


def test_power_choice(spark):
    rng = np.random.default_rng(4)
    y = np.expm1(rng.normal(2, 0.4, 4000))
    df = spark.createDataFrame([(float(v),) for v in y], "hhv_x double")
    assert abs(encode.fit_power(df, "hhv_x")) < 0.15  # log-normal data ask for the logarithm
    assert encode.choose_transform(df, "hhv_x").kind == "power"
    assert [encode.transform_kind(t) for t in ("c_b", "c_biooil", "o_c_biooil", "b_y")] == [
        "fraction", "percent", "identity", "identity"]


def test_weights(spark):
    temps = [0.0, 250.0, 250.5, 300.0, 350.0, 350.5, 1000.0, 1000.5, -1.0, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(temps)], "i int, temp_c double")
    got = {r["i"]: r["weight"] for r in encode.sample_weights(df).collect()}
    # the null temperature falls on the median 300, in the second bin
    expected = {0: 1 / 2, 1: 1 / 2, 2: 1 / 3, 3: 1 / 3, 4: 1.0, 5: 1 / 2, 6: 1 / 2, 7: 1.0, 8: 1.0, 9: 1 / 3}
    assert got == pytest.approx({k: v * 1.5 for k, v in expected.items()})
    assert {r["weight"] for r in encode.sample_weights(df, None).collect()} == {1.5}


def test_matrix_and_design(spark):
    df = spark.createDataFrame(
        [(1, 200.0, "x", None, True), (2, None, "y", 0.5, None), (3, 300.0, None, 0.1, False)],
        "row_id int, temp_c double, family string, frac_water double, acid_flag boolean")
    out = encode.build_features(df, ["temp_c", "gone"], ["frac_water"], ["acid_flag"], ["b_y"])
    assert out.x_cols == ["temp_c", "family_x", "family_y", "family_nan", "frac_water",
                          "frac_water_missing", "acid_flag"]
    rows = {r["row_id"]: r for r in out.df.collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["frac_water"], rows[1]["frac_water_missing"], rows[3]["family_nan"]) == (0.0, 1.0, 1.0)
    again = encode.build_features(df.where("row_id = 1"), ["temp_c"], ["frac_water"], ["acid_flag"], [],
                                  domains=out.domains)
    assert again.x_cols == out.x_cols
    wide, names = encode.pairwise_design(out.df, ["temp_c", "frac_water", "acid_flag"])
    assert len(names) == 6 and names[3] == "temp_c*frac_water"


def test_ratio_and_quantiles(spark):
    df = spark.createDataFrame([(32.0, 60.0), (1.0, 0.0), (None, 5.0)], "o double, c double")
    got = [r[0] for r in df.select(exprs.atomic_ratio("o", "c", "o", "c")).collect()]
    assert got[0] == pytest.approx((32 / 15.999) / (60 / 12.011)) and got[1:] == [None, None]
    t = spark.range(1).select(exprs.student_quantile(0.975, F.lit(10)), exprs.student_quantile(0.975, F.lit(200)))
    assert list(t.collect()[0]) == pytest.approx([2.2281, 1.9719], abs=2e-3)
    few = spark.range(1).select(*[exprs.student_quantile(0.975, F.lit(n)) for n in (1, 2, 5, 30, 31)])
    assert list(few.collect()[0]) == pytest.approx([12.7062, 4.3027, 2.5706, 2.0423, 2.0395], abs=2e-4)
    assert math.isclose(exprs.z_value(0.975), 1.959964, abs_tol=1e-6)
