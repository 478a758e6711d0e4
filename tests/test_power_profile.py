import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uqframe.functions.exprs import yeo_johnson
from uqframe.operators import encode


def test_profile_of_both_signs(spark):
    """Values of both signs, a null, a NaN and an infinity, over several tasks."""
    df = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") == 7, None).when(F.col("id") == 8, F.lit(math.nan)).when(
        F.col("id") == 9, F.lit(math.inf)).otherwise((F.col("id") * 7919 % 5003) / 400 - 4).alias("v"))
    lams = [-3.0, 0.0, 0.5, 1.0, 2.0, 4.5]
    got = {r["lam"]: (r["n"], r["loglik"]) for r in encode.power_profile(df, "v", lams).collect()}
    kept = df.where("v is not null and not isnan(v) and v < 1e9")
    jac = kept.select(F.sum(F.signum("v") * F.log1p(F.abs("v")))).first()[0]
    for lam in lams:
        v = kept.select(F.var_pop(yeo_johnson("v", lam))).first()[0]
        assert got[lam][0] == 4997
        assert got[lam][1] == pytest.approx(-0.5 * 4997 * math.log(v) + (lam - 1) * jac, rel=1e-10)


def test_constant_and_missing_values(spark):
    flat = spark.range(0, 1000, 1, 4).select(F.lit(0.1).alias("v"))
    assert {r["loglik"] for r in encode.power_profile(flat, "v", [0.3, 1.0]).collect()} == {None}
    assert encode.fit_power(flat, "v") == 1.0
    assert encode.fit_power(flat.select(F.lit(None).cast("double").alias("v")), "v") == 1.0


def test_a_logarithm_serves_all_powers(monkeypatch):
    calls, log1p = [], np.log1p
    batch = pa.RecordBatch.from_arrays([pa.array(np.linspace(-5, 80, 40_000))], names=["value"])
    monkeypatch.setattr(np, "log1p", lambda x: calls.append(len(x)) or log1p(x))
    rows = list(encode._power_sums(np.linspace(-4, 6, 21))(iter([batch])))
    assert sum(calls) == 40_000 and rows[0].num_rows == 21
