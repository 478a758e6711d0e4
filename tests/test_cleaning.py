import math

import pytest
from pyspark.sql import functions as F

from uqframe.functions.exprs import norm_text, normalize_id, to_number
from uqframe.operators import cleaning, columns


def test_ids(spark):
    rows = [(" HTTPS://doi.org/10.1/A ",), ("http://dx.doi.org/10.1/b",), ("DOI: 10.1/c",),
            ("doi:doi:x",), ("https://dx.doi.org/10.1/d",), (None,), ("10.1/e",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(normalize_id("s"), normalize_id("s", strict=True)).collect()]
    assert [a for a, _ in got] == ["10.1/a", "10.1/b", " 10.1/c", "doi:x",
                                   "https://dx.doi.org/10.1/d", None, "10.1/e"]
    assert got[2][1] == "10.1/c" and got[4][1] == "10.1/d"


def test_basis(spark):
    rows = [("daf", 0.0, None, 50.0), ("daf", 20.0, None, 50.0), ("daf", 100.0, None, 50.0),
            ("daf", 120.0, None, 50.0), ("daf", -5.0, None, 50.0), ("daf", None, 10.0, 50.0),
            ("daf", None, None, 50.0), ("dry_basis", 20.0, None, 50.0), (None, 20.0, None, 50.0)]
    df = spark.createDataFrame(rows, "basis_class string, ash double, ash_imputed double, b_y double")
    df = df.withColumn("yield_fill_method", F.lit(None).cast("string")).withColumn("basis_daf", F.lit(1.0))
    out = cleaning.basis_to_dry(df).collect()
    assert [r["b_y"] for r in out] == pytest.approx([50, 40, 50, 50, 50, 45, 50, 50, 50])
    assert [r["basis_class"] for r in out] == ["dry_basis", "dry_basis", "daf", "daf", "daf",
                                               "dry_basis", "daf", "dry_basis", None]
    assert out[1]["yield_fill_method"] == ";daf_to_dry" and out[2]["yield_fill_method"] is None
    assert out[1]["basis_daf"] == 0.0 and out[2]["basis_daf"] == 1.0


def test_numbers_and_text(spark):
    rows = [("1.5",), (" 2 ",), ("abc",), ("nan",), ("inf",), ("-Infinity",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(to_number("s")).collect()] == [1.5, 2.0, None, None, None, None, None]
    text = spark.createDataFrame([(" Ab ",), (None,)], "s string")
    assert [r[0] for r in text.select(norm_text("s")).collect()] == ["ab", ""]


def test_clipping_keeps_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(101), math.inf, math.nan]], "v double")
    kept = sorted(r["value"] for r in cleaning.clipped_values(df, ["v"], (0.05, 0.95)).collect())
    assert kept == [float(v) for v in range(5, 96)]
    one = spark.createDataFrame([(3.0,)], "v double")
    assert cleaning.clipped_values(one, ["v"], (0.05, 0.95)).count() == 1


def test_json(spark):
    df = spark.createDataFrame([('{"k": 1.5}',), ("not json",), (None,), ("{}",)], "j string")
    got = [r[0] for r in df.select(cleaning.read_json("j", "k double")["k"]).collect()]
    assert got == [1.5, None, None, None]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    assert columns.select_present(df, ["b", "a", "b", "z"]).columns == ["b", "a"]
    assert columns.align_features(df, ["z", "a"]).collect()[0].asDict() == {"z": 0.0, "a": 1.0}
    assert columns.ensure_columns(df, ["q"]).columns == ["a", "b", "c", "q"]
    filled = columns.fallback_column(df.withColumn("d", F.lit(2.0)), "c", "d")
    assert filled.collect()[0]["c"] == 2.0
    half = spark.createDataFrame([(None, 1.0), (5.0, 2.0)], "c double, d double")
    assert [r["c"] for r in columns.fallback_column(half, "c", "d").collect()] == [None, 5.0]
    with pytest.raises(ValueError):
        columns.check_targets(["a"], 2)


def test_process_labels(spark):
    rows = [("HTL", "b"), (None, "Slow"), ("nan", "B2"), ("", "B3"), (None, None)]
    df = spark.createDataFrame(rows, "process_type_a string, process_type_b string")
    got = [tuple(r) for r in df.select(columns.process_label(), columns.process_tag()).collect()]
    assert got == [("HTL", "htl"), ("Slow", "slow"), ("nan", "b2"), ("", ""), (None, None)]
