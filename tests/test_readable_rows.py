import math

from pyspark.sql import functions as F

from uqframe.operators.columns import rows_for_target


def test_reading_again_changes_nothing(spark):
    values = [("a", 1.0, "2.5"), ("b", None, "x"), ("c", math.nan, None), ("d", math.inf, "inf"), ("e", -math.inf, "3"),
              ("e", 2.0, "3")]
    df = spark.createDataFrame(values, "k string, v double, t string")
    plans = {}
    for column, want in (("v", [1.0, 2.0]), ("t", [2.5, 3.0, 3.0])):
        rows = df
        for times in range(5):
            rows = rows_for_target(rows, column, ["k"])
            plans[column, times] = len(rows.where(F.col(column) < 9)._jdf.queryExecution().optimizedPlan().toString())
        assert sorted(r[column] for r in rows.collect()) == want
    # the conditions of every reading were nested in those of the one before
    assert plans["v", 4] < 2 * plans["v", 0] and plans["t", 4] < 4 * plans["t", 0]
