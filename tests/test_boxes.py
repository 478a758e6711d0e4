"""Box statistics and grouped quantiles read a table written once, and few keys move no rows."""

import pytest
from pyspark.sql import functions as F

from uqframe.operators import metrics, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"r{i}", float(i % 17), float(i % 5)) for i in range(300)]
    data += [("r-null", None, 1.0), ("r-nan", float("nan"), 1.0), ("r-last", 3.0, 1.0)]
    return spark.createDataFrame(data, "row_id string, a double, b double")


def test_quantiles_of_few_keys_move_no_rows(spark):
    df = spark.createDataFrame([(f"k{i % 3}" if i % 4 else None, float(i)) for i in range(60)], "k string, v double")
    out = quantiles.quantile_columns(df, ["v"], {"m": 0.5}, ["k"])
    want = {}
    for i in range(60):
        want.setdefault(f"k{i % 3}" if i % 4 else None, []).append(float(i))
    got = {r["k"]: (r["n"], r["m"]) for r in out.collect()}
    assert got == {k: (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2) for k, v in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "spark_partition_id" not in plan.lower()


def test_boxes_read_a_table_written_once(rows):
    wide = rows.withColumn("remark", F.repeat("row_id", 50)).where("length(remark) > 0")
    boxes = metrics.box_stats(wide, ["a", "b"])
    assert "repeat" not in boxes._jdf.queryExecution().optimizedPlan().toString()
    assert {r["variable"]: r["n"] for r in boxes.collect()} == {"a": 301, "b": 303}
