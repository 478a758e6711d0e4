import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.plans import fold_table, linear
from uqframe.sources.session import new_path


@pytest.fixture(scope="module")
def rows(spark):
    """Repeated keys and targets with holes."""
    x, fold = F.col("id") % 13, (F.col("id") % 3).cast("int")
    return spark.range(60).select(
        (F.col("id") % 50).cast("string").alias("row_id"), x.cast("double").alias("x"), fold.alias("fold"),
        (x * 2 + F.col("id") % 2).cast("double").alias("u"), F.when(F.col("id") % 4 > 0, 1.0 * x).alias("v"))


def test_a_row_is_stored_once_for_all_targets(spark, rows):
    folder = new_path(spark, "folds")
    wide = linear.linear_pairs(rows, ["u", "v"], ["x"], False)
    fold_table.write_folds(wide, folder, ["u", "v"], "lr")
    fold_table.write_folds(wide.where("fold < 1"), folder, ["u", "v"], "lr")
    assert spark.read.parquet(folder).count() == 60
    back = fold_table.read_folds(spark, folder, fold_table.table_schema(rows, ["row_id"]))
    assert back.columns == ["row_id", "y", "p", "target", "model", "fold"]
    columns = ["row_id", "target", "model", "fold", "y", "p"]
    got = sorted(map(tuple, back.select(columns).collect()))
    assert got == sorted(map(tuple, linear.linear_out_of_fold(rows, ["u", "v"], ["x"], False).select(columns).collect()))
    assert len(got) == rows.agg(F.count("u") + F.count("v")).first()[0]
    train = rows.where("fold <> 1 and v is not null").toPandas()
    line = np.polyfit(train["x"], train["v"], 1)
    for r in back.where("target = 'v' and fold = 1").collect():
        assert r["p"] == pytest.approx(r["y"], abs=1e-9) and line[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):  # it would be read twice
        fold_table.write_folds(linear.linear_pairs(rows, ["u"], ["x"], False), folder, ["u"], "lr")


def test_more_targets_than_a_folder_name_holds(spark, rows):
    names = [f"t{i}" for i in range(fold_table.MOST + 2)]
    df = rows.select("row_id", "x", "fold", *[(F.col("u") + i).alias(n) for i, n in enumerate(names)])
    folder = new_path(spark, "folds")
    fold_table.write_folds(linear.linear_pairs(df, names, ["x"], False), folder, names, "lr")
    back = fold_table.read_folds(spark, folder, fold_table.table_schema(df, ["row_id"]))
    found = {r["target"]: (r["n"], r["least"]) for r in back.groupBy("target").agg(
        F.count("*").alias("n"), F.min("y").alias("least")).collect()}
    assert found == {n: (60, float(i)) for i, n in enumerate(names)}


def test_fold_rows_hold_what_is_used(spark):
    from uqframe.catalogue import models

    df, targets = models.fold_rows(spark, "/root/testdata/sf0.001")
    assert set(df.columns) == {"row_id", "fold", *models.LINEAR, *targets}
