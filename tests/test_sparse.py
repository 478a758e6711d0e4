import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from uqframe.operators import sparse


def test_entries_and_vectors(spark):
    rows = [(1, 2.0, "b", "x"), (2, None, None, "y"), (3, float("nan"), "a", None), (4, 0.0, "", "x")]
    df = spark.createDataFrame(rows, "row_id long, t double, family string, label string")
    out, slots = sparse.sparse_features(df, ["t"], ["label", "family"])
    assert [tuple(r) for r in slots.orderBy("slot").collect()] == [
        ("family", "", 1), ("family", "a", 2), ("family", "b", 3), ("family", None, 4),
        ("label", "x", 5), ("label", "y", 6), ("label", None, 7)]
    got = {r.row_id: r.features for r in out.collect()}
    assert got[1].toArray().tolist() == [2, 0, 0, 1, 0, 1, 0, 0]
    assert got[2].toArray().tolist() == [0, 0, 0, 0, 1, 0, 1, 0]
    assert got[3].toArray().tolist() == [0, 0, 1, 0, 0, 0, 0, 1]
    assert got[4].indices.tolist() == [1, 5]
    assert out.columns == ["row_id", "t", "family", "label", "features"]


def test_scoring_with_known_slots(spark):
    kind = "row_id long, t double, family string"
    train = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "b")], kind)
    _, slots = sparse.sparse_features(train, ["t"], ["family"])
    new = spark.createDataFrame([(3, 5.0, "never seen"), (4, 6.0, "b")], kind)
    out, same = sparse.sparse_features(new, ["t"], ["family"], slots)
    got = {r.row_id: r.features for r in out.collect()}
    assert same is slots and got[3].size == got[4].size == 4
    assert got[3].indices.tolist() == [0] and got[4].indices.tolist() == [0, 2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "t double, family string")
    out, slots = sparse.sparse_features(df, ["t"], ["family"])
    assert out.count() == 0 and [tuple(r) for r in slots.collect()] == [("family", None, 1)]


def test_many_labels_train(spark):
    """100,000 labels, a third of the rows under one of them, are built and trained on."""
    n = 150_000
    df = spark.range(n).select(
        (F.col("id") % 7).cast("double").alias("t"),
        F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("l"), "id")).alias("label"))
    df = df.withColumn("y", 3 * F.col("t") + F.when(F.col("label") == "hot", 10).otherwise(0))
    out, slots = sparse.sparse_features(df, ["t"], ["label"])
    assert slots.count() == 100_002
    entries = out.select("features").limit(5).collect()
    assert all(r.features.size == 100_003 and len(r.features.indices) <= 2 for r in entries)
    model = LinearRegression(labelCol="y", maxIter=20, regParam=1e-3, solver="l-bfgs",
                             standardization=False).fit(out)
    hot = slots.where("label = 'hot'").first().slot
    assert model.coefficients.size == 100_003
    assert model.coefficients[0] == pytest.approx(3, abs=0.1)
    others = np.delete(model.coefficients.toArray(), [0, hot])
    assert model.coefficients[hot] - np.median(others) == pytest.approx(10, abs=1)
