import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.operators import metrics, splits
from uqframe.operators.quantiles import quantile_columns
from uqframe.operators.skew import attach, copied, heavy_keys, with_facts


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds half of the rows, and one key is null."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 9 == 1, None).otherwise(
        (F.col("id") % 50).cast("string"))
    return spark.range(20000).repartition(7).select(
        "id", key.alias("k"), (F.col("id") % 977).cast("double").alias("v"))


@pytest.mark.parametrize("options", [{}, {"salted": False}, {"bounded": True}, {"salt_by": ["id"]}])
def test_attach_keeps_all_rows(spark, hot, options):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts = hot.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
        out = attach(hot, facts, ["k"], **options)
        assert out.columns == ["id", "k", "v", "total", "n"]
        got = out.groupBy("k").agg(F.count("*").alias("rows"), F.max("n").alias("n")).collect()
        assert all(r["rows"] == r["n"] for r in got) and sum(r["rows"] for r in got) == 20000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_is_spread(spark, hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        facts = hot.groupBy("k").agg(F.count("*").alias("n"))
        out = attach(hot, facts, ["k"], salt_by=["id"]).where("k = 'hot'")
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()
        assert len(parts) > 1 and max(r["c"] for r in parts) < 10000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_heavy_keys_are_copied(spark, hot):
    """A key of a third of the rows is cut by its share; without one no row is copied."""
    facts = hot.groupBy("k").agg(F.count("*").alias("n"))
    third = spark.range(30000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    counts = third.groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, ["k"], "n")
    assert [(r["k"], r["_parts"]) for r in heavy.collect()] == [(-1, 3)]
    assert copied(counts, heavy, ["k"]).count() == 20001 + 2
    assert heavy_keys(counts, ["k"], "n", share=1.0).count() == 0
    even = spark.range(30000).select((F.col("id") % 500).alias("k"))
    sizes = even.groupBy("k").agg(F.count("*").alias("n"))
    assert copied(sizes, heavy_keys(sizes, ["k"], "n"), ["k"]).count() == 500
    for rows in (third, even):
        small = rows.groupBy("k").agg(F.count("*").alias("n"))
        out = attach(rows.repartition(5), small, ["k"], "inner")
        assert out.count() == 30000 and out.where("n is null").count() == 0
    assert attach(hot.where("k is null"), facts, ["k"]).where("n is null").count() == 0


def test_quantiles_and_folds_of_a_hot_key(hot):
    got = {r["k"]: r["m"] for r in quantile_columns(hot, ["v"], {"m": 0.37}, ["k"]).collect()}
    values = [float(i % 977) for i in range(0, 20000, 2)]
    assert got["hot"] == pytest.approx(np.quantile(values, 0.37))
    folds = splits.group_folds(hot, "k", 4)
    sizes = {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert 10000 <= max(sizes.values()) < 12500 and sum(sizes.values()) == 20000


def test_facts_and_shape(hot):
    facts = hot.agg(F.avg("v").alias("mean"), F.count("*").alias("rows"))
    out = with_facts(hot, facts)
    assert out.where("rows <> 20000").count() == 0 and out.columns == ["id", "k", "v", "mean", "rows"]
    shape = {r["column"]: (r["n_rows"], r["n_distinct"]) for r in metrics.shape(hot, ["k", "v"]).collect()}
    assert shape["v"] == (20000, 977) and shape["k"][0] == 20000
