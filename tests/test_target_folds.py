"""Folds of all targets at once, and sparse vectors."""

import re

import pytest
from pyspark.sql import functions as F

from uqframe.operators import splits
from uqframe.plans import training
from uqframe.sources import session


@pytest.fixture(scope="module")
def rows(spark):
    """Uneven groups, one without a name, targets with holes."""
    group = F.when(F.col("id") % 11 > 0, F.concat(F.lit("p."), F.sqrt("id").cast("int")))
    return spark.range(400).select(
        F.col("id").cast("string").alias("row_id"), group.alias("doi"), (F.col("id") % 13).cast("double").alias("a.b"),
        F.when(F.col("id") % 7 == 0, 1.0 * F.col("id")).otherwise(0.0).alias("b"), F.lit(0.0).alias("c"),
        F.lit(0.0).alias("d"), F.lit(0.0).alias("e"), (F.col("id") % 5).cast("double").alias("y"),
        F.when(F.col("id") > 150, 2.0).alias("late"), F.when(F.col("id") < 3, 1.0).alias("few"))


def test_folds_of_each_target_are_group_folds(rows):
    names = ["y", "late", "few", "also_y"]
    df = rows.withColumn("also_y", F.col("y") + 1)
    each = splits.group_folds_each(df, [F.col(c).isNotNull() for c in names], "doi", 4)
    assert each.rows == [400, 249, 3, 400] and each.alike == [0, 1, 2, 0] and each.k == [4, 4, 0, 4]
    assert each.groups[0] == 19 and each.groups[2] == 1
    got = each.df.collect()
    assert len(got) == 400 and all(r["folds"][2] is None and r["folds"][0] == r["folds"][3] for r in got)
    for i, c in enumerate(names[:2]):
        want = {r["row_id"]: r["fold"] for r in splits.group_folds(df.where(F.col(c).isNotNull()), "doi", 4).collect()}
        assert {r["row_id"]: r["folds"][i] for r in got if r[c] is not None} == want


def test_sparse_vectors_hold_what_dense_ones_do(rows):
    x = ["a.b", "b", "c", "d", "e"]
    df = rows.withColumns({"b": F.when(F.col("row_id") == "5", float("nan")).otherwise(F.col("b")),
                           "c": F.when(F.col("row_id") != "6", F.col("c"))})
    dense, sparse = (training.packed(df, x, ["row_id", "y"], sparse=s) for s in (False, True))
    assert dense.columns == sparse.columns and training.holds(sparse, x, "rf")
    want, got = ({r["row_id"]: (r["whole"], r["features"]) for r in f.collect()} for f in (dense, sparse))
    assert sum(type(v).__name__ == "SparseVector" for _, v in got.values()) > 300
    assert {k: (w, str(v.toArray())) for k, (w, v) in got.items()} == {k: (w, str(v.toArray())) for k, (w, v) in want.items()}
    assert [k for k, (w, _) in sorted(got.items()) if not w] == ["5", "6"]


def test_rows_of_a_target_are_deleted_after_its_fits(rows, monkeypatch):
    groups, made = [], []
    monkeypatch.setattr(splits, "ranked", lambda df, *o, f=splits.ranked: (groups.append(1), f(df, *o))[1])
    monkeypatch.setattr(training, "cut_lineage", lambda df, label, f=session.cut_lineage: (
        made.append((label, f(df, label))), made[-1][1])[1])
    df = rows.withColumns({f"y{i}": F.col("y") + i for i in range(3)}).withColumnRenamed("a.b", "a")
    run = training.train_targets(df, ["y0", "y1", "y2"], ["a", "b"], k=3, forest={"numTrees": 2, "maxDepth": 2},
                                 tree={"maxDepth": 2}, final_fit=False, group="doi")
    assert len(groups) == 1  # one placement for targets with the same rows
    assert [label for label, _ in made].count("target") == 3
    left = {p.rsplit("/", 1)[1] for p in session._MADE}
    for label, frame in made:
        assert (frame.inputFiles()[0].rsplit("/", 2)[1] in left) == (label != "target")
    assert {(r["target"], r["n"]) for r in run.results.collect()} == {("y0", 400), ("y1", 400), ("y2", 400)}


def test_few_groups_go_to_the_rows(spark, rows, monkeypatch):
    """the rows with all of their columns were shuffled to the folds of their groups."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most, kind in ((splits.MAX_LIST_GROUPS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(splits, "MAX_LIST_GROUPS", most)
            one = splits.group_folds(rows, "doi", 4)
            each = splits.group_folds_each(rows, [F.col("late").isNotNull()], "doi", 4).df
            for df in (one, each):
                plan = df._jdf.queryExecution().sparkPlan().toString()
                assert re.search("BroadcastHashJoin|SortMergeJoin", plan).group() == kind  # the uppermost join
            found.append([sorted((r["row_id"], str(r[c])) for r in df.collect()) for df, c in ((one, "fold"), (each, "folds"))])
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
