"""Frames that hold their features as one vector give what their columns give."""

import math

import pytest
from pyspark.sql import functions as F

from uqframe.operators.splits import row_folds
from uqframe.plans import scoring, training
from uqframe.plans.estimator import CalibratedRegressor

X = ["a", "b"]
FOREST = {"numTrees": 3, "maxDepth": 4, "seed": 1}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"r{i}", float(i % 17), float(i % 5), 2.0 * (i % 17) + i % 5) for i in range(300)]
    data += [("r-null", None, 1.0, 3.0), ("r-nan", float("nan"), 1.0, 4.0), ("r-no-target", 3.0, 1.0, None)]
    return spark.createDataFrame(data, "row_id string, a double, b double, b_y double").coalesce(1)


def test_packed_rows_fit_and_score_like_columns(rows):
    vector = training.packed(rows, X, ["row_id", "b_y"])
    assert vector.columns == ["row_id", "b_y", "features", "whole"]
    assert training.usable_rows(vector, "b_y", X, "rf").count() == 300
    plain, own = (training.fit_model(df, "b_y", X, "rf_cal", FOREST) for df in (rows, vector))
    assert (own.slope, own.shift) == (plain.slope, plain.shift)
    both = own.score(own.score(vector, "p"), "q")  # the vector stays for the next model
    want = {r["row_id"]: r["p"] for r in plain.score(rows, "p").collect()}
    got = both.collect()
    assert {r["row_id"]: r["p"] for r in got} == want and all(r["p"] == r["q"] for r in got)
    assert len(got) == 303 and not any(math.isnan(r["p"]) for r in got)


def test_permutation_over_packed_rows(rows):
    vector = training.packed(rows, X, ["row_id", "b_y"])
    fitted = training.fit_model(rows, "b_y", X, "rf", FOREST)
    want, got = (sorted(map(tuple, scoring.permutation_importance(df, fitted, "b_y", X).collect()))
                 for df in (rows, vector))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]])


def test_permutation_moves_no_other_columns(rows):
    fitted = training.fit_model(rows, "b_y", X, "rf", FOREST)
    wide = rows.withColumn("remark", F.repeat("row_id", 50))
    plan = scoring.permutation_importance(wide, fitted, "b_y", X)._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat" not in plan


def test_search_fits_each_candidate_once_per_fold(rows, monkeypatch):
    fits = []
    before = CalibratedRegressor._fit
    monkeypatch.setattr(CalibratedRegressor, "_fit", lambda self, df: (fits.append(df), before(self, df))[1])
    draws = [{"maxDepth": 1}, {"maxDepth": 4}]
    best, table = training.search(row_folds(rows, 2), "b_y", X, FOREST, draws, k=2)
    assert len(fits) == 4 and best["maxDepth"] == 4
    assert all("PythonUDF" not in df._jdf.queryExecution().optimizedPlan().toString() for df in fits)
    packed = training.packed(row_folds(rows, 2), X, ["b_y", "fold"])
    again = training.search(packed, "b_y", X, FOREST, draws, k=2)[1]
    assert [r["r2"] for r in again.collect()] == pytest.approx([r["r2"] for r in table.collect()])


def test_search_refuses_an_empty_fold(rows):
    with pytest.raises(ValueError):
        training.search(rows.withColumn("fold", F.lit(0)), "b_y", X, FOREST, [{}], k=2)


def test_physics_evaluation_scores_once(rows):
    fitted = training.fit_model(rows, "b_y", X, "rf", FOREST)
    plan = scoring.physics_scoring(rows, {"b_y": fitted}, ["b_y"])[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan
