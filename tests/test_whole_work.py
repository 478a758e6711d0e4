"""Queries do the whole job that they name."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.catalogue import models
from uqframe.constants import BOOSTED_DEFAULTS, FOREST_DEFAULTS, TARGETS
from uqframe.plans import linear, training

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rows(spark):
    a, b = (F.col("id") % 13).cast("double"), (F.col("id") % 7).cast("double")
    return spark.range(300).coalesce(1).select(a.alias("a"), b.alias("b"), (a * 3 + b * b).alias("y"))


def test_all_targets_and_labels_are_trained(spark, monkeypatch):
    """the frame held 7 of the 16 targets that the experiments have, and no subtype."""
    class Seen(Exception):
        pass

    def train(df, targets, features, **more):
        raise Seen(df, targets, features)

    monkeypatch.setattr(training, "train_targets", train)
    with pytest.raises(Seen) as seen:
        models.all_targets(spark, SF)
    df, targets, features = seen.value.args
    there = models.fold_rows(spark, SF)[1]
    assert targets == TARGETS and [t for t in targets if t in df.columns] == there and len(there) == 16
    n = df.agg(*[F.count(t).alias(t) for t in there]).first().asDict()
    brands = spark.read.parquet(f"{SF}/lineitem.parquet").join(
        spark.read.parquet(f"{SF}/part.parquet"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand").distinct()
    assert min(n.values()) > 0
    assert {f"subtype_{r[0]}" for r in brands.collect()} <= set(features)


def test_linear_sums_have_all_terms(spark):
    """F8: the products of pairs, one of the four features and the group folds were missing."""
    got = models.linear_sums(spark, SF).collect()
    per = {}
    for r in got:
        per.setdefault((r["target"], r["fold"]), {})[r["i"], r["j"]] = r["mean"]
    assert len(per) == 16 * 5 and all(len(v) == 12 * 13 // 2 for v in per.values())
    assert all(v[1, 2] == pytest.approx(v[0, 5], abs=0.01) for v in per.values())  # temp_c * t_min is a term


def test_sums_over_a_fold_per_target(spark):
    rows = spark.range(200).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        (F.col("id") % 11).cast("double").alias("u"), F.when(F.col("id") % 4 > 0, 1.0 * F.col("id")).alias("v"),
        F.array((F.col("id") % 3).cast("int"), F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int"))).alias("folds"))
    got = {tuple(r)[:4]: r["total"] for r in linear.fold_sums(rows, ["u", "v"], ["a", "b"]).collect()}
    data, want = rows.toPandas(), {}
    for at, t in enumerate("uv"):
        fold = np.array([-1 if f[at] is None else f[at] for f in data["folds"]])
        for k in range(3):
            own = data[(fold == k) & data[t].notna()]
            z = np.column_stack([np.ones(len(own)), own["a"], own["b"], own["a"] * own["b"], own[t]])
            if len(own):
                want |= {(t, k, i, j): (z[:, i] * z[:, j]).sum() for i in range(5) for j in range(i, 5)}
    assert got == want


def test_modes_share_their_trees(rows, monkeypatch):
    fits = []
    for kind in (training.RandomForestRegressor, training.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, df, f=kind.fit: (fits.append(type(self).__name__), f(self, df))[1])
    small = {"numTrees": 3, "maxIter": 2, "maxDepth": 3}
    fitted, alone = None, {}
    for mode in ("rf", "rf_qr", "rf_cal", "xgb", "xgb_cal"):
        fitted = training.fit_model(rows, "y", ["a", "b"], mode, small, like=fitted)
        assert fitted.mode == mode
        alone[mode] = fitted
    assert fits == ["RandomForestRegressor", "GBTRegressor"]
    for mode in ("rf_cal", "xgb_cal"):
        want = training.fit_model(rows, "y", ["a", "b"], mode, small)
        assert (want.slope, want.shift) == (alone[mode].slope, alone[mode].shift) != (1.0, 0.0)
    assert (alone["rf"].slope, alone["xgb"].slope) == (1.0, 1.0)
    other = training.fit_model(rows, "y", ["a", "b"], "rf", {**small, "numTrees": 2}, like=alone["rf"])
    assert other.model.getNumTrees == 2  # other parameters, other trees


def test_modes_are_those_of_the_library(spark, monkeypatch):
    """forests had 8 of 800 trees and boosting 5 of 600 rounds."""
    asked = []

    def make(mode, params=None, before=training.make_estimator):
        est = before(mode, params)
        asked.append((mode, {p.name: v for p, v in est.extractParamMap().items()}))
        return est.setParams(**training.allowed({"numTrees": 2, "maxIter": 2, "maxDepth": 2}, est))

    monkeypatch.setattr(training, "make_estimator", make)
    got = {r["mode"] for r in models.modes(spark, SF).collect()}
    assert got == {"rf", "rf_qr", "rf_cal", "xgb", "xgb_cal"} == {m for m, _ in asked}
    for mode, values in asked:
        wanted = FOREST_DEFAULTS if mode in training.FOREST_MODES else BOOSTED_DEFAULTS
        assert {k: values[k] for k in wanted} == wanted
