import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from uqframe.operators import intervals, splits
from uqframe.operators.encode import TargetTransform
from uqframe.plans import fold_table, linear, scoring, training
from uqframe.sources.session import cut_lineage, new_path

X = ["a", "b"]
FOREST = {"numTrees": 6, "maxDepth": 4, "minInstancesPerNode": 2}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 20).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 9).cast("string").alias("doi"),
        F.lit(300.0).alias("temp_c"))
    df = df.withColumns({"b_y": F.col("a") * 3 + F.col("b"), "hhv_biooil": 15 + F.col("a") / 3,
                         "c_biooil": 50 + F.col("a"), "a_y": F.when(F.col("a") < 1, 1.0)})
    return cut_lineage(df)


def test_cross_validation(spark, rows):
    df = splits.row_folds(rows, 3)
    run = training.train_targets(df, ["b_y", "c_biooil", "a_y", "gone"], X, k=3, forest=FOREST, tree={"maxDepth": 5})
    got = {r["target"]: r for r in run.results.collect()}
    assert got["b_y"]["n"] == 400 and got["b_y"]["r2_lr"] > 0.99 and got["c_biooil"]["r2_rf"] > 0.8
    assert got["a_y"]["n"] == 20 and got["a_y"]["r2_rf"] is None and got["gone"]["n"] == 0
    assert run.oof.where("model = 'dt' and target = 'b_y'").count() == 400
    folder = new_path(spark, "models")
    training.save_models(spark, run.models, folder)
    back = training.load_models(spark, folder, ["b_y", "c_biooil", "gone"])
    assert set(back) == {"b_y", "c_biooil"} and back["c_biooil"].transform.kind == "percent"
    scored = scoring.predict_targets(rows, {**back}, ["b_y", "gone"])
    first = run.models["b_y"]["rf"].score(rows, "p").join(scored, "row_id")
    assert first.where(F.abs(F.col("p") - F.col("p_b_y")) > 1e-9).count() == 0
    assert scored.where("p_gone is not null").count() == 0
    ranked = training.importances(spark, {"b_y": run.models["b_y"]}).orderBy("rank").collect()
    assert ranked[0]["feature"] == "a" and ranked[0]["importance"] > 0.5


def test_assembled_features_fit_as_their_columns(rows):
    """The vector that is made once gives the models of the columns, on the rows that have all of them."""
    df = rows.withColumns({"a": F.when(F.col("a") > 2, F.col("a")), "b": F.when(F.col("b") == 6, float("nan")).otherwise(F.col("b"))})
    once = cut_lineage(training.assembled(df, X).drop(*X))
    assert once.where("features is not null").count() == df.dropna(subset=X).count() < 400
    for mode, params in (("dt", {"maxDepth": 4}), ("rf_cal", FOREST)):
        whole = training.fit_model(df, "b_y", X, mode, params)
        fitted = training.fit_model(once, "b_y", X, mode, params)
        assert fitted.model.numFeatures == 2
        scores = [[r["p"] for r in f.score(frame, "p").orderBy("row_id").select("p").collect()]
                  for f, frame in ((whole, df.dropna(subset=X)), (fitted, once.where("features is not null")))]
        assert len(set(scores[1])) > 5
        if mode == "dt":
            assert scores[0] == pytest.approx(scores[1])
    assert not training.holds(once, ["b", "a"], "dt") and not training.holds(once, X, "lr")


def test_training_frame_holds_the_vector_only(rows, monkeypatch):
    seen = {}

    def cut(df, label="cut"):
        seen.setdefault(label, df.columns)
        return cut_lineage(df, label)

    monkeypatch.setattr(training, "cut_lineage", cut)
    run = training.train_targets(rows, ["b_y", "c_biooil"], X, k=3, forest=FOREST,
                                 tree={"maxDepth": 4}, linear_features=["a"], group="doi", final_fit=False)
    assert {r["n"] for r in run.results.collect()} == {400}
    assert "features" in seen["training"] and "b" not in seen["training"]
    assert len({"b_y", "c_biooil"} & set(seen["target"])) == 1


def test_group_residuals(rows):
    df = splits.group_folds(rows, "doi", 3)
    oof = training.out_of_fold(df, "b_y", X, 3, params=FOREST, keep=["row_id", "doi"])
    assert oof.groupBy("doi").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert oof.count() == 400


@pytest.mark.parametrize("way", ["literal", "broadcast", "join"])
def test_tree_intervals(spark, rows, monkeypatch, way):
    fitted = training.fit_model(rows, "c_biooil", X, "rf_cal", FOREST)
    folder = new_path(spark, "models")
    training.save_models(spark, {"c_biooil": {"rf": fitted}}, folder)
    if way != "literal":
        monkeypatch.setattr(intervals, "MAX_LITERAL_NODES", 0)
    if way == "join":
        monkeypatch.setattr(intervals, "MAX_BROADCAST_NODES", 0)
    frame = training.with_vector(rows, X, "rf")
    path = training.model_path(folder, "c_biooil", "rf")
    out = intervals.ensemble_interval(frame, fitted.model, path, 0.2, fitted.transform, (fitted.slope, fitted.shift))
    got = out.select("a", "b", "features", "lo", "hi").limit(30).collect()
    for r in got:
        z = np.array([t.predict(r["features"]) for t in fitted.model.trees])
        trees = fitted.slope * 100 * np.clip(1 / (1 + np.exp(-z)), 1e-3, 1 - 1e-3) + fitted.shift
        assert (r["lo"], r["hi"]) == pytest.approx((np.quantile(trees, 0.1), np.quantile(trees, 0.9)))
    none = intervals.without_interval(rows).where("lo is not null or hi is not null")
    assert none.count() == 0


def test_modes_and_calibration(rows):
    for mode, params in (("rf", FOREST), ("rf_cal", FOREST), ("xgb", {"maxIter": 3, "maxDepth": 3})):
        fitted = training.fit_model(rows, "hhv_biooil", X, mode, params)
        assert fitted.transform.kind == "power"
        p = [r["p"] for r in fitted.score(rows, "p").select("p").collect()]
        assert 14 < min(p) and max(p) < 24
    with pytest.raises(ValueError):
        training.make_estimator("ngb")
    identity = training.fit_model(rows, "b_y", X, "lr", transform=TargetTransform("identity"))
    assert training.calibration_line(identity.score(rows, "p"), "b_y", "p") == pytest.approx((1, 0), abs=1e-6)


def test_search(rows):
    df = splits.row_folds(rows, 2)
    best, table = training.search(df, "b_y", X, FOREST, [{"maxDepth": 1}, {"maxDepth": 5}], k=2)
    assert best["maxDepth"] == 5 and table.count() == 2
    draws = training.random_candidates(draws=6)
    assert len({str(d) for d in draws}) == 6
    best, table = training.light_tuning(rows, "b_y", X, FOREST, [{}, {"maxDepth": 1}], n=100)
    assert best["maxDepth"] == 4


def test_permutation(rows):
    moved = scoring.permuted_column(rows, "a", rows_per_cell=50)
    assert moved.select("a").exceptAll(rows.select("a")).count() == 0
    changed = moved.join(rows.select("row_id", F.col("a").alias("old")), "row_id")
    assert changed.where("a <> old").count() > 300
    fitted = training.fit_model(rows, "b_y", X, "rf", FOREST)
    got = {r["feature"]: r for r in scoring.permutation_importance(rows, fitted, "b_y", X).collect()}
    assert got["a"]["rmse_rise"] > got["b"]["rmse_rise"]


def test_leaf_quantiles(spark):
    train = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, 9.0), (1, 0, 1.0), (1, 0, 3.0), (1, 0, 9.0)],
                                  "tree int, leaf int, y double")
    queries = spark.createDataFrame([("q", 0, 0), ("q", 1, 0)], "qid string, tree int, leaf int")
    got = intervals.leaf_quantiles(train, queries, {"lo": 0.4, "mid": 0.5, "hi": 0.95}).collect()[0]
    # weights: 1 -> 1/2 + 1/3, 3 -> 1/2 + 1/3, 9 -> 1/3, of 2 in all
    assert (got["lo"], got["mid"], got["hi"]) == pytest.approx((1.0, 3.0, 9.0))


def test_leaf_quantiles_do_not_depend_on_bins(spark):
    """Over 1,000 different targets, a leaf with most rows, ties, and probabilities 0 and 1."""
    r = np.random.default_rng(3)
    n, probs = 1500, {"zero": 0.0, "lo": 0.05, "mid": 0.5, "hi": 0.95, "one": 1.0}
    y = np.where(np.arange(n) % 10 == 0, 5.0, r.normal(size=n).round(6))
    leaf = np.column_stack([np.where(r.random(n) < 0.7, 0, r.integers(1, 4, n)), r.integers(0, 9, n)])
    train = spark.createDataFrame([(t, int(leaf[i, t]), float(y[i])) for i in range(n) for t in range(2)],
                                  "tree int, leaf int, y double")
    asked = [(0, 0), (1, 3), (3, 8), (0, 7)]
    queries = spark.createDataFrame([(f"q{k}", t, q[t]) for k, q in enumerate(asked) for t in range(2)],
                                    "qid string, tree int, leaf int")
    for bins in (2, 7, 100, 2000):
        got = {g["qid"]: g for g in intervals.leaf_quantiles(train, queries, probs, bins).collect()}
        for k, q in enumerate(asked):
            w = sum((leaf[:, t] == q[t]) / (leaf[:, t] == q[t]).sum() for t in range(2))
            order = np.argsort(y, kind="stable")
            order = order[w[order] > 0]
            up = np.cumsum(w[order])
            want = [y[order][np.argmax(up >= p * up[-1] - 1e-9)] for p in probs.values()]
            assert [got[f"q{k}"][name] for name in probs] == want
    assert intervals.leaf_quantiles(train, queries.limit(0), probs).count() == 0


def test_physics_scoring(rows):
    models = {t: training.fit_model(rows, t, X, "rf", FOREST) for t in ("b_y", "hhv_biooil")}
    scored, table = scoring.physics_scoring(rows, models, ["b_y", "hhv_biooil", "c_y"])
    assert scored.where(F.abs(F.col("q_b_y") - 100) > 1e-6).count() <= scored.where("p_b_y <= 0").count()
    assert {r["target"] for r in table.collect()} >= {"b_y", "hhv_biooil", "closure_raw", "closure_phys"}
    assert "b_y" in scored.columns and scored.select("b_y").exceptAll(rows.select("b_y")).count() == 0
    leaves = models["b_y"].model.copy().setLeafCol("l").transform(training.with_vector(rows, X, "rf"))
    assert leaves.select(F.size(vector_to_array("l"))).distinct().collect()[0][0] == 6


def test_predict_with_physics(rows):
    models = {t: training.fit_model(rows, t, X, "rf", FOREST) for t in ("b_y", "hhv_biooil")}
    frame = rows.drop("a_y")
    some = scoring.predict_with_physics(frame, models, ["b_y", "hhv_biooil"])
    assert "b_y_phys" not in some.columns  # not all four yields were asked for
    full = scoring.predict_with_physics(frame, models, ["b_y", "c_y", "a_y", "g_y", "hhv_biooil"])
    got = full.select("b_y", "b_y_phys", "hhv_biooil", "e_b_phys", "c_y_phys").limit(20).collect()
    for r in got:  # rows without all yields are not scaled
        assert r["b_y_phys"] == r["b_y"] and r["c_y_phys"] is None
        assert r["e_b_phys"] == pytest.approx(r["b_y"] / 100 * r["hhv_biooil"])


@pytest.mark.parametrize("pairwise", [False, True])
def test_linear_folds_equal_fits(spark, rows, pairwise):
    """Sums of all folds but one against a fit per fold by the library, and against numpy with
    terms that depend on each other."""
    df = splits.row_folds(rows, 3).withColumn("y", F.col("a") * F.col("b") / 5 + F.pmod(F.hash("row_id"), F.lit(7)))
    df = df.withColumn("weight", 1 + F.pmod(F.hash("row_id"), F.lit(3))).withColumn("hole", F.when(F.col("b") > 1, F.col("a")))
    got = linear.linear_out_of_fold(df, ["y", "hole"], X, pairwise, ["row_id"], "weight")
    assert got.where("target = 'hole'").count() == df.where("b > 1").count()
    mine = {r["row_id"]: r["p"] for r in got.where("target = 'y'").collect()}
    for i in range(3):
        train = df.where(F.col("fold") != i)
        if pairwise:
            fitted = training.fit_model(train, "y", X, "lr")
            part = fitted.score(df.where(F.col("fold") == i), "p").select("row_id", "p").collect()
            want = {r["row_id"]: r["p"] for r in part}
        else:
            pdf, rest = train.toPandas(), df.where(F.col("fold") == i).toPandas()
            z, w = np.column_stack([np.ones(len(pdf)), pdf[X]]), np.sqrt(pdf["weight"].to_numpy(float))
            beta = np.linalg.lstsq(z * w[:, None], pdf["y"] * w, rcond=None)[0]
            want = dict(zip(rest["row_id"], np.column_stack([np.ones(len(rest)), rest[X]]) @ beta))
        assert want and all(mine[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())
    twice = df.withColumns({"c": F.col("a") * 2, "one": F.lit(3.0)})
    again = linear.linear_out_of_fold(twice, ["y"], [*X, "c", "one"], False, ["row_id"], "weight")
    if not pairwise:
        assert all(r["p"] == pytest.approx(mine[r["row_id"]], abs=1e-6) for r in again.collect())


def test_fold_table_is_safe_to_repeat(spark, rows):
    folder = new_path(spark, "folds")
    df = rows.select("row_id", F.col("b_y").alias("y"), F.col("a").alias("p"))
    schema = fold_table.table_schema(rows, ["row_id"])
    assert fold_table.read_folds(spark, folder, schema).count() == 0
    for target, fold in (("x/y: 1=%", 0), ("x/y: 1=%", 1), ("x/y: 1=%", 1), ("b_y", 1)):
        fold_table.write_fold(df.limit(10 + fold), folder, target, "rf", fold)
    back = fold_table.read_folds(spark, folder, schema)
    got = {(r["target"], r["fold"]): r["n"] for r in back.groupBy("target", "fold").agg(F.count("*").alias("n")).collect()}
    assert got == {("x/y: 1=%", 0): 10, ("x/y: 1=%", 1): 11, ("b_y", 1): 11}
    assert back.columns == ["row_id", "y", "p", "target", "model", "fold"]


def test_folds_per_target(rows):
    """A target that few groups have gets as many folds as groups; one of two groups gets none."""
    df = rows.withColumns({"some": F.when(F.col("doi").isin("1", "2", "3", "4"), F.col("b_y")),
                           "two": F.when(F.col("doi").isin("1", "2"), F.col("b_y"))})
    run = training.train_targets(df, ["b_y", "some", "two"], X, k=6, forest=FOREST, tree={"maxDepth": 3},
                                 final_fit=False, group="doi", keep=["row_id", "doi"])
    folds = {(r["target"], r["model"]): r["n"] for r in run.oof.groupBy("target", "model").agg(
        F.count_distinct("fold").alias("n")).collect()}
    assert folds == {(t, m): n for t, n in (("b_y", 6), ("some", 4)) for m in ("rf_qr", "dt", "lr")}
    split = run.oof.groupBy("target", "model", "doi").agg(F.count_distinct("fold").alias("n"))
    assert split.where("n > 1").count() == 0
    got = {r["target"]: r for r in run.results.collect()}
    assert got["two"]["r2_rf"] is None and got["two"]["n"] > 30 and got["some"]["r2_lr"] > 0.99
    plan = run.oof._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
