"""Training of many targets: folds, weighted fits, three kinds of models, and registries."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor,
    LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType

from uqframe.constants import (
    BOOSTED_DEFAULTS, FOREST_DEFAULTS, LIGHT_TUNING_CANDIDATES, LIGHT_TUNING_ROWS,
    MIN_TRAIN_ROWS, SEARCH_DRAWS, SEARCH_LISTS, TREE_DEFAULTS,
)
from uqframe.functions.exprs import to_number
from uqframe.operators.columns import readable_rows, rows_for_target
from uqframe.operators.encode import TargetTransform, choose_transform, sample_weights
from uqframe.operators.metrics import finite_pairs, r2, rmse
from uqframe.operators.splits import group_folds_each, subsample
from uqframe.plans.estimator import CalibratedRegressor
from uqframe.plans.fold_table import read_folds, table_schema, write_fold, write_folds
from uqframe.plans.linear import linear_pairs
from uqframe.sources.session import cut_lineage, drop_cut, new_path

FOREST_MODES = ("rf", "rf_qr", "rf_cal")
BOOSTED_MODES = ("xgb", "xgb_cal")
KINDS = ("rf", "dt", "lr")
LOADERS = {"rf": RandomForestRegressionModel, "gbt": GBTRegressionModel,
           "dt": DecisionTreeRegressionModel, "lr": LinearRegressionModel}


def allowed(params: dict[str, Any], estimator: Any) -> dict[str, Any]:
    """The parameters that the estimator knows."""
    return {k: v for k, v in params.items() if estimator.hasParam(k)}


def merged(defaults: dict[str, Any], best: dict[str, Any] | None) -> dict[str, Any]:
    return {**defaults, **(best or {})}


def make_estimator(mode: str, params: dict[str, Any] | None = None) -> Any:
    """Spark estimator of a mode; ``rf_qr`` is a plain forest, ``xgb`` boosted trees."""
    if mode in FOREST_MODES:
        est, values = RandomForestRegressor(), merged(FOREST_DEFAULTS, params)
    elif mode in BOOSTED_MODES:
        est, values = GBTRegressor(), merged(BOOSTED_DEFAULTS, params)
    elif mode == "dt":
        est, values = DecisionTreeRegressor(), merged(TREE_DEFAULTS, params)
    elif mode == "lr":
        est, values = LinearRegression(), params or {}
    else:
        raise ValueError(f"unknown model mode {mode!r}; known: "
                         f"{FOREST_MODES + BOOSTED_MODES + ('dt', 'lr')}")
    return est.setParams(**allowed(values, est))


@dataclass
class Fitted:
    """A model with what leads from its raw output to the target's scale."""

    model: Any
    features: list[str]
    mode: str
    transform: TargetTransform = field(default_factory=lambda: TargetTransform("identity"))
    slope: float = 1.0
    shift: float = 0.0
    estimator: Any = None

    def fits_like(self, other: Any, features: list[str], transform: TargetTransform) -> bool:
        """Whether the estimator ``other`` would fit the same model on the same rows."""
        values = [{p.name: v for p, v in e.extractParamMap().items()} for e in (self.estimator, other) if e is not None]
        return (len(values) == 2 and type(self.estimator) is type(other) and values[0] == values[1]
                and self.features == list(features) and self.transform == transform)

    def score(self, df: DataFrame, column: str) -> DataFrame:
        """Add the prediction; features the frame lacks count as 0.0."""
        own = [] if holds(df, self.features, self.mode) else ["features"]
        out = with_vector(df, self.features, self.mode, strict=False)
        out = self.model.copy().setPredictionCol("_raw").transform(out)
        value = self.transform.invert(F.col("_raw"))
        if (self.slope, self.shift) != (1.0, 0.0):
            value = value * F.lit(self.slope) + F.lit(self.shift)
        return out.withColumn(column, value).drop("_raw", *own)


def with_vector(df: DataFrame, features: list[str], mode: str, strict: bool = True) -> DataFrame:
    """Add the ``features`` vector; the linear model also gets all pairwise products.

    The vector is one expression over the columns. Helper columns would double the
    optimizer's constraints with every feature.
    """
    if holds(df, features, mode):
        return df
    missing = [c for c in features if c not in df.columns]
    if missing and strict:
        raise KeyError(f"missing features {missing}")
    x = [F.lit(0.0) if c in missing else F.col(f"`{c}`").cast("double") for c in features]
    if mode == "lr":
        x += [a * b for i, a in enumerate(x) for b in x[i + 1:]]
    values = F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in x])
    return df.withColumn("features", array_to_vector(values))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Add the ``features`` vector for many fits of the same features, null where one is missing; the
    column says which features it holds, and fits of other features or of linear models ignore it."""
    if not features or "features" in df.columns:
        return df
    if not all(isinstance(df.schema[c].dataType, (NumericType, BooleanType)) for c in features):
        return df
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return df.withColumn("features", F.when(whole, array_to_vector(values)).alias(
        "features", metadata={"holds": list(features)}))


def packed(df: DataFrame, features: list[str], keep: list[str] = (), sparse: bool = False) -> DataFrame:
    """Only ``keep`` and the ``features`` vector as ``with_vector`` makes it, NaN where one is missing;
    ``whole`` says whether none is. Written once, it serves fits and scores that would each read and
    assemble all columns in every pass. ``sparse`` leaves zeros out of the vectors that are shorter without."""
    whole = F.lit(True)
    for c in features:
        whole &= F.col(f"`{c}`").isNotNull()
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            whole &= ~F.isnan(F.col(f"`{c}`"))
    vector = F.col("features").alias("features", metadata={"holds": list(features)})
    if sparse:  # plain names, so that a dot in a label is no path
        names = {f"_x{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(features)}
        kept = [F.col(f"`{c}`") for c in dict.fromkeys(keep)]
        assembler = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")
        out = assembler.transform(df.select(*kept, whole.alias("whole"), *[c.alias(n) for n, c in names.items()]))
    else:
        out = with_vector(df, features, "rf").withColumn("whole", whole)
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)], vector, "whole")


def holds(df: DataFrame, features: list[str], mode: str) -> bool:
    """Whether the frame has the vector of these features from ``assembled`` or ``packed``."""
    return (mode != "lr" and "features" in df.columns
            and df.schema["features"].metadata.get("holds") == list(features))


def vector_whole(df: DataFrame) -> Column:
    """Whether no feature is missing, of a frame that ``holds`` the vector."""
    return F.col("whole") if "whole" in df.columns else F.col("features").isNotNull()


def whole_rows(df: DataFrame, features: list[str], mode: str) -> DataFrame:
    """Rows that miss no feature, by the vector where the frame has it."""
    return df.where(vector_whole(df)) if holds(df, features, mode) else df.dropna(subset=list(features))


def usable_rows(df: DataFrame, target: str, features: list[str], mode: str) -> DataFrame:
    """``rows_for_target``, by the vector where the frame has it."""
    if holds(df, features, mode):
        return readable_rows(df, target).where(vector_whole(df))
    return rows_for_target(df, target, features)


def fit_model(df: DataFrame, target: str, features: list[str], mode: str = "rf",
              params: dict[str, Any] | None = None, weight: str | None = "weight",
              transform: TargetTransform | None = None, like: Fitted | None = None) -> Fitted:
    """Fit one target on its usable rows under its label transform.

    ``*_cal`` modes then regress the target on the model's own predictions. ``like`` is a model of the
    same rows: where its mode has the same estimator and parameters, the trees are its trees.
    """
    rows = usable_rows(df, target, features, mode)
    if mode in ("dt", "lr"):
        transform = TargetTransform("identity")
    elif transform is None:
        known = like is not None and like.mode not in ("dt", "lr")
        transform = like.transform if known else choose_transform(rows, target)
    rows = with_vector(rows, features, mode).withColumn("label", transform.apply(F.col(target)))
    est = make_estimator(mode, params).setLabelCol("label").setFeaturesCol("features")
    if weight and weight in df.columns:
        est = est.setWeightCol(weight)
    if like is not None and like.fits_like(est, features, transform):
        fitted = Fitted(like.model, list(features), mode, transform, estimator=est)
    else:
        fitted = Fitted(est.fit(rows), list(features), mode, transform, estimator=est)
    if mode.endswith("_cal"):
        line = calibration_line(fitted.score(rows.drop("label"), "_p"), target, "_p")
        fitted.slope, fitted.shift = line
    return fitted


def calibration_line(df: DataFrame, target: str, prediction: str) -> tuple[float, float]:
    row = df.agg(F.regr_slope(target, prediction).alias("a"),
                 F.regr_intercept(target, prediction).alias("b")).collect()[0]
    return (1.0, 0.0) if row["a"] is None else (float(row["a"]), float(row["b"]))


def out_of_fold(df: DataFrame, target: str, features: list[str], k: int, mode: str = "rf",
                params: dict[str, Any] | None = None, keep: list[str] = ("row_id",),
                weight: str | None = "weight", folder: str | None = None) -> DataFrame:
    """(keep…, y, p, target, model, fold): every row scored by a model that never saw its
    fold, and whose label transform was learned without it.

    Each fold's rows go to the out-of-fold table in ``folder``; linear models come from sums, in
    one job for all folds.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "folds")
    rows = usable_rows(df, target, features, mode)
    if mode == "lr":
        own = weight if weight and weight in df.columns else None
        write_folds(linear_pairs(rows, [target], features, True, keep, own), folder, [target], "lr")
    else:
        for i in range(k):
            fitted = fit_model(rows.where(F.col("fold") != i), target, features, mode, params,
                               weight)
            part = fitted.score(rows.where(F.col("fold") == i), "p")
            write_fold(part.select(*keep, F.col(target).alias("y"), "p"), folder, target, mode, i)
    table = read_folds(spark, folder, table_schema(df, list(keep)))
    return table.where((F.col("target") == target) & (F.col("model") == mode))


def fold_scores(oof: DataFrame, digits: int = 3) -> DataFrame:
    """(target, n, r2_rf, rmse_rf, r2_dt, rmse_dt, r2_lr, rmse_lr): fold means."""
    folds = finite_pairs(oof).groupBy("target", "model", "fold").agg(
        F.count("*").alias("n"), r2().alias("r2"), rmse().alias("rmse"))
    kind = F.when(F.col("model").isin("dt", "lr"), F.col("model")).otherwise(F.lit("rf"))
    means = folds.groupBy("target", kind.alias("kind")).agg(
        F.sum("n").alias("n"), F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
    wide = [F.round(F.max(F.when(F.col("kind") == m, F.col(v))), digits).alias(f"{v}_{m}")
            for m in KINDS for v in ("r2", "rmse")]
    return means.groupBy("target").agg(F.max("n").alias("n"), *wide)


@dataclass
class Training:
    """What a training run leaves: result rows, out-of-fold rows and the final models."""

    results: DataFrame
    oof: DataFrame | None
    models: dict[str, dict[str, Fitted]]


def train_targets(df: DataFrame, targets: list[str], features: list[str], k: int = 10,
                  mode: str = "rf_qr", forest: dict[str, Any] | None = None,
                  tree: dict[str, Any] | None = None,
                  best: dict[str, dict[str, Any]] | None = None,
                  linear_features: list[str] | None = None, strategy: str | None = None,
                  keep: list[str] = ("row_id",), parallelism: int = 2,
                  final_fit: bool = True, group: str | None = None,
                  folder: str | None = None) -> Training:
    """Cross-validate and fit the three models of every target.

    ``df`` has an integer ``fold`` column from row folds; with ``group`` each target gets group
    folds of its own, made of its usable rows, and at most as many as it has groups. A target that
    is absent or has too few rows or groups gets a result row of nulls. Fits of different targets may
    overlap on the cluster. The frame is written once, so that folds neither recompute the features
    nor depend on executors that may be lost; with ``group`` it has the features of all trees as one vector, so
    that the rows which every target then writes for itself hold no other columns, and the folds of all targets, which
    come from one count of the groups and one join. A target's rows are deleted after its fits. Every (target, model, fold) writes its rows to
    the out-of-fold table in ``folder``, from which all scores come in one aggregate. Linear
    models come from sums: one pass for all targets that share their folds.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "folds")
    present = [t for t in targets if t in df.columns]
    straight = linear_features or features
    frame = assembled(df, features) if group else df
    if holds(frame, features, mode):  # fits read the vector, not its columns
        named = {*keep, *present, *straight, "features", "whole", "fold", "weight", *([group] if group else [])}
        named |= {"temp_c"} if strategy else set()
        frame = frame.select(*[F.col(f"`{c}`") for c in frame.columns if c in named])
    each = None
    if group and present:
        frame = whole_rows(frame, features, mode)
        each = group_folds_each(frame, [to_number(t).isNotNull() for t in present], group, k)
        frame = each.df
    frame = cut_lineage(frame, "training")
    if each:
        usable = dict(zip(present, each.rows))
        ready = [t for t, n, own in zip(present, each.rows, each.k) if n >= MIN_TRAIN_ROWS and own]
    else:
        usable = whole_rows(frame, features, mode).agg(
            *[F.count(to_number(t)).alias(t) for t in present]).collect()[0].asDict() if present else {}
        ready = [t for t in present if usable[t] >= MIN_TRAIN_ROWS]
    together = strategy is None
    bundles: dict[int | None, list[str]] = {}
    for t in ready if together else []:
        bundles.setdefault(each.alike[present.index(t)] if each else None, []).append(t)
    for at, some in bundles.items():
        rows = frame if at is None else frame.withColumn("fold", F.get("folds", F.lit(at))).where("fold is not null")
        write_folds(linear_pairs(rows, some, straight, True, list(keep)), folder, some, "lr")

    def one(target: str) -> tuple[str, dict[str, Fitted]]:
        rf = merged(forest or {}, (best or {}).get(target))
        setups = {"rf": (mode, rf, features), "dt": ("dt", tree, features),
                  "lr": ("lr", None, straight)}
        own, folds = usable_rows(frame, target, features, mode), k
        if holds(own, features, mode):  # other targets are not written again
            others = set(present) - {target, *keep, *straight, "temp_c", *([group] if group else [])}
            own = own.drop(*others)
        if each:
            at = present.index(target)
            folds = each.k[at]
            own = own.withColumn("fold", F.get("folds", F.lit(at))).drop("folds")
        own = sample_weights(own, strategy)
        if each or strategy:
            own = cut_lineage(own, "target")  # weights and folds are those of the target's usable rows
        for m, p, cols in setups.values():
            if not (m == "lr" and together):
                out_of_fold(own, target, cols, folds, m, p, keep, folder=folder)
        models = {kind: fit_model(own, target, cols, m, p)
                  for kind, (m, p, cols) in setups.items()} if final_fit else {}
        if each or strategy:
            drop_cut(own)
        return target, models

    with ThreadPool(max(1, parallelism)) as pool:
        done = pool.map(one, ready)
    oof = read_folds(spark, folder, table_schema(df, list(keep))) if ready else None
    rest = [(t, int(usable.get(t, 0))) for t in targets if t not in ready]
    empty = spark.createDataFrame(rest, "target string, n long")
    results = empty if oof is None else fold_scores(oof).unionByName(empty, allowMissingColumns=True)
    return Training(results, oof, dict(done))


def random_candidates(lists: dict[str, list] = SEARCH_LISTS, draws: int = SEARCH_DRAWS,
                      seed: int = 42) -> list[dict[str, Any]]:
    """Parameter draws without repetition."""
    rng, seen, out = random.Random(seed), set(), []
    space = 1
    for values in lists.values():
        space *= len(values)
    while len(out) < min(draws, space):
        pick = {k: rng.choice(v) for k, v in lists.items()}
        if tuple(pick.items()) not in seen:
            seen.add(tuple(pick.items()))
            out.append(pick)
    return out


def param_maps(estimator: Any, candidates: list[dict[str, Any]]) -> list[dict]:
    return [{estimator.getParam(k): v for k, v in allowed(c, estimator).items()}
            for c in candidates]


def _tuned(df: DataFrame, target: str, features: list[str], mode: str, base: dict[str, Any] | None,
           weight: str | None, label: str) -> tuple[DataFrame, CalibratedRegressor]:
    """Rows for a search, written once unless the frame has their vector, and the stage that it scores:
    transform, regressor and calibration, with the weights of the rows."""
    extra = [c for c in ("fold", weight) if c and c in df.columns]
    rows = usable_rows(df, target, features, mode)
    rows = with_vector(rows, features, mode).select(target, "features", *extra)
    est = CalibratedRegressor(labelCol=target, target=target, mode=mode, **(base or {}))
    if weight and weight in df.columns:
        est = est.setParams(weightCol=weight)
    return (rows if holds(df, features, mode) else cut_lineage(rows, label)), est


def _scores_table(spark: SparkSession, candidates: list[dict[str, Any]], scores: list[float]) -> DataFrame:
    return spark.createDataFrame(
        [(i, str(sorted(c.items())), float(s)) for i, (c, s) in enumerate(zip(candidates, scores))],
        "candidate int, params string, r2 double")


def search(df: DataFrame, target: str, features: list[str], base: dict[str, Any] | None = None,
           candidates: list[dict[str, Any]] | None = None, k: int = 10, parallelism: int = 2,
           mode: str = "rf", weight: str | None = "weight") -> tuple[dict[str, Any], DataFrame]:
    """Best parameters by cross-validated R² on the target's own scale, and the (candidate, r2) table.

    Folds are conditions on the written rows: Spark's ``CrossValidator`` would send every row's fold through
    Python, keep each fold in memory and fit the winner once more, which nothing here reads.
    """
    candidates = random_candidates() if candidates is None else candidates
    rows, est = _tuned(df, target, features, mode, base, weight, "search")
    maps, evaluator = param_maps(est, candidates), RegressionEvaluator(labelCol=target, metricName="r2")
    found = {r["fold"] for r in rows.select("fold").distinct().limit(k + 1).collect()}
    if found != set(range(k)):
        raise ValueError(f"the folds of {target} are to be 0 to {k - 1}, without an empty one; found {found}")

    def one(place: tuple[int, int]) -> float:
        i, c = place
        model = est.fit(rows.where(F.col("fold") != i), maps[c])
        return evaluator.evaluate(model.transform(rows.where(F.col("fold") == i), maps[c]))

    places = [(i, c) for i in range(k) for c in range(len(maps))]
    with ThreadPool(max(1, parallelism)) as pool:
        each = pool.map(one, places)
    scores = [sum(each[c::len(maps)]) / k for c in range(len(maps))]
    best = max(range(len(candidates)), key=lambda i: scores[i])
    return (merged(merged(FOREST_DEFAULTS, base), candidates[best]),
            _scores_table(df.sparkSession, candidates, scores))


def light_tuning(df: DataFrame, target: str, features: list[str],
                 base: dict[str, Any] | None = None,
                 candidates: list[dict[str, Any]] = LIGHT_TUNING_CANDIDATES,
                 n: int = LIGHT_TUNING_ROWS, parallelism: int = 2, mode: str = "rf",
                 weight: str | None = "weight") -> tuple[dict[str, Any], DataFrame]:
    """Best of a few overrides on a small row sample, by R² on a held-out part of it."""
    some = subsample(usable_rows(df, target, features, mode), n)
    rows, est = _tuned(some, target, features, mode, base, weight, "tuning")
    maps = param_maps(est, candidates)
    maps = maps if any(maps) else ParamGridBuilder().build()
    tuner = TrainValidationSplit(estimator=est, estimatorParamMaps=maps, trainRatio=0.75, seed=42,
                                 evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
                                 parallelism=parallelism)
    scores = tuner.fit(rows).validationMetrics
    best = max(range(len(candidates)), key=lambda i: scores[i])
    return (merged(merged(FOREST_DEFAULTS, base), candidates[best]),
            _scores_table(df.sparkSession, candidates, scores))


def safe_name(target: str) -> str:
    for c in "/\\:":
        target = target.replace(c, "_")
    return target


def model_path(folder: str, target: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{safe_name(target)}/{kind}"


def save_models(spark: SparkSession, models: dict[str, dict[str, Fitted]], folder: str) -> DataFrame:
    """Write every model below the folder, and the registry table next to them."""
    rows = []
    for target, kinds in models.items():
        for kind, f in kinds.items():
            f.model.write().overwrite().save(model_path(folder, target, kind))
            rows.append((target, kind, f.mode, f.features, f.transform.kind, f.transform.lam,
                         f.slope, f.shift))
    registry = spark.createDataFrame(
        rows, "target string, kind string, mode string, features array<string>, "
              "transform string, lam double, slope double, shift double")
    registry.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/registry")
    return registry


def load_models(spark: SparkSession, folder: str, targets: list[str],
                kind: str = "rf") -> dict[str, Fitted]:
    """Saved models of one kind; targets without a model are left out."""
    registry = spark.read.parquet(f"{folder.rstrip('/')}/registry")
    rows = registry.where((F.col("kind") == kind) & F.col("target").isin(list(targets))).collect()
    out = {}
    for r in rows:
        loader = LOADERS["gbt" if r["mode"] in BOOSTED_MODES else kind]
        out[r["target"]] = Fitted(
            loader.load(model_path(folder, r["target"], kind)), list(r["features"]), r["mode"],
            TargetTransform(r["transform"], r["lam"]), r["slope"], r["shift"])
    return out


def importances(spark: SparkSession, models: dict[str, dict[str, Fitted]]) -> DataFrame:
    """(target, feature, importance, rank) of the tree ensembles."""
    rows = []
    for target, kinds in models.items():
        f = kinds["rf"]
        scores = f.model.featureImportances.toArray()
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], f.features[i]))
        rows += [(target, f.features[i], float(scores[i]), pos + 1) for pos, i in enumerate(order)]
    return spark.createDataFrame(rows, "target string, feature string, importance double, rank int")


