"""Sources and sinks: what is written is read back and checked as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import bucket_sql, experiments, r6, rnd, scored, with_e, with_s
from uqframe.operators import encode, intervals, metrics, splits
from uqframe.operators.columns import coerce_numeric
from uqframe.sources import tables
from uqframe.sources.session import new_path


def csv_scan(spark, sf):
    """All experiments through CSV with colliding header names."""
    path = new_path(spark, "csv")
    df = experiments(spark, sf).select(
        F.col("row_id"), F.col("feedstock").alias("Feedstock"), F.col("temp_c").cast("string").alias("T"),
        F.col("t_min").cast("string").alias("time"), F.col("a_y").cast("string").alias("A_Y"),
        F.col("o_c").cast("string").alias("O/C"))
    tables.write_table(df, path, "csv")
    back = coerce_numeric(tables.read_experiments(spark, path), ["temp_c", "time", "a_y", "o_c"])
    return rnd(back.groupBy("feedstock").agg(
        F.count("*").alias("n"), F.sum("temp_c").alias("sum_t"), F.sum("time").alias("sum_m"),
        F.count("a_y").alias("n_a"), F.avg("o_c").alias("mean_o_c"),
        F.count(tables.CORRUPT).alias("malformed")), "mean_o_c")


def raw_exports(spark, sf):
    """The four raw projections, by row and column count."""
    df = experiments(spark, sf, part=True).withColumn("lri_imputed", F.col("t_min") - 5)
    path = new_path(spark, "raw")
    found = tables.export_raw(df, path)
    out = None
    for name in ("metadata", "numeric_features", "targets", "categorical_features"):
        part = spark.read.parquet(f"{path}/{name}")
        row = part.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("part"), F.lit(len(part.columns)).alias("columns"), "n")
        out = row if out is None else out.unionByName(row)
    extra = df.agg(F.lit(found["lri_imputed_nonzero"]).cast("bigint").alias("n")).select(
        F.lit("lri_imputed_nonzero").alias("part"), F.lit(0).alias("columns"), "n")
    return out.unionByName(extra)


def feature_export(spark, sf):
    """Engineered export, its one-hot counts, and the manifest read back."""
    df = experiments(spark, sf, part=True)
    built = encode.build_features(df, ["temp_c", "t_min"], [], [], ["b_y", "c_y"], use_basis=False)
    path = new_path(spark, "features")
    counts = tables.export_features(built, path)
    tables.write_manifest(spark, built.x_cols, built.y_cols, f"{path}/manifest")
    x_cols, _ = tables.read_manifest(spark, f"{path}/manifest")
    back = spark.read.parquet(f"{path}/x_engineered")
    solv = [c for c in x_cols if c.startswith("solv_")]
    rows = back.agg(*[F.sum(c).alias(c) for c in solv]).unpivot([], solv, "column", "total")
    return counts.where(~F.col("column").startswith("subtype_")).join(rows, "column", "left").select(
        "column", "n_ones", "total")


def matrices(spark, sf):
    """Train and test matrices through files, joined again by row."""
    df = splits.split_rows(experiments(spark, sf))
    train, test = splits.materialize(df)
    path = new_path(spark, "parts")
    tables.write_parts(train, test, ["temp_c", "t_min"], ["b_y", "a_y"], path)
    parts = tables.read_parts(spark, path)
    out = None
    for side in ("train", "test"):
        rows = parts[f"x_{side}"].join(parts[f"y_{side}"], "row_id")
        one = rows.agg(F.count("*").alias("n"), F.sum(F.col("temp_c") * F.col("b_y")).alias("total"),
                       F.count("a_y").alias("n_a")).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out


def best_params(spark, sf):
    """Parameters learned per feedstock, through their table."""
    rows = experiments(spark, sf).groupBy("feedstock").agg(
        F.max("t_min").cast("int").alias("depth"), F.count("*").alias("n")).collect()  # six feedstocks
    best = {"rf": {r["feedstock"]: {"maxDepth": r["depth"], "numTrees": r["n"]} for r in rows},
            "dt": {r["feedstock"]: {"maxDepth": r["depth"]} for r in rows if r["feedstock"] != "AF"}}
    path = new_path(spark, "params")
    tables.write_best_params(spark, best, [r["feedstock"] for r in rows], path)
    back = tables.read_best_params(spark, path)
    return back.select("target", F.col("rf")["maxDepth"].cast("int").alias("rf_depth"),
                       F.col("rf")["numTrees"].cast("bigint").alias("rf_trees"),
                       F.size("dt").alias("n_dt"))


def results(spark, sf):
    """Result tables of two trainer modes in one folder."""
    df = scored(experiments(spark, sf))
    path = new_path(spark, "results")
    for mode, shift in (("default", 0.0), ("group", 1.0)):
        rows = df.withColumn("p", F.col("p") + shift).groupBy(F.col("feedstock").alias("target")).agg(
            metrics.rmse().alias("rmse"), metrics.r2().alias("r2"))
        tables.write_results(rows, path, mode)
    return rnd(tables.read_results(spark, path, "group"), "rmse", "r2")


def calibration(spark, sf):
    """Residuals partitioned by target, one target's width, and the audit."""
    df = scored(experiments(spark, sf))
    oof = metrics.long_targets(
        df.withColumns({"p_b_y": F.col("p"), "p_c_y": F.col("c_y") + F.col("t_min")}), ["b_y", "c_y"],
        ["row_id", "temp_c"])
    oof = splits.row_folds(oof, 5).withColumn("vec", F.array("temp_c"))
    path = new_path(spark, "calibration")
    tables.write_calibration(oof, path)
    one = tables.read_calibration(spark, path, "b_y")
    width = intervals.conformal_width(one.select("abs_resid"), 0.10, [])
    audit = tables.artifact_audit(spark, ["b_y", "c_y", "a_y"], None, None, spark.read.parquet(path))
    have = audit.where("kind = 'calibration'").select("expected", "available")
    return rnd(width.join(F.broadcast(have), F.lit(True)), "q")  # one row each


_TEST = f"{bucket_sql('row_id')} < {int(0.2 * (1 << 32))}"
_FAM = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

QUERIES = {
    "csv_scan": (csv_scan, with_e(
        f"SELECT feedstock, count(*) AS n, sum(temp_c) AS sum_t, sum(t_min) AS sum_m, count(a_y) AS n_a, "
        f"{r6('avg(o_c)')} AS mean_o_c, cast(0 as bigint) AS malformed FROM e GROUP BY 1")),
    "raw_exports": (raw_exports, with_e(
        "SELECT 'metadata' AS part, 8 AS columns, count(*) AS n FROM e UNION ALL SELECT 'numeric_features', 13, count(*) "
        "FROM e UNION ALL SELECT 'targets', 12, count(*) FROM e UNION ALL SELECT 'categorical_features', 15, count(*) "
        "FROM e UNION ALL SELECT 'lri_imputed_nonzero', 0, count(*) FROM e WHERE t_min <> 5")),
    "feature_export": (feature_export, with_e(" UNION ALL ".join(
        [f"SELECT 'family_{v}' AS \"column\", count(*) FILTER (family = '{v}') AS n_ones, cast(null as double) AS total "
         "FROM e" for v in _FAM]
        + ["SELECT 'family_nan', count(*) FILTER (family IS NULL), null FROM e"]
        + [f"SELECT '{c}', cast(sum({c}) as bigint), sum({c}) FROM e" for c in ("solv_ethanol", "solv_methanol")]))),
    "matrix_files": (matrices, with_e(
        f"SELECT case when {_TEST} then 'test' else 'train' end AS side, count(*) AS n, sum(temp_c * b_y) AS total, "
        "count(a_y) AS n_a FROM e GROUP BY 1")),
    "best_params": (best_params, with_e(
        "SELECT feedstock AS target, cast(max(t_min) as integer) AS rf_depth, count(*) AS rf_trees, "
        "case when feedstock = 'AF' then 0 else 1 end AS n_dt FROM e GROUP BY 1")),
    "result_tables": (results, with_s(
        f"SELECT feedstock AS target, {r6('sqrt(avg((y - p - 1) * (y - p - 1)))')} AS rmse, "
        f"{r6('1 - sum((y - p - 1) * (y - p - 1)) / (var_pop(y) * count(*))')} AS r2 FROM s GROUP BY 1")),
    "calibration_table": (calibration, with_s(
        f"SELECT {r6('quantile_cont(abs(y - p), 0.9)')} AS q, count(*) AS n_resid, 3 AS expected, "
        "cast(2 as bigint) AS available FROM s")),
}
