import json

import pytest
from pyspark.sql import functions as F

from uqframe.operators.columns import coerce_numeric
from uqframe.sources import tables
from uqframe.sources.session import cut_lineage, new_path, shared_dir


def test_csv_collisions_and_malformed_lines(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes("DOI,T,t,Process_type,process_type,O/C\n10.1/a,300,20,HTL,htl,0.5\n"
                     "10.1/b,310,x,Café,,0.6,7,8\n".encode("latin-1"))
    df = tables.read_experiments(spark, str(path), encoding="ISO-8859-1")
    assert df.columns == ["doi", "temp_c", "t_min", "process_type_a", "process_type_b", "o_c", tables.CORRUPT]
    rows = coerce_numeric(df, ["temp_c", "t_min", "o_c"]).cache().orderBy("doi").collect()
    assert (rows[0]["temp_c"], rows[0]["t_min"], rows[1]["t_min"]) == (300.0, 20.0, None)
    assert rows[1]["process_type_a"] == "Café"
    got = tables.malformed_rows(df.cache()).collect()[0]
    assert (got["n_rows"], got["n_malformed"]) == (2, 1)


def test_params_round_trip(spark, tmp_path):
    path = str(tmp_path / "params")
    tables.write_best_params(spark, {"rf": {"b_y": {"numTrees": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"}}},
                             ["b_y", "c_y"], path)
    got = {r["target"]: r for r in tables.read_best_params(spark, path).collect()}
    assert tables.typed_params(got["b_y"]["rf"]) == {"numTrees": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"}
    assert got["c_y"]["rf"] == {} and got["b_y"]["dt"] == {}
    other = tmp_path / "p.csv"
    other.write_text('Target,my_RF_best_params\nb_y,"{""maxDepth"": 3}"\n ,{}\nc_y,not json\n')
    got = {r["target"]: r["rf"] for r in tables.read_best_params(spark, str(other)).collect()}
    assert got == {"b_y": {"maxDepth": "3"}, "c_y": {}}


def test_manifests(spark, tmp_path):
    tables.write_manifest(spark, ["x2", "x1"], ["y"], str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")) == (["x2", "x1"], ["y"])
    (tmp_path / "lists.json").write_text(json.dumps({"X_cols": ["T", "O/C"], "Y_cols": ["B_Y"]}, indent=2))
    assert tables.read_feature_lists(spark, str(tmp_path / "lists.json")) == (["temp_c", "o_c"], ["b_y"])


def test_results_and_audit(spark, tmp_path):
    folder = str(tmp_path / "results")
    assert tables.read_results(spark, folder, "default") is None
    rows = spark.createDataFrame([("b_y", 0.5)], "target string, r2 double")
    tables.write_results(rows, folder, "default")
    tables.write_results(rows.withColumn("r2", F.lit(0.7)), folder, "group")
    assert tables.read_results(spark, folder, "default").collect()[0]["r2"] == 0.5
    registry = spark.createDataFrame([("b_y", "rf"), ("c_y", "rf"), ("zz", "rf"), ("b_y", "lr")], "target string, kind string")
    audit = {r["kind"]: r["available"] for r in tables.artifact_audit(
        spark, ["b_y", "c_y"], registry, rows, None).collect()}
    assert audit == {"model_rf": 2, "model_dt": 0, "model_lr": 1, "best_params": 1, "calibration": 0}


def test_shared_folder(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark))
    df = spark.range(10).withColumn("v", F.rand())
    kept = cut_lineage(df)
    assert kept.collect() == kept.collect() and kept.schema["v"].dataType.simpleString() == "double"


def test_raw_projections(spark):
    df = spark.createDataFrame([(1.0, 2.0, "d", 0.0, 3.0)], "temp_c double, b_y double, doi string, cat_zz double, cat_ratio_log10 double")
    got = {k: v.columns for k, v in tables.raw_projections(df).items()}
    assert got == {"metadata": ["doi", "temp_c"], "numeric_features": ["temp_c", "doi"],
                   "targets": ["b_y"], "categorical_features": ["cat_zz"]}


@pytest.mark.parametrize("raw,name", [("T", "temp_c"), ("t", "t_min"), ("H/C_biooil", "h_c_biooil"), (" DOI ", "doi")])
def test_names(raw, name):
    assert tables.column_name(raw) == name


def test_scratch_folders_have_an_owner(spark):
    from uqframe.sources import session

    df = session.cut_lineage(spark.range(5), "owned")
    path = session._MADE[-1]
    kept, session._MADE[:] = session._MADE[:-1], [path]
    assert df.count() == 5 and session.drop_scratch(spark) == 1
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    session._MADE[:] = kept


def test_unknown_interval_mode(spark):
    import pytest

    from uqframe.plans.scoring import prediction_interval

    with pytest.raises(ValueError):
        prediction_interval(spark.range(1), "nearest")
