from pyspark.sql import functions as F

from uqframe.operators.cleaning import basis_to_dry, normalize_ids
from uqframe.operators.encode import add_interactions, fill_flags, fill_with_indicator
from uqframe.operators.envelopes import add_envelopes
from uqframe.operators.physics import closure_error, derived_energy, yield_closure
from uqframe.streaming.scoring import write_scored

SCHEMA = ("row_id long, doi string, basis_class string, ash double, temp_c double, ic double, b_y double, c_y double, "
          "a_y double, g_y double, hhv_biooil double, extra string, process_type_a string, acid_flag boolean, frac_water double")
STEPS = [normalize_ids, basis_to_dry, lambda d: add_interactions(d)[0], yield_closure, closure_error, derived_energy,
         add_envelopes, lambda d: fill_with_indicator(d, ["frac_water"]), lambda d: fill_flags(d, ["acid_flag"])]


def test_row_wise_steps_run_on_a_stream(spark, tmp_path):
    rows = [(i, f"DOI:{i}", "daf" if i % 2 else "dry_basis", float(i % 30), 200.0 + i, None if i % 4 else 5.0, 40.0, 30.0,
             20.0, None if i % 3 else 15.0, 30.0, None, "HTL", i % 5 == 0, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i in range(3):
        df.where(F.col("row_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = write_scored(stream, STEPS, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    expected = df
    for step in STEPS:
        expected = expected.transform(step)
    got = spark.read.parquet(str(tmp_path / "out")).select(*expected.columns)
    assert got.count() == 60
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
