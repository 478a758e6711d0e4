"""Nearest neighbours and local conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import bucket_sql, experiments, r6, rnd, scored, with_e
from uqframe.operators import intervals, knn, metrics, splits

RESID = "cast((vec_id * 37 % 101) as double) / 10"


def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("cid"),
                       F.col("embedding").cast("array<double>").alias("vec"),
                       (F.col("label") * 10.0).alias("p"), F.expr(RESID).alias("abs_resid"))


def neighbours(spark, sf):
    """The five nearest vectors of every vector."""
    df = vectors(spark, sf)
    out = knn.nearest(df.select("qid", "vec"), df.select("cid", "vec", "abs_resid"), 5, "abs_resid")
    return rnd(out.select("qid", "cid", "rank", "dist"), "dist")


def local(spark, sf):
    """H5: local conformal intervals from the 50 nearest residuals."""
    df = vectors(spark, sf)
    out = knn.local_conformal(df.select("qid", "vec", "p"), df.select("cid", "vec", "abs_resid"))
    return rnd(out.select("qid", "q_local", "lo", "hi"), "q_local", "lo", "hi")


def experiment_intervals(spark, sf):
    """H5, H10 on all experiments: widths from the training part, coverage on the test part."""
    df = splits.split_rows(scored(experiments(spark, sf)))
    df = df.withColumn("vec", F.array("temp_c", "t_min", (F.col("o_c") * 100), (F.col("h_c") * 100)))
    cal = df.where("is_train").select(F.col("row_id").alias("cid"), "vec",
                                      F.abs(F.col("y") - F.col("p")).alias("abs_resid"))
    queries = df.where("is_test").select(F.col("row_id").alias("qid"), "vec", "feedstock", "y", "p")
    out = knn.local_conformal(queries, cal, k=50)
    return rnd(metrics.interval_report(out, ["feedstock"]), "r2", "rmse", "coverage", "mean_width", "max_width")


LEAVES = ("cast(floor(temp_c / 40) as int)", "cast(floor(t_min / 10) as int)", "cast(floor(o_c * 20) as int)")


def leaf_quantiles(spark, sf):
    """Exact quantiles over shared leaves, where columns of the experiments stand for trees;
    the target has thousands of values."""
    df = splits.split_rows(experiments(spark, sf)).withColumns(
        {f"leaf{i}": F.expr(e) for i, e in enumerate(LEAVES)})
    trees = F.array(*[F.struct(F.lit(i).alias("tree"), F.col(f"leaf{i}").alias("leaf")) for i in range(3)])
    long = df.withColumn("qid", F.concat_ws("-", "leaf0", "leaf1", "leaf2")).select(
        "is_test", "qid", F.col("hhv_biooil").alias("y"), F.explode(trees).alias("t")).select("*", "t.*")
    out = intervals.leaf_quantiles(long.where("not is_test").select("tree", "leaf", "y"),
                                   long.where("is_test").select("qid", "tree", "leaf").distinct(),
                                   {"lo": 0.05, "mid": 0.5, "hi": 0.95})
    return out


_TEST = f"{bucket_sql('row_id')} < {int(0.2 * (1 << 32))}"
_LEAVES = with_e(f""", l AS (SELECT {_TEST} AS is_test, hhv_biooil AS y, {', '.join(
    f'{e} AS leaf{i}' for i, e in enumerate(LEAVES))} FROM e),
 u AS (SELECT is_test, y, concat_ws('-', leaf0, leaf1, leaf2) AS qid, unnest([0, 1, 2]) AS tree,
 unnest([leaf0, leaf1, leaf2]) AS leaf FROM l),
 t AS (SELECT tree, leaf, y, count(*) AS c FROM u WHERE NOT is_test GROUP BY 1, 2, 3),
 s AS (SELECT tree, leaf, sum(c) AS size FROM t GROUP BY 1, 2),
 q AS (SELECT DISTINCT qid, tree, leaf FROM u WHERE is_test),
 w AS (SELECT qid, y, sum(c / size) AS w FROM q JOIN t USING (tree, leaf) JOIN s USING (tree, leaf) GROUP BY 1, 2),
 r AS (SELECT qid, y, sum(w) OVER (PARTITION BY qid ORDER BY y) AS up, sum(w) OVER (PARTITION BY qid) AS whole FROM w)
 SELECT qid, """.lstrip() + ", ".join(
    f"min(y) FILTER (up >= whole * {p} - 1e-9) AS {n}" for n, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95)))
    + " FROM r GROUP BY 1")

_NEAR = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, {RESID} AS resid FROM embeddings),
 d AS (SELECT a.vec_id AS qid, b.vec_id AS cid, a.label, b.resid,
 sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist FROM v a, v b),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM d) """

QUERIES = {
    "nearest_neighbours": (neighbours, _NEAR + f"SELECT qid, cid, cast(rank as integer) AS rank, {r6('dist')} AS dist "
                           "FROM r WHERE rank <= 5"),
    "local_conformal_knn": (local, _NEAR + f"""
, q AS (SELECT qid, any_value(label) * 10.0 AS p, quantile_cont(resid, 0.9) AS q FROM r WHERE rank <= 50 GROUP BY 1)
SELECT qid, {r6('q')} AS q_local, {r6('cast(p as double) - q')} AS lo, {r6('cast(p as double) + q')} AS hi FROM q"""),
    "local_conformal_experiments": (experiment_intervals, None),
    "leaf_quantiles": (leaf_quantiles, _LEAVES),
}
