"""Metrics, parity tables and reports on a scored frame with an arithmetic model."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import (
    bucket_sql, experiments, measured, r2_sql, r6, rmse_sql, rnd, scored, with_e, with_m, with_s,
)
from uqframe.operators import metrics, profile, splits
from uqframe.operators.cleaning import normalize_ids
from uqframe.operators.surfaces import with_target_labels

PARITY = ["b_y", "c_y", "hhv_biooil", "a_y"]


def scored_rows(spark, sf, part=False):
    return scored(experiments(spark, sf, part))


def guessed(df, targets):
    """Arithmetic predictions of several targets."""
    return df.withColumns({f"p_{t}": F.col(t) * 0.9 + F.col("t_min") / 20 for t in targets})


def parity(spark, sf):
    """Errors over all rows."""
    return rnd(metrics.parity_metrics(scored_rows(spark, sf)), "nrmse", "rmse", "r2", "mae")


def band(spark, sf):
    """I4: relative and parallel bands."""
    df = scored_rows(spark, sf)
    out = metrics.band_coverage(df).withColumn("mode", F.lit("relative"))
    out = out.unionByName(metrics.band_coverage(df, mode="parallel").withColumn("mode", F.lit("parallel")))
    return rnd(out, "frac_10", "frac_20")


def long_split(spark, sf, targets=PARITY):
    df = splits.split_rows(guessed(experiments(spark, sf), targets))
    df = df.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return metrics.long_targets(df, targets, ["split"])


def parity_table(spark, sf):
    """Train and test parity per target, with units and labels."""
    out = with_target_labels(metrics.parity_table(long_split(spark, sf)), PARITY)
    return rnd(out, "nrmse", "rmse", "r2", "frac_10", "frac_20")


def intervals(spark, sf):
    """Interval report per target and over everything."""
    df = guessed(experiments(spark, sf), PARITY)
    rows = metrics.long_targets(df, PARITY).withColumns(
        {"lo": F.col("p") - 4, "hi": F.col("p") + 4})
    out = metrics.interval_report(rows)
    return rnd(out, "r2", "rmse", "coverage", "mean_width", "max_width")


def by_family(spark, sf):
    """H7: one row per family."""
    out = metrics.group_report(scored_rows(spark, sf, part=True), "family")
    return rnd(out, "r2", "rmse", "coverage", "width")


def by_paper(spark, sf):
    """Papers with the largest errors first."""
    out = metrics.problem_groups(normalize_ids(scored_rows(spark, sf)), "doi")
    return rnd(out, "r2", "rmse", "coverage")


def summary(spark, sf):
    """Results per target with categories; ratios replaced by derived rows."""
    targets = ["b_y", "e_b", "hhv_biooil", "c_biooil", "o_biooil", "c_biochar", "o_biochar"]
    df = guessed(measured(experiments(spark, sf, part=True)), targets)
    results = metrics.long_targets(df, targets)
    results = metrics.finite_pairs(results).groupBy("target").agg(
        F.count("*").alias("n"), metrics.r2().alias("r2_rf"), metrics.rmse().alias("rmse_rf"))
    derived = metrics.derived_ratio_metrics(df).withColumnsRenamed({"r2": "r2_rf", "rmse": "rmse_rf"})
    out = metrics.result_summary(results, "derived", derived)
    out = out.withColumns({"r2_dt": F.lit(None).cast("double"), "r2_lr": F.lit(None).cast("double")})
    matrix = metrics.metric_matrix(out, "r2").select("target", F.col("r2_rf").alias("r2"))
    return rnd(out.join(matrix, "target").select("target", "category", "n", "rmse_rf", "r2"),
               "rmse_rf", "r2")


def mean_scores(spark, sf):
    """Means per category, nulls left out."""
    df = guessed(measured(experiments(spark, sf, part=True)),
                 ["b_y", "c_y", "a_y", "e_b", "e_h", "hhv_biooil", "hhv_biochar"])
    targets = ["b_y", "c_y", "a_y", "e_b", "e_h", "hhv_biooil", "hhv_biochar"]
    rows = metrics.finite_pairs(metrics.long_targets(df, targets)).groupBy("target").agg(
        metrics.r2().alias("r2"), metrics.rmse().alias("rmse"))
    rows = rows.withColumn("category", metrics.target_category(F.col("target")))
    return rnd(rows.groupBy("category").agg(F.avg("r2").alias("mean_r2"), F.avg("rmse").alias("mean_rmse"),
                                            F.count("*").alias("n")), "mean_r2", "mean_rmse")


def distinct(spark, sf):
    """Shape of the table."""
    return metrics.shape(experiments(spark, sf, part=True), ["doi", "feedstock", "family", "temp_c"])


def frequency(spark, sf):
    """Category frequencies."""
    return metrics.frequency(experiments(spark, sf, part=True), "family")


def quality(spark, sf):
    """Missing values, ranges and outliers."""
    out = profile.quality_profile(experiments(spark, sf), ["temp_c", "ic", "ash", "a_y", "hhv_biooil"])
    return rnd(out, "min", "max", "q25", "q75")


def duplicates(spark, sf):
    """Repeated condition rows."""
    return profile.duplicate_rows(experiments(spark, sf), ["doi", "feedstock", "temp_c", "t_min"])


def correlation(spark, sf):
    """Pairwise correlations."""
    return rnd(profile.correlation_matrix(
        experiments(spark, sf), ["temp_c", "t_min", "ic", "ash", "b_y", "a_y", "hhv_biooil"]), "corr")


def bootstrap(spark, sf):
    """P5: confidence interval of the RMSE."""
    return rnd(profile.bootstrap_rmse(scored_rows(spark, sf)), "rmse", "lo", "hi")


_SPLIT = f"case when {bucket_sql('row_id')} < {int(0.2 * (1 << 32))} then 'test' else 'train' end"


def _long_sql(targets: list[str], table: str = "e") -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, '{t}' AS target, {t} AS y, {t} * cast('0.9' as double) + t_min / 20 AS p "
        f"FROM {table} WHERE {t} IS NOT NULL" for t in targets)


_LABELS = {"b_y": ("% w/w", "Bio-oil yield"), "c_y": ("% w/w", "Char yield"),
           "hhv_biooil": ("MJ/kg", "Bio-oil HHV"), "a_y": ("% w/w", "Aqueous / other yield")}
_IN = "p BETWEEN y * {lo} AND y * {hi}"
_HIT10 = _IN.format(lo="cast('0.9' as double)", hi="cast('1.1' as double)")
_HIT20 = _IN.format(lo="cast('0.8' as double)", hi="cast('1.2' as double)")
_NRMSE = f"{rmse_sql()} / nullif(max(y) - min(y), 0)"
_REP = 40
_EDGES = profile.poisson_edges()
_W = "case " + " ".join(f"when u < {e} then {i}" for i, e in enumerate(_EDGES)) + f" else {len(_EDGES)} end"
_PAIRS = [(a, b) for i, a in enumerate(["temp_c", "t_min", "ic", "ash", "b_y", "a_y", "hhv_biooil"])
          for b in ["temp_c", "t_min", "ic", "ash", "b_y", "a_y", "hhv_biooil"][i:]]
_SUMMARY = ["b_y", "e_b", "hhv_biooil", "c_biooil", "o_biooil", "c_biochar", "o_biochar"]
_CAT = {"b_y": "Yield", "e_b": "Energy", "hhv_biooil": "Bio-oil", "c_biooil": "Bio-oil",
        "o_biooil": "Bio-oil", "c_biochar": "Biochar", "o_biochar": "Biochar"}
_CASE = "case target " + " ".join(f"when '{t}' then '{c}'" for t, c in _CAT.items()) + " else 'Ratio' end"


def _ratio(phase: str) -> str:
    guess = "({c} * cast('0.9' as double) + t_min / 20)"
    o, c = f"o_{phase}", f"c_{phase}"
    return (f"SELECT row_id, 'o_c_{phase}' AS target, ({o} / 15.999) / ({c} / 12.011) AS y, "
            f"({guess.format(c=o)} / 15.999) / ({guess.format(c=c)} / 12.011) AS p FROM m")


_MEANS = ["b_y", "c_y", "a_y", "e_b", "e_h", "hhv_biooil", "hhv_biochar"]
_MEAN_CASE = ("case when target in ('b_y', 'c_y', 'a_y') then 'Yield' when target in ('e_b', 'e_h') "
              "then 'Energy' when target = 'hhv_biooil' then 'Bio-oil' else 'Biochar' end")

QUERIES = {
    "parity_metrics": (parity, with_s(
        f"SELECT count(*) AS n, {r6(_NRMSE)} AS nrmse, {r6(rmse_sql())} AS rmse, {r6(r2_sql())} AS r2, "
        f"{r6('avg(abs(y - p))')} AS mae FROM s")),
    "band_coverage": (band, with_s(
        f"SELECT 'relative' AS mode, count(*) AS n, count(*) FILTER ({_HIT10}) AS n_in_10, "
        f"{r6(f'avg(cast({_HIT10} as double))')} AS frac_10, count(*) FILTER ({_HIT20}) AS n_in_20, "
        f"{r6(f'avg(cast({_HIT20} as double))')} AS frac_20 FROM s UNION ALL "
        + "SELECT 'parallel', count(*), "
        + ", ".join(
            f"count(*) FILTER (p BETWEEN y - cast('{k}' as double) * m AND y + cast('{k}' as double) * m), "
            + r6(f"avg(cast(p BETWEEN y - cast('{k}' as double) * m AND y + cast('{k}' as double) * m as double))")
            for k in ("0.1", "0.2")) + " FROM s, (SELECT max(y) AS m FROM s)")),
    "parity_table": (parity_table, with_e(
        f", l AS (SELECT *, {_SPLIT} AS split FROM ({_long_sql(PARITY)})) "
        f"SELECT target, split, count(*) AS n, {r6(_NRMSE)} AS nrmse, {r6(rmse_sql())} AS rmse, "
        f"{r6(r2_sql())} AS r2, {r6(f'avg(cast({_HIT10} as double))')} AS frac_10, "
        f"{r6(f'avg(cast({_HIT20} as double))')} AS frac_20, "
        + "case target " + " ".join(f"when '{t}' then '{u}'" for t, (u, _) in _LABELS.items()) + " end AS units, "
        + "case target " + " ".join(f"when '{t}' then '{n}'" for t, (_, n) in _LABELS.items()) + " end AS label "
        "FROM l GROUP BY 1, 2")),
    "interval_report": (intervals, with_e(
        f", l AS ({_long_sql(PARITY)}) SELECT target, count(*) AS n, {r6(r2_sql())} AS r2, "
        f"{r6(rmse_sql())} AS rmse, {r6('avg(cast(y between p - 4 and p + 4 as double))')} AS coverage, "
        f"{r6('avg((p + 4) - (p - 4))')} AS mean_width, {r6('max((p + 4) - (p - 4))')} AS max_width FROM l GROUP BY 1")),
    "group_report": (by_family, with_s(
        f"SELECT family, count(*) AS n, {r6(r2_sql())} AS r2, {r6(rmse_sql())} AS rmse, "
        f"{r6('avg(cast(y between lo and hi as double))')} AS coverage, {r6('avg(hi - lo)')} AS width "
        "FROM s WHERE family IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")),
    "problem_groups": (by_paper, with_s(
        f"SELECT regexp_replace(lower(trim(doi)), '^(https://doi[.]org/|doi:)', '') AS doi, count(*) AS n, "
        f"{r6(r2_sql())} AS r2, {r6(rmse_sql())} AS rmse, "
        f"{r6('avg(cast(y between lo and hi as double))')} AS coverage FROM s GROUP BY 1 HAVING count(*) >= 3")),
    "result_summary": (summary, with_m(
        f", l AS ({_long_sql(_SUMMARY, 'm')} UNION ALL {_ratio('biooil')} UNION ALL {_ratio('biochar')}) "
        f"SELECT target, {_CASE} AS category, count(*) AS n, {r6(rmse_sql())} AS rmse_rf, {r6(r2_sql())} AS r2 "
        "FROM l GROUP BY 1")),
    "mean_scores": (mean_scores, with_m(
        f", l AS ({_long_sql(_MEANS, 'm')}), r AS (SELECT target, {r2_sql()} AS r2, {rmse_sql()} AS rmse FROM l "
        f"GROUP BY 1) SELECT {_MEAN_CASE} AS category, {r6('avg(r2)')} AS mean_r2, {r6('avg(rmse)')} AS mean_rmse, "
        "count(*) AS n FROM r GROUP BY 1")),
    "distinct_counts": (distinct, with_e(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct FROM e"
        for c in ("doi", "feedstock", "family", "temp_c")))),
    "family_frequency": (frequency, with_e(
        "SELECT family, count(*) AS n FROM e WHERE family IS NOT NULL GROUP BY 1")),
    "quality_profile": (quality, with_e(" UNION ALL ".join(
        f"SELECT '{c}' AS variable, 'double' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
        f"{r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, {r6('any_value(a)')} AS q25, {r6('any_value(b)')} AS q75, "
        f"count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_outliers FROM e, "
        f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM e)"
        for c in ("temp_c", "ic", "ash", "a_y", "hhv_biooil")))),
    "duplicate_rows": (duplicates, with_e(
        "SELECT doi, feedstock, temp_c, t_min, count(*) AS copies FROM e GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")),
    "correlation_matrix": (correlation, with_e(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"{r6(f'corr({a}, {b})')} AS corr FROM e" for a, b in _PAIRS))),
    "bootstrap_ci": (bootstrap, with_s(f"""
, h AS (SELECT g, md5('42|' || cast(g as string) || '|' || row_id) AS h, (y - p) * (y - p) AS e
 FROM s, unnest(range({_REP // 8})) r(g)),
 u AS (SELECT g * 8 + j AS rep, e, cast(('0x' || substr(h, 1 + 4 * cast(j as integer), 4)) as bigint) AS u FROM h, unnest(range(8)) r(j)),
 w AS (SELECT rep, e, {_W} AS w FROM u),
 b AS (SELECT rep, sqrt(sum(w * e) / sum(w)) AS v FROM w GROUP BY 1)
SELECT {r6('(SELECT sqrt(avg((y - p) * (y - p))) FROM s)')} AS rmse, {r6('quantile_cont(v, 0.025)')} AS lo,
 {r6('quantile_cont(v, 0.975)')} AS hi, count(*) AS replicates FROM b""")),
}
