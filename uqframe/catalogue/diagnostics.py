"""Conformal widths, residual distributions, densities and uncertainty maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import bucket_sql, experiments, number, r6, rnd, scored, with_s
from uqframe.functions.exprs import z_value
from uqframe.operators import intervals, metrics, splits

GRID = [(i - 0.5) / 99 for i in range(1, 100)]


def rows(spark, sf, part=False):
    df = splits.split_rows(scored(experiments(spark, sf, part)))
    return df.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))


def conformal(spark, sf):
    """Widths from one part per feedstock, intervals on the other."""
    df = rows(spark, sf)
    resid = intervals.conformal_residuals(df.where("is_train"), ["feedstock"])
    width = intervals.conformal_width(resid, 0.10, ["feedstock"])
    test = intervals.global_conformal(df.where("is_test").drop("lo", "hi"), width, ["feedstock"])
    out = test.groupBy("feedstock").agg(
        F.count("*").alias("n"), F.avg(metrics.covered()).alias("coverage"),
        F.avg(F.col("hi") - F.col("lo")).alias("width"))
    return rnd(out.join(width, "feedstock"), "coverage", "width", "q")


def conformal_finite(spark, sf):
    """H3: the finite-sample quantile over all rows."""
    resid = intervals.conformal_residuals(rows(spark, sf), [])
    return rnd(intervals.conformal_width(resid, 0.10, [], finite_sample=True), "q")


def curve(spark, sf):
    """H9: coverage of intervals of every level."""
    df = rows(spark, sf)
    resid = intervals.conformal_residuals(df.where("is_train"), [])
    return rnd(metrics.coverage_curve(df.where("is_test"), resid), "nominal", "achieved")


def width_curve(spark, sf):
    """H9 as published: truth against percentiles of the widths."""
    df = rows(spark, sf).withColumn("hi", F.col("lo") + F.col("y") + F.col("t_min"))
    return rnd(metrics.width_percentile_curve(df), "nominal", "achieved")


def qq(spark, sf):
    """Quantiles of standardised residuals against the normal's."""
    out = metrics.qq_grid(metrics.standardized_residuals(rows(spark, sf)))
    return rnd(out, "prob", "sample_q", "normal_q")


def qq_positions(spark, sf):
    """Every sorted residual with its positions."""
    df = rows(spark, sf).withColumn("err", F.round(F.col("p") - F.col("y"), 6))
    return rnd(metrics.qq_runs(df, "err"), "prob_first", "prob_last", digits=9)


def residuals(spark, sf):
    """Histogram of standardised residuals with the normal density."""
    df = rows(spark, sf).withColumn("p", F.col("p") + F.col("hhv_biooil") / 7)
    return rnd(metrics.residual_histogram(df), "low", "high", "density", "normal")


def boxes(spark, sf):
    """Box statistics per family."""
    out = metrics.family_boxes(rows(spark, sf, part=True).withColumn("hi", F.col("hi") + F.col("t_min")))
    return rnd(out.drop("std_samp", "low", "high", "min", "max"), "mean", "std_pop", "q25", "median", "q75", "shade")


def column_boxes(spark, sf):
    """Box statistics per column."""
    return rnd(metrics.box_stats(experiments(spark, sf), ["temp_c", "a_y", "hhv_biooil"]).drop("std_pop"),
               "mean", "std_samp", "min", "max", "q25", "median", "q75", "low", "high")


def landscape(spark, sf):
    """Interval width over two coordinates."""
    df = rows(spark, sf).withColumn("hi", F.col("hi") + F.col("t_min"))
    return rnd(metrics.uncertainty_landscape(df, "o_c", "temp_c"), "mean_width")


def width_summary(spark, sf):
    """One row of width statistics."""
    df = rows(spark, sf).withColumn("hi", F.col("hi") + F.col("hhv_biooil"))
    return rnd(metrics.uncertainty_summary(df), "mean", "median", "min", "max")


def residual_intervals(spark, sf):
    """Intervals from the spread of the training residuals."""
    df = rows(spark, sf)
    out = metrics.residual_interval(df.where("is_test"), df.where("is_train"))
    return rnd(out.select("row_id", "lo", "hi"), "lo", "hi")


def line(spark, sf):
    """Fitted parity line with its confidence band."""
    return rnd(metrics.fitted_line(rows(spark, sf).withColumn("p", F.col("p") + F.col("t_min"))),
               "x", "fit", "lo", "hi")


def density(spark, sf):
    """Kernel density per split."""
    return rnd(metrics.density_curve(rows(spark, sf), "b_y", ["split"], 300), "x", "density", digits=9)


def density_of_heats(spark, sf):
    """Kernel density of a column whose values nearly all differ."""
    return rnd(metrics.density_curve(rows(spark, sf), "hhv_biooil", ["split"], 60), "x", "density", digits=9)


def window(spark, sf):
    """Common support of the splits."""
    return rnd(metrics.overlap_window(rows(spark, sf)), "lo", "hi")


_R = (with_s(f", r AS (SELECT *, case when {bucket_sql('row_id')} < {int(0.2 * (1 << 32))} "
             "then 'test' else 'train' end AS split FROM s) "))
_LEVELS = metrics.nominal_levels(10)
_Z = (f", z AS (SELECT (p - y) / (sd + {number(1e-9)}) AS z FROM r, "
      "(SELECT stddev_samp(p - y) AS sd FROM r)) ")


def _box_sql(name: str, value: str) -> str:
    q = ", ".join(f"quantile_cont({value}, {p}) AS {n}"
                  for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
    return (f"SELECT family, '{name}' AS variable, count(*) AS n, avg({value}) AS mean, "
            f"stddev_pop({value}) AS std_pop, {q} FROM r WHERE family IS NOT NULL GROUP BY 1")


_WIDE = "(hi + t_min - lo)"
_BIN = ("cast(least(floor(({v} - min({v}) over ()) / (max({v}) over () - min({v}) over ()) * 20), 19) as integer)")
_LINE = """, f AS (SELECT split, count(*) AS n, regr_slope(p + t_min, y) AS b, regr_intercept(p + t_min, y) AS a,
 regr_sxx(p + t_min, y) AS sxx, regr_syy(p + t_min, y) AS syy, avg(y) AS mid, min(y) AS lo_y, max(y) AS hi_y FROM r GROUP BY 1),
 g AS (SELECT *, cast(i as integer) AS k, lo_y + (hi_y - lo_y) * i / cast(49 as double) AS x FROM f, unnest(range(50)) t(i)),
 h AS (SELECT *, """ + number(z_value(0.975)) + """ * sqrt(greatest(syy - b * b * sxx, 0) / (n - 2))
 * sqrt(1.0 / n + (x - mid) * (x - mid) / sxx) AS half FROM g)
SELECT split, k AS i, round(x, 6) AS x, round(a + b * x, 6) AS fit, round(a + b * x - half, 6) AS lo,
 round(a + b * x + half, 6) AS hi FROM h"""

QUERIES = {
    "global_conformal": (conformal, _R + f"""
, q AS (SELECT feedstock, quantile_cont(abs(y - p), 0.9) AS q, count(*) AS n_resid FROM r WHERE split = 'train' GROUP BY 1)
SELECT feedstock, count(*) AS n, {r6('avg(cast(y between p - q and p + q as double))')} AS coverage,
 {r6('avg((p + q) - (p - q))')} AS width, {r6('any_value(q)')} AS q, any_value(n_resid) AS n_resid
FROM r JOIN q USING (feedstock) WHERE split = 'test' GROUP BY 1"""),
    "conformal_finite_sample": (conformal_finite, _R + """
, o AS (SELECT abs(y - p) AS v, row_number() over (order by abs(y - p)) AS i, count(*) over () AS n FROM r)
SELECT round(v, 6) AS q, n AS n_resid FROM o WHERE i = least(ceil((n + 1) * cast('0.9' as double)), n)"""),
    "coverage_curve": (curve, _R + ", c AS (" + " UNION ALL ".join(
        f"SELECT {number(p)} AS nominal, (SELECT quantile_cont(abs(y - p), {p!r}) FROM r WHERE split = 'train') AS q"
        for p in _LEVELS) + f""") SELECT {r6('nominal')} AS nominal, {r6('avg(cast(abs(y - p) <= q as double))')} AS achieved
 FROM r, c WHERE split = 'test' GROUP BY c.nominal"""),
    "width_percentile_curve": (width_curve, _R + ", w AS (SELECT y, lo + y + t_min - lo AS width FROM r), c AS ("
        + " UNION ALL ".join(
            f"SELECT {number(p)} AS nominal, (SELECT quantile_cont(width, {round((1 - p) / 2, 12)!r}) FROM w) AS a, "
            f"(SELECT quantile_cont(width, {round((1 + p) / 2, 12)!r}) FROM w) AS b" for p in _LEVELS)
        + f""") SELECT {r6('nominal')} AS nominal, {r6('avg(cast(y between a and b as double))')} AS achieved
 FROM w, c GROUP BY c.nominal"""),
    "qq_grid": (qq, _R + _Z + " UNION ALL ".join(
        f"SELECT {r6(number(p))} AS prob, {r6(f'quantile_cont(z, {p!r})')} AS sample_q, "
        f"{r6(number(z_value(p)))} AS normal_q FROM z" for p in GRID)),
    "qq_positions": (qq_positions, _R + """
, v AS (SELECT round(p - y, 6) AS value FROM r), c AS (SELECT value, count(*) AS c FROM v GROUP BY 1),
 u AS (SELECT value, c, sum(c) OVER (ORDER BY value) AS up, sum(c) OVER () AS n FROM c)
SELECT value, cast(up - c + 1 as bigint) AS first, cast(up as bigint) AS last,
 round((up - c + 1 - 0.5) / cast(n as double), 9) AS prob_first, round((up - 0.5) / cast(n as double), 9) AS prob_last FROM u"""),
    "residual_histogram": (residuals, _R + f"""
, x AS (SELECT y, p + hhv_biooil / 7 AS p FROM r),
 z AS (SELECT (p - y) / (sd + {number(1e-9)}) AS z FROM x, (SELECT stddev_samp(p - y) AS sd FROM x)),
 m AS (SELECT min(z) AS a, max(z) AS b, count(*) AS n FROM z),
 c AS (SELECT cast(least(floor((z - a) / (b - a) * 30), 29) as integer) AS bin, count(*) AS cnt FROM z, m GROUP BY 1),
 f AS (SELECT cast(i as integer) AS bin, a + i * ((b - a) / 30) AS low, a + (i + 1) * ((b - a) / 30) AS high,
 coalesce(cnt, 0) AS cnt, coalesce(cnt, 0) / (n * ((b - a) / 30)) AS density FROM m, unnest(range(30)) t(i)
 LEFT JOIN c ON c.bin = i)
SELECT bin, round(low, 6) AS low, round(high, 6) AS high, cnt, round(density, 6) AS density,
 round(exp(-0.5 * ((low + high) / 2) * ((low + high) / 2)) / sqrt(2 * pi()), 6) AS normal FROM f"""),
    "box_stats_by_family": (boxes, _R + f"""
, b AS ({_box_sql('error', '(p - y)')} UNION ALL {_box_sql('width', _WIDE)}),
 k AS (SELECT variable, min(abs(mean)) AS a, max(abs(mean)) AS b FROM b GROUP BY 1)
SELECT family, variable, n, round(mean, 6) AS mean, round(std_pop, 6) AS std_pop, round(q25, 6) AS q25,
 round(median, 6) AS median, round(q75, 6) AS q75,
 round((abs(mean) - k.a) / (k.b - k.a), 6) AS shade FROM b JOIN k USING (variable)"""),
    "box_stats": (column_boxes, _R + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std_samp, "
        f"{r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, " + ", ".join(
            f"{r6(f'quantile_cont({c}, {p})')} AS {n}" for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
        + f", {r6(f'avg({c}) - 1.5 * stddev_samp({c})')} AS low, {r6(f'avg({c}) + 1.5 * stddev_samp({c})')} AS high FROM r"
        for c in ("temp_c", "a_y", "hhv_biooil"))),
    "uncertainty_landscape": (landscape, _R + f"""
, b AS (SELECT {_BIN.format(v='o_c')} AS x_bin, {_BIN.format(v='temp_c')} AS y_bin, {_WIDE} AS w FROM r)
SELECT x_bin, y_bin, count(*) AS n, {r6('avg(w)')} AS mean_width FROM b GROUP BY 1, 2"""),
    "uncertainty_summary": (width_summary, _R + ", w AS (SELECT hi + hhv_biooil - lo AS w FROM r) "
        f"SELECT {r6('avg(w)')} AS mean, {r6('quantile_cont(w, 0.5)')} AS median, {r6('min(w)')} AS min, "
        f"{r6('max(w)')} AS max FROM w"),
    "residual_intervals": (residual_intervals, _R + f"""
, d AS (SELECT stddev_samp(y - p) * {number(z_value(0.975))} AS half FROM r WHERE split = 'train')
SELECT row_id, round(p - half, 6) AS lo, round(p + half, 6) AS hi FROM r, d WHERE split = 'test'"""),
    "fitted_line": (line, _R + _LINE),
    "density_curve": (density, _R + """
, k AS (SELECT split, count(*) AS n, stddev_samp(b_y) * pow(count(*), cast('-0.2' as double)) AS h FROM r GROUP BY 1),
 g AS (SELECT cast(i as integer) AS i, lo + (hi - lo) * i / cast(299 as double) AS x
 FROM (SELECT min(b_y) AS lo, max(b_y) AS hi FROM r), unnest(range(300)) t(i)),
 c AS (SELECT split, b_y AS v, count(*) AS c FROM r GROUP BY 1, 2)
SELECT c.split, g.i, round(any_value(x), 9) AS x,
 round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / sqrt(2 * pi()) / h) / any_value(n), 9) AS density
FROM c JOIN k ON c.split = k.split, g GROUP BY 1, 2"""),
    "density_of_heats": (density_of_heats, _R + """
, k AS (SELECT split, count(*) AS n, stddev_samp(hhv_biooil) * pow(count(*), cast('-0.2' as double)) AS h FROM r GROUP BY 1),
 g AS (SELECT cast(i as integer) AS i, lo + (hi - lo) * i / cast(59 as double) AS x
 FROM (SELECT min(hhv_biooil) AS lo, max(hhv_biooil) AS hi FROM r), unnest(range(60)) t(i)),
 c AS (SELECT split, hhv_biooil AS v, count(*) AS c FROM r GROUP BY 1, 2)
SELECT c.split, g.i, round(any_value(x), 9) AS x,
 round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / sqrt(2 * pi()) / h) / any_value(n), 9) AS density
FROM c JOIN k ON c.split = k.split, g GROUP BY 1, 2"""),
    "overlap_window": (window, _R + """
, q AS (SELECT split, quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS b FROM r GROUP BY 1)
SELECT round(max(a), 6) AS lo, round(min(b), 6) AS hi, true AS overlap FROM q"""),
}
