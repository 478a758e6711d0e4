"""Response surfaces over (paper, feedstock) blocks, and composition diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import (
    bucket_sql, experiments, r2_sql, r6, rmse_sql, rnd, with_e,
)
from uqframe.operators import splits, surfaces
from uqframe.operators.surfaces import BLOCK, MOMENTS, RESPONSES, TERMS
from uqframe.plans.surfaces import ratio_surface_report, surface_report

LABELLED = ["b_y", "c_y", "hhv_biooil", "c_biooil", "o_biochar"]


def predicted(df):
    """An arithmetic model whose best temperature lies inside the data."""
    t, m = (F.col("temp_c") - 300) / 100, (F.col("t_min") - 18) / 10
    p = F.lit(30.0) - t * t * 8 - m * m * 3 + t * m * 2 + F.col("o_c") * 4
    return df.withColumn("p_b_y", p)


def points(spark, sf, part=False):
    return surfaces.block_rows(predicted(experiments(spark, sf, part)), "temp_c", "t_min", "b_y", "p_b_y")


def candidates(spark, sf):
    """M1: blocks with enough rows and spread."""
    return rnd(surfaces.block_candidates(experiments(spark, sf), "b_y"), "temp_c_span")


def top(spark, sf):
    """The report's blocks."""
    found = surfaces.block_candidates(experiments(spark, sf), "b_y", min_points=8)
    return surfaces.top_blocks(found, "b_y", 10).select(*BLOCK, "n_points", "b_y_span")


def tags(spark, sf):
    """M9: first encoding set in the block."""
    return surfaces.block_tags(experiments(spark, sf))


def block_rows(spark, sf):
    """M3: rows of the blocks with residuals."""
    df = predicted(experiments(spark, sf))
    out = surfaces.block_rows(df, "temp_c", "t_min", "b_y", "p_b_y", keep=["row_id"])
    return rnd(out, "y_fit", "residual")


def moments(spark, sf):
    """M2: the sums behind every block's surface."""
    out = surfaces.block_moments(points(spark, sf))
    names = [f"m{a}{b}" for a, b in MOMENTS] + [f"r{a}{b}" for a, b in RESPONSES]
    return rnd(out.select(*BLOCK, "n_points", *names), *names, digits=4)


def fits(spark, sf):
    """M2: every block's surface, as its value at three points of the block."""
    out = surfaces.fit_surfaces(points(spark, sf))
    spots = {"z_low": ("x_min", "y_min"), "z_high": ("x_max", "y_max"), "z_mid": ("x_mid", "y_mid")}
    return out.select(*BLOCK, "n_points", "full_rank", *[
        F.round(surfaces.surface_value(F.col(x), F.col(y)), 4).alias(n) for n, (x, y) in spots.items()])


def fit_metrics(spark, sf):
    """M7: errors of the model inside each block."""
    return rnd(surfaces.block_metrics(points(spark, sf)), "rmse", "r2")


def report(spark, sf):
    """Surfaces and optima of the report's blocks."""
    out = surface_report(predicted(experiments(spark, sf)), "b_y", "p_b_y", digits=9)
    return rnd(out, "z_min", "z_max", "x_opt", "y_opt", "z_opt", "rmse", "r2", digits=4)


def grid(spark, sf):
    """The padded grid of every block's surface, summed up."""
    fitted = surfaces.fit_surfaces(points(spark, sf))
    cells = surfaces.surface_grid(fitted, "b_y", n_grid=20)
    out = cells.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
                                    F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
                                    F.avg("z").alias("mean_z"))
    return rnd(out, "x_lo", "x_hi", "y_lo", "y_hi", "mean_z", digits=4)


def ratio_report(spark, sf):
    """A ratio target from element predictions."""
    df = experiments(spark, sf, part=True)
    df = df.withColumns({"p_o_biooil": F.col("o_biooil") + (F.col("temp_c") - 280) / 40,
                         "p_c_biooil": F.col("c_biooil") - F.col("t_min") / 10})
    out = ratio_surface_report(df, "o_c_biooil", digits=9)
    return rnd(out, "z_min", "z_max", "x_opt", "y_opt", "z_opt", "rmse", "r2", digits=4)


def labels(spark, sf):
    """Units and labels of targets with data."""
    df = experiments(spark, sf, part=True)
    counts = df.agg(*[F.count(t).alias(t) for t in LABELLED]).unpivot([], LABELLED, "target", "n")
    return surfaces.with_target_labels(counts, LABELLED)


def composed(spark, sf):
    df = splits.split_rows(experiments(spark, sf, part=True))
    df = df.withColumns({
        "o_c_biochar": F.col("o_biochar") / 15.999 / (F.col("c_biochar") / 12.011),
        "h_c_biochar": F.col("h_biochar") / 1.008 / (F.col("c_biochar") / 12.011)})
    return df.withColumn("h_c_biochar", F.when(F.col("ic").isNotNull(), F.col("h_c_biochar")))


def composition(spark, sf):
    """Feedstock and product points of one subtype."""
    pts = surfaces.composition_points(composed(spark, sf), "subtype_htc", "biochar")
    return rnd(surfaces.composition_summary(pts), "mean_o_c", "mean_h_c", "x_lo", "x_hi", "y_lo", "y_hi")


def margins(spark, sf):
    """Marginal distributions of the test part."""
    pts = surfaces.composition_points(composed(spark, sf), "subtype_htc", "biochar", "test")
    return rnd(surfaces.composition_margins(pts), "density")


_P = ("cast(30 as double) - ((temp_c - 300) / 100) * ((temp_c - 300) / 100) * 8 "
      "- ((t_min - 18) / 10) * ((t_min - 18) / 10) * 3 + ((temp_c - 300) / 100) * ((t_min - 18) / 10) * 2 + o_c * 4")
_CAND = ("SELECT doi, feedstock, count(*) AS n_points, min(temp_c) AS temp_c_min, max(temp_c) AS temp_c_max, "
         "min(t_min) AS t_min_min, max(t_min) AS t_min_max, min(b_y) AS b_y_min, max(b_y) AS b_y_max, "
         "max(temp_c) - min(temp_c) AS temp_c_span, max(t_min) - min(t_min) AS t_min_span, "
         "max(b_y) - min(b_y) AS b_y_span FROM e GROUP BY 1, 2 HAVING count(*) >= {n} "
         "AND max(temp_c) - min(temp_c) >= 10 AND max(t_min) - min(t_min) >= 10")


def _power(c: str, n: int) -> str:
    return " * ".join([c] * n) if n else "1"


def _mono(a: int, b: int) -> str:
    return f"{_power('ux', a)} * {_power('uy', b)}"


_MOM = ", ".join([f"sum(cast({_mono(a, b)} as double)) AS m{a}{b}" for a, b in MOMENTS]
                 + [f"sum(p * {_mono(a, b)}) AS r{a}{b}" for a, b in RESPONSES])


def _solve_cte(source: str) -> str:
    """Per block: Cholesky of the centred normal matrix, column by column, then two solves."""
    sums = ", ".join(
        [f"sum(cast({_mono(TERMS[i][0] + TERMS[j][0], TERMS[i][1] + TERMS[j][1])} as double)) / count(*) AS a{i}{j}"
         for i in range(6) for j in range(i + 1)]
        + [f"sum(p * {_mono(*TERMS[i])}) / count(*) AS g{i}" for i in range(6)])
    out = f""", bl AS (SELECT doi, feedstock, count(*) AS n_points, avg(temp_c) AS mx, avg(t_min) AS my,
 stddev_pop(temp_c) AS sx, stddev_pop(t_min) AS sy, min(temp_c) AS x0, max(temp_c) AS x1, min(t_min) AS y0,
 max(t_min) AS y1 FROM {source} GROUP BY 1, 2 HAVING count(*) >= 6),
 u AS (SELECT doi, feedstock, (temp_c - mx) / sx AS ux, (t_min - my) / sy AS uy, p FROM {source}
 JOIN bl USING (doi, feedstock)),
 c0 AS (SELECT doi, feedstock, {sums} FROM u GROUP BY 1, 2)"""
    last = "c0"
    for j in range(6):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        out += f", d{j} AS (SELECT *, sqrt(a{j}{j}{inner}) AS l{j}{j} FROM {last})"
        below = ", ".join(
            f"(a{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}"
            for i in range(j + 1, 6))
        y = f"(g{j}" + "".join(f" - l{j}{k} * f{k}" for k in range(j)) + f") / l{j}{j} AS f{j}"
        out += f", c{j + 1} AS (SELECT *, {y}{', ' + below if below else ''} FROM d{j})"
        last = f"c{j + 1}"
    for j in reversed(range(6)):
        back = f"(f{j}" + "".join(f" - l{i}{j} * b{i}" for i in range(j + 1, 6)) + f") / l{j}{j} AS b{j}"
        out += f", s{j} AS (SELECT *, {back} FROM {last})"
        last = f"s{j}"
    return out + ", fit AS (SELECT * FROM s0 JOIN bl USING (doi, feedstock)) "


def _z(x: str, y: str) -> str:
    u, v = f"(({x} - mx) / sx)", f"(({y} - my) / sy)"
    return f"b0 + b1 * {u} + b2 * {v} + b3 * {u} * {u} + b4 * {u} * {v} + b5 * {v} * {v}"


_FIT = f", pr AS (SELECT *, {_P} AS p FROM e)" + _solve_cte("pr")


def _grid(n: int) -> str:
    return (f"(SELECT *, x0 - 0.05 * (x1 - x0) + ix * (1.1 * (x1 - x0) / {n - 1}) AS gx, "
            f"y0 - 0.05 * (y1 - y0) + iy * (1.1 * (y1 - y0) / {n - 1}) AS gy FROM fit, unnest(range({n})) t(ix), "
            f"unnest(range({n})) s(iy))")


def _report_sql(target: str, prediction: str, low: int, high: int, units: str, label: str) -> str:
    """The whole report: top blocks, surfaces, first best grid point, errors and tags."""
    order = f"count(*) DESC, max({target}) - min({target}) DESC, doi, feedstock"
    return with_e(f"""
, al AS (SELECT *, {prediction} AS p FROM e),
 tb AS (SELECT doi, feedstock FROM al WHERE {target} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8
 AND max(temp_c) - min(temp_c) >= 10 AND max(t_min) - min(t_min) >= 10 ORDER BY {order} LIMIT 10),
 pr AS (SELECT al.* FROM al JOIN tb USING (doi, feedstock)){_solve_cte('pr')}
, gz AS (SELECT *, least(greatest({_z('gx', 'gy')}, {low}), {high}) AS z FROM {_grid(80)}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doi, feedstock ORDER BY round(z, 9) DESC, iy, ix) AS rn,
 min(z) OVER (PARTITION BY doi, feedstock) AS z_min, max(z) OVER (PARTITION BY doi, feedstock) AS z_max FROM gz),
 er AS (SELECT doi, feedstock, {rmse_sql(target)} AS rmse, {r2_sql(target)} AS r2,
 case when max(cat_acid) > 0 then 'acid' when max(cat_metal) > 0 then 'metal'
 when max(cat_is_base) > 0 then 'is_base' else 'none' end AS catalyst,
 case when max(solv_ethanol) > 0 then 'ethanol' when max(solv_methanol) > 0 then 'methanol' else 'water' end AS solvent,
 case when max(subtype_htc) > 0 then 'htc' else '' end AS subtype FROM pr GROUP BY 1, 2)
SELECT rk.doi, rk.feedstock, n_points, x0 AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max, true AS full_rank,
 round(z_min, 4) AS z_min, round(z_max, 4) AS z_max, round(gx, 4) AS x_opt, round(gy, 4) AS y_opt, round(z, 4) AS z_opt,
 case when least((gx - x0) / (x1 - x0), (x1 - gx) / (x1 - x0), (gy - y0) / (y1 - y0), (y1 - gy) / (y1 - y0)) > 0.15
 then 'interior' else 'edge' end AS opt_location, round(rmse, 4) AS rmse, round(r2, 4) AS r2, catalyst, solvent, subtype,
 '{target}' AS target, '{units}' AS units, '{label}' AS label
FROM rk JOIN er USING (doi, feedstock) WHERE rn = 1""")


_RATIO_P = ("((o_biooil + (temp_c - 280) / 40) / 15.999) / ((c_biooil - t_min / 10) / 12.011)")
_TRAIN = f"{bucket_sql('row_id')} >= {int(0.2 * (1 << 32))}"
_COMP = (", c AS (SELECT row_id, o_c, h_c, o_biochar / 15.999 / (c_biochar / 12.011) AS po, "
         "case when ic is not null then h_biochar / 1.008 / (c_biochar / 12.011) end AS ph, "
         f"{_TRAIN} AS is_train FROM e WHERE subtype_htc = 1)")
_PTS = (" pt AS (SELECT 'feedstock' AS part, o_c, h_c FROM c {w} UNION ALL "
        "SELECT 'biochar', po, ph FROM c WHERE ph IS NOT NULL {a})")
_LABELS = {"b_y": ("% w/w", "Bio-oil yield"), "c_y": ("% w/w", "Char yield"), "hhv_biooil": ("MJ/kg", "Bio-oil HHV"),
           "c_biooil": ("wt %", "Carbon in bio-oil (wt%)"), "o_biochar": ("wt %", "Oxygen in biochar (wt%)")}

QUERIES = {
    "rsm_candidates": (candidates, with_e(_CAND.format(n=6))),
    "rsm_topk": (top, with_e(", c AS (" + _CAND.format(n=8) + ") SELECT doi, feedstock, n_points, b_y_span FROM c "
                             "ORDER BY n_points DESC, b_y_span DESC, doi, feedstock LIMIT 10")),
    "rsm_tags": (tags, with_e(
        "SELECT doi, feedstock, case when max(cat_acid) > 0 then 'acid' when max(cat_metal) > 0 then 'metal' "
        "when max(cat_is_base) > 0 then 'is_base' else 'none' end AS catalyst, case when max(solv_ethanol) > 0 "
        "then 'ethanol' when max(solv_methanol) > 0 then 'methanol' else 'water' end AS solvent, "
        "case when max(subtype_htc) > 0 then 'htc' else '' end AS subtype FROM e GROUP BY 1, 2")),
    "rsm_block_rows": (block_rows, with_e(
        f"SELECT doi, feedstock, row_id, temp_c AS x, t_min AS y, b_y AS y_exp, round({_P}, 6) AS y_fit, "
        f"round(b_y - ({_P}), 6) AS residual FROM e")),
    "rsm_moments": (moments, with_e(f"""
, f AS (SELECT avg(temp_c) AS mx, stddev_pop(temp_c) AS sx, avg(t_min) AS my, stddev_pop(t_min) AS sy FROM e),
 u AS (SELECT doi, feedstock, (temp_c - mx) / sx AS ux, (t_min - my) / sy AS uy, {_P} AS p FROM e, f),
 s AS (SELECT doi, feedstock, count(*) AS n_points, {_MOM} FROM u GROUP BY 1, 2)
SELECT doi, feedstock, n_points, """ + ", ".join(
        f"round({n}, 4) AS {n}" for n in [f"m{a}{b}" for a, b in MOMENTS] + [f"r{a}{b}" for a, b in RESPONSES]) + " FROM s")),
    "rsm_surfaces": (fits, with_e(_FIT + f"""
SELECT doi, feedstock, n_points, true AS full_rank, round({_z('x0', 'y0')}, 4) AS z_low,
 round({_z('x1', 'y1')}, 4) AS z_high, round(b0, 4) AS z_mid FROM fit""")),
    "rsm_fit_metrics": (fit_metrics, with_e(
        f", l AS (SELECT *, b_y AS y, {_P} AS p FROM e) SELECT doi, feedstock, count(*) AS n, "
        f"{r6(rmse_sql())} AS rmse, {r6(r2_sql())} AS r2 FROM l GROUP BY 1, 2")),
    "rsm_surface_optimum": (report, _report_sql("b_y", _P, 0, 100, "% w/w", "Bio-oil yield")),
    "rsm_grid": (grid, with_e(_FIT + f"""
SELECT doi, feedstock, count(*) AS n, round(min(gx), 4) AS x_lo, round(max(gx), 4) AS x_hi, round(min(gy), 4) AS y_lo,
 round(max(gy), 4) AS y_hi, round(avg(least(greatest({_z('gx', 'gy')}, 0), 100)), 4) AS mean_z FROM {_grid(20)} GROUP BY 1, 2""")),
    "rsm_ratio_optimum": (ratio_report, _report_sql(
        "o_c_biooil", _RATIO_P, 0, 3, "mol/mol", "O/C (bio-oil)").replace(
        "al AS (SELECT *,", "al AS (SELECT *, (o_biooil / 15.999) / (c_biooil / 12.011) AS o_c_biooil,")),
    "target_labels": (labels, with_e(" UNION ALL ".join(
        f"SELECT '{t}' AS target, count({t}) AS n, '{u}' AS units, '{n}' AS label FROM e" for t, (u, n) in _LABELS.items()))),
    "composition_diagram": (composition, with_e(_COMP + "," + _PTS.format(w="", a="") + """
, s AS (SELECT min(o_c) AS a, max(o_c) AS b, min(h_c) AS c, max(h_c) AS d FROM pt)
SELECT part, count(*) AS n, round(avg(o_c), 6) AS mean_o_c, round(avg(h_c), 6) AS mean_h_c,
 round(any_value(a) - 0.05 * (any_value(b) - any_value(a)), 6) AS x_lo, round(any_value(b) + 0.05 * (any_value(b) - any_value(a)), 6) AS x_hi,
 round(greatest(0, any_value(c) - 0.05 * (any_value(d) - any_value(c))), 6) AS y_lo,
 round(any_value(d) + 0.05 * (any_value(d) - any_value(c)), 6) AS y_hi FROM pt, s GROUP BY 1""")),
    "composition_margins": (margins, with_e(
        _COMP + "," + _PTS.format(w="WHERE NOT is_train", a="AND NOT is_train")
        + ", l AS (SELECT part, 'o_c' AS axis, o_c AS v FROM pt UNION ALL SELECT part, 'h_c', h_c FROM pt), "
        "s AS (SELECT part, axis, min(v) AS a, max(v) AS b, count(*) AS n FROM l GROUP BY 1, 2) "
        "SELECT part, axis, cast(least(floor((v - a) / (b - a) * 20), 19) as integer) AS bin, count(*) AS cnt, "
        "round(count(*) / (any_value(n) * ((any_value(b) - any_value(a)) / 20)), 6) AS density "
        "FROM l JOIN s USING (part, axis) GROUP BY 1, 2, 3")),
}
