"""Metrics and reports over a scored frame: truth ``y``, prediction ``p`` and, where there
are intervals, ``lo`` and ``hi``. Every report is one grouped aggregate."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from uqframe.constants import (
    ATOMIC_WEIGHTS, ATOMIC_WEIGHTS_ROUNDED, BIOCHAR, BIOOIL, ENERGY_CARBON, RATIOS, YIELDS,
)
from uqframe.functions.exprs import (
    atomic_ratio, bin_number, finite, normal_density, student_quantile, z_value,
)
from uqframe.operators.quantiles import (
    exact_quantiles, long_values, quantile_columns, value_code,
)
from uqframe.operators.skew import attach, with_facts
from uqframe.sources.session import cut_lineage


def finite_pairs(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    out = df.withColumns({y: finite(F.col(y).cast("double")), p: finite(F.col(p).cast("double"))})
    return out.where(F.col(y).isNotNull() & F.col(p).isNotNull())


def rmse(y: str = "y", p: str = "p") -> Column:
    d = F.col(y) - F.col(p)
    return F.sqrt(F.avg(d * d))


def mae(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2(y: str = "y", p: str = "p") -> Column:
    """1 - SSE/SST over non-null pairs. Null for fewer than two rows; a constant truth
    gives 1 for perfect predictions and 0 otherwise."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    d = F.col(y) - F.col(p)
    n, sse = F.count(F.when(both, 1)), F.sum(d * d)
    sst = F.var_pop(F.when(both, F.col(y))) * n
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n < 2, None).when(sst == 0, flat).otherwise(F.lit(1.0) - F.try_divide(sse, sst))


def nrmse(y: str = "y", p: str = "p") -> Column:
    span = F.max(y) - F.min(y)
    return F.when(span > 0, F.try_divide(rmse(y, p), span))


def covered(y: str = "y", lo: str = "lo", hi: str = "hi") -> Column:
    """1 inside the closed interval, 0 outside or without an interval."""
    inside = F.coalesce(F.col(y).between(F.col(lo), F.col(hi)), F.lit(False))
    return inside.cast("double")


def parity_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return finite_pairs(df).groupBy(*by).agg(
        F.count("*").alias("n"), nrmse().alias("nrmse"), rmse().alias("rmse"), r2().alias("r2"),
        mae().alias("mae"))


def in_band(rel: float, mode: str = "relative", reference: Column | None = None) -> Column:
    """Whether the prediction lies within ``rel`` of the truth, or of a reference scale."""
    y, p = F.col("y"), F.col("p")
    if mode == "relative":
        low, high = y * F.lit(1.0 - rel), y * F.lit(1.0 + rel)
    else:
        low, high = y - F.lit(rel) * reference, y + F.lit(rel) * reference
    return p.between(low, high)


def band_coverage(df: DataFrame, rels: list[float] = (0.10, 0.20), mode: str = "relative",
                  by: list[str] = ()) -> DataFrame:
    """(by…, n, n_in_<pct>, frac_<pct>…). The parallel band scales with the largest finite
    truth of the whole frame."""
    pairs = finite_pairs(df)
    reference = None
    if mode != "relative":
        pairs = with_facts(pairs, pairs.agg(F.max("y").alias("_ref")))
        reference = F.col("_ref")
    parts = [F.count("*").alias("n")]
    for rel in rels:
        hit, pct = in_band(rel, mode, reference), round(rel * 100)
        parts += [F.count_if(hit).alias(f"n_in_{pct}"),
                  F.avg(hit.cast("double")).alias(f"frac_{pct}")]
    return pairs.groupBy(*by).agg(*parts)


def parity_table(df: DataFrame, min_rows: int = 3) -> DataFrame:
    """(target, split, n, nrmse, rmse, r2, frac_10, frac_20) for targets with enough rows in
    both splits; the bands are relative."""
    pairs = finite_pairs(df)
    hits = [F.avg(in_band(rel).cast("double")).alias(f"frac_{round(rel * 100)}")
            for rel in (0.10, 0.20)]
    out = pairs.groupBy("target", "split").agg(
        F.count("*").alias("n"), nrmse().alias("nrmse"), rmse().alias("rmse"),
        r2().alias("r2"), *hits)
    enough = out.where(F.col("n") >= min_rows).groupBy("target").agg(
        F.count("*").alias("_sides")).where("_sides = 2").select("target")
    return out.join(F.broadcast(enough), "target", "left_semi")


def interval_report(df: DataFrame, by: list[str] = ("target",), min_rows: int = 3) -> DataFrame:
    """(by…, n, r2, rmse, coverage, mean_width, max_width); too few rows give nulls, and a
    group without any truth has n = 0."""
    known = F.col("y").isNotNull()
    rows = df.withColumns({c: F.when(known, F.col(c)) for c in ("p", "lo", "hi")})
    enough = F.count("y") >= min_rows
    width = F.col("hi") - F.col("lo")
    measures = {"r2": r2(), "rmse": rmse(), "coverage": F.avg(F.when(known, covered())),
                "mean_width": F.avg(width), "max_width": F.max(width)}
    return rows.groupBy(*by).agg(
        F.count("y").alias("n"), *[F.when(enough, m).alias(k) for k, m in measures.items()])


def group_report(df: DataFrame, group: str, min_rows: int = 5) -> DataFrame:
    """Metrics per group value, worst first; small and null groups are left out."""
    rows = df.where(F.col("y").isNotNull() & F.col(group).isNotNull())
    out = rows.groupBy(group).agg(
        F.count("*").alias("n"), r2().alias("r2"), rmse().alias("rmse"),
        F.avg(covered()).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    return out.where(F.col("n") >= min_rows).orderBy(F.desc("rmse"), group)


def problem_groups(df: DataFrame, group: str = "doi", min_rows: int = 3) -> DataFrame:
    """Metrics per paper, worst first; the coverage of a paper without intervals is null."""
    rows = df.where(F.col("y").isNotNull() & F.col(group).isNotNull())
    inside = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), covered())
    out = rows.groupBy(group).agg(
        F.count("*").alias("n"), r2().alias("r2"), rmse().alias("rmse"),
        F.avg(inside).alias("coverage"))
    return out.where(F.col("n") >= min_rows).orderBy(F.desc("rmse"), group)


def nominal_levels(k: int) -> list[float]:
    return [0.05 + (0.95 - 0.05) * i / (k - 1) for i in range(k)] if k > 1 else [0.05]


def coverage_curve(df: DataFrame, residuals: DataFrame, k: int = 10) -> DataFrame:
    """(nominal, achieved): how often ``|y - p|`` stays within the quantile of that level of
    the calibration residuals (column ``abs_resid``)."""
    q = exact_quantiles(residuals, ["abs_resid"], nominal_levels(k)).select("prob", "q")
    levels = F.broadcast(q).agg(F.array_sort(F.collect_list(F.struct("prob", "q")))).scalar()
    rows = finite_pairs(df).select(F.abs(F.col("y") - F.col("p")).alias("d"))
    rows = rows.withColumn("l", F.explode(levels))
    return rows.groupBy(F.col("l.prob").alias("nominal")).agg(
        F.avg((F.col("d") <= F.col("l.q")).cast("double")).alias("achieved"))


def width_percentile_curve(df: DataFrame, k: int = 10) -> DataFrame:
    """(nominal, achieved): how often the truth itself lies between two percentiles of the
    interval widths, which is what the published curve draws."""
    rows = df.select("y", (F.col("hi") - F.col("lo")).alias("width"))
    levels = nominal_levels(k)
    probs = sorted({round(v, 12) for p in levels for v in ((1 - p) / 2, (1 + p) / 2)})
    q = exact_quantiles(rows, ["width"], probs).select("prob", "q")
    pairs = F.array(*[F.struct(F.lit(p).alias("nominal"), F.lit(round((1 - p) / 2, 12)).alias("a"),
                               F.lit(round((1 + p) / 2, 12)).alias("b")) for p in levels])
    one = q.agg(F.map_from_entries(F.collect_list(F.struct("prob", "q"))).alias("m"))
    bounds = one.select(F.transform(pairs, lambda s: F.struct(
        s["nominal"].alias("nominal"), F.element_at("m", s["a"]).alias("a"),
        F.element_at("m", s["b"]).alias("b")))).scalar()
    rows = rows.withColumn("l", F.explode(bounds))
    inside = F.coalesce(F.col("y").between(F.col("l.a"), F.col("l.b")), F.lit(False))
    return rows.groupBy(F.col("l.nominal").alias("nominal")).agg(
        F.avg(inside.cast("double")).alias("achieved"))


def standardized_residuals(df: DataFrame) -> DataFrame:
    """Add ``z``: the error over its sample standard deviation."""
    out = finite_pairs(df).withColumn("err", F.col("p") - F.col("y"))
    sd = out.agg(F.stddev_samp("err").alias("_sd"))
    return with_facts(out, sd).withColumn("z", F.col("err") / (F.col("_sd") + 1e-9)).drop("_sd")


def qq_grid(df: DataFrame, value: str = "z", points: int = 99) -> DataFrame:
    """(prob, sample_q, normal_q) on an even grid of probabilities."""
    probs = [(i - 0.5) / points for i in range(1, points + 1)]
    q = exact_quantiles(df, [value], probs)
    normal = F.create_map(*[x for p in probs for x in (F.lit(p), F.lit(z_value(p)))])
    return q.select("prob", F.col("q").alias("sample_q"),
                    F.element_at(normal, F.col("prob")).alias("normal_q"))


def qq_runs(df: DataFrame, value: str = "z") -> DataFrame:
    """Every sorted value with the range of positions it fills, for exact Q-Q pairs.

    (value, first, last, prob_first, prob_last) with prob = (i - 0.5) / n. Equal values are
    one row, and positions come from a histogram of value codes, so no task sorts all rows.
    """
    runs = long_values(df, [value], []).withColumn("code", value_code(F.col("value")))
    runs = runs.groupBy("code", "value").agg(F.count("*").alias("c"))
    cells = runs.groupBy("code").agg(F.sum("c").alias("cell"))
    order = Window.orderBy("code")  # over the bounded set of codes
    offsets = cells.select("code", (F.sum("cell").over(order) - F.col("cell")).alias("before"))
    n = cells.agg(F.sum("cell")).scalar()
    inside = Window.partitionBy("code").orderBy("value")
    runs = runs.withColumn("upto", F.sum("c").over(inside)).join(offsets, "code")
    first = F.col("before") + F.col("upto") - F.col("c") + 1
    last = F.col("before") + F.col("upto")
    return runs.select(
        "value", first.alias("first"), last.alias("last"),
        ((first - 0.5) / n).alias("prob_first"), ((last - 0.5) / n).alias("prob_last"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, cnt, density) over the range of the finite values; empty bins too."""
    rows = long_values(df, [value], [])
    span = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                    F.count("*").alias("n"))
    counts = with_facts(rows, span).groupBy(
        bin_number(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    ).agg(F.count("*").alias("cnt"))
    every = span.where("n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    flat = F.col("hi") <= F.col("lo")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    step = (F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")) - lo) / F.lit(float(bins))
    out = every.join(F.broadcast(counts), "bin", "left")  # one row per bin
    cnt = F.coalesce("cnt", F.lit(0)).cast("bigint")
    return out.select(
        "bin", (lo + F.col("bin") * step).alias("low"), (lo + (F.col("bin") + 1) * step).alias("high"),
        cnt.alias("cnt"), (cnt / (F.col("n") * step)).alias("density"))


def residual_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the standardised residuals with the normal density at bin centres."""
    out = histogram(standardized_residuals(df), "z", bins)
    return out.withColumn("normal", normal_density((F.col("low") + F.col("high")) / 2.0))


def box_stats(df: DataFrame, values: list[str], by: list[str] = ()) -> DataFrame:
    """(by…, variable, n, mean, std_pop, std_samp, q25, median, q75, min, max, low, high):
    quartiles are exact; ``low`` and ``high`` are the mean ± 1.5 sample deviations."""
    by = list(by)
    df = cut_lineage(df.select(*by, *[F.col(c).cast("double").alias(c) for c in values]), "boxes")  # read by each pass
    moments = long_values(df, values, by).groupBy(*by, "variable").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"),
        F.stddev_samp("value").alias("std_samp"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantile_columns(df, values, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    out = attach(q, moments, [*by, "variable"], "inner", salted=False)
    return out.withColumns({"low": F.col("mean") - 1.5 * F.col("std_samp"),
                            "high": F.col("mean") + 1.5 * F.col("std_samp")})


def family_boxes(df: DataFrame, family: str = "family") -> DataFrame:
    """Error and width box statistics per family, most frequent family first, with the
    place of each mean absolute error on the scale from smallest to largest."""
    rows = df.where(F.col(family).isNotNull()).withColumns(
        {"error": F.col("p") - F.col("y"), "width": F.col("hi") - F.col("lo")})
    rows = rows.where(F.col("error").isNotNull() & F.col("width").isNotNull())
    out = box_stats(rows, ["error", "width"], [family]).withColumn("size", F.abs("mean"))
    scale = out.groupBy("variable").agg(F.min("size").alias("_a"), F.max("size").alias("_b"))
    out = out.join(F.broadcast(scale), "variable")  # two variables
    shade = F.coalesce(F.try_divide(F.col("size") - F.col("_a"), F.col("_b") - F.col("_a")),
                       F.lit(0.0))
    out = out.withColumn("shade", shade).drop("_a", "_b", "size")
    return out.orderBy(F.desc("n"), family, "variable")


def uncertainty_summary(df: DataFrame) -> DataFrame:
    """One row: mean, median, min and max of the interval width."""
    rows = df.select((F.col("hi") - F.col("lo")).alias("width"))
    median = quantile_columns(rows, ["width"], {"median": 0.5}).select("median").scalar()
    return rows.agg(F.avg("width").alias("mean"), F.min("width").alias("min"),
                    F.max("width").alias("max")).withColumn("median", median)


def uncertainty_landscape(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, n, mean_width): interval width over two coordinates."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"),
                     (F.col("hi") - F.col("lo")).alias("width")).dropna()
    span = rows.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y")
                      for n, f in (("lo", F.min), ("hi", F.max))])
    cells = with_facts(rows, span)
    names = [bin_number(F.col(c), F.col(c + "_lo"), F.col(c + "_hi"), bins).alias(c + "_bin")
             for c in ("x", "y")]
    return cells.groupBy(*names).agg(F.count("*").alias("n"), F.avg("width").alias("mean_width"))


def derived_ratio_metrics(df: DataFrame, weights: dict[str, float] = ATOMIC_WEIGHTS,
                          eps: float = 0.0, by: list[str] = ()) -> DataFrame:
    """(by…, target, n, r2, rmse) of atomic ratios derived from predicted element percentages.

    Predictions are in ``p_<element>_<phase>``. The truth is the reported ratio column when
    there is one, else the ratio of the measured percentages.
    """
    pairs = []
    for ratio in RATIOS:
        num, den, phase = ratio.split("_")
        top, bottom = f"{num}_{phase}", f"{den}_{phase}"
        if f"p_{top}" not in df.columns or f"p_{bottom}" not in df.columns:
            continue
        truth = (F.col(ratio) if ratio in df.columns
                 else atomic_ratio(top, bottom, num, den, weights, eps))
        guess = atomic_ratio(f"p_{top}", f"p_{bottom}", num, den, weights, eps)
        pairs.append(F.struct(F.lit(ratio).alias("target"), truth.cast("double").alias("y"),
                              guess.cast("double").alias("p")))
    rows = df.select(*by, F.explode(F.array(*pairs)).alias("r")).select(*by, "r.*")
    usable = finite(F.col("y")).isNotNull() & finite(F.col("p")).isNotNull()
    rows = rows.withColumns({c: F.when(usable, F.col(c)) for c in ("y", "p")})
    return rows.groupBy(*by, "target").agg(
        F.count("y").alias("n"), r2().alias("r2"), rmse().alias("rmse"))


def fold_ratio_metrics(oof: DataFrame, weights: dict[str, float] = ATOMIC_WEIGHTS_ROUNDED,
                       key: str = "row_id", eps: float = 0.0) -> DataFrame:
    """(model, target, n, r2, rmse) of atomic ratios derived from out-of-fold rows (``key``, target,
    model, fold, y, p) of element percentages.

    The rows of a key and model become one row of measured and predicted percentages by one
    aggregate. A ratio needs both percentages, measured and predicted; a key that is predicted
    in several rows of one model counts with their mean.
    """
    names = sorted({f"{e}_{phase}" for num, den, phase in (r.split("_") for r in RATIOS) for e in (num, den)})
    rows = oof.where(F.col("target").isin(names))
    wide = rows.groupBy(key, "model").agg(
        *[F.avg(F.when(F.col("target") == t, F.col(v))).alias(prefix + t)
          for t in names for v, prefix in (("y", ""), ("p", "p_"))])
    return derived_ratio_metrics(wide, weights, eps, by=["model"])


def residual_interval(df: DataFrame, calibration: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Intervals ŷ ± t·sd of the calibration residuals (``y``, ``p``)."""
    sd = finite_pairs(calibration).agg(
        F.stddev_samp(F.col("y") - F.col("p")).alias("_sd"), F.count("*").alias("_n"))
    out = with_facts(df, sd)
    t = F.when(F.col("_n") >= 30, F.lit(z_value(1 - alpha / 2))).otherwise(
        student_quantile(1 - alpha / 2, F.col("_n") - 1))
    return out.withColumns({"lo": F.col("p") - t * F.col("_sd"),
                            "hi": F.col("p") + t * F.col("_sd")}).drop("_sd", "_n")


def fitted_line(df: DataFrame, by: list[str] = ("split",), points: int = 50,
                alpha: float = 0.05) -> DataFrame:
    """(by…, i, x, fit, lo, hi): straight line of prediction on truth with its confidence
    band, on an even grid over the truth."""
    facts = finite_pairs(df).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("p", "y").alias("b"),
        F.regr_intercept("p", "y").alias("a"), F.regr_sxx("p", "y").alias("sxx"),
        F.regr_syy("p", "y").alias("syy"), F.avg("y").alias("mean"), F.min("y").alias("lo_y"),
        F.max("y").alias("hi_y")).where("n > 2 and sxx > 0")
    sse = F.greatest(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), F.lit(0.0))
    s = F.sqrt(sse / (F.col("n") - 2))
    grid = facts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("lo_y") + (F.col("hi_y") - F.col("lo_y")) * F.col("i")
                           / F.lit(float(points - 1)))
    t = F.when(F.col("n") >= 30, F.lit(z_value(1 - alpha / 2))).otherwise(
        student_quantile(1 - alpha / 2, F.col("n") - 2))
    gap = F.col("x") - F.col("mean")
    half = t * s * F.sqrt(F.lit(1.0) / F.col("n") + gap * gap / F.col("sxx"))
    fit = F.col("a") + F.col("b") * F.col("x")
    return grid.select(*by, "i", "x", fit.alias("fit"), (fit - half).alias("lo"),
                       (fit + half).alias("hi"))


#: Cells are a quarter of a bandwidth wide, and their moments go up to this power.
CELL_SHARE, CELL_POWER = 0.25, 8
KERNEL_REACH = 9.0  # bandwidths; a value further away adds less than 2e-18 / h


def hermite(power: int) -> list[list[float]]:
    """Coefficients, constant first, of the polynomials in the derivatives of exp(-u * u / 2)."""
    out = [[1.0], [0.0, 1.0]]
    for j in range(1, power):
        shifted, lower = [0.0, *out[j]], [*out[j - 1], 0.0, 0.0]
        out.append([a - j * b for a, b in zip(shifted, lower)])
    return out[:power + 1]


def density_curve(df: DataFrame, value: str, by: list[str], points: int = 300) -> DataFrame:
    """(by…, i, x, density): Gaussian kernel density with the Scott bandwidth h on one even
    grid over all groups.

    One pass sums, per cell of h / 4, the powers 0 to 8 of the distances from the cell's centre;
    the kernel's series around the centre then gives each cell's part at the points within 9 h.
    A value is at most h / 8 from a centre, so the series ends with an error below
    5e-12 / h and what is out of reach adds less than 2e-18 / h. A group has at most one cell per
    different value, and a point is reached from at most 73 cells, however many values there are.

    Groups of fewer than five values, or of one value only, get a linearly joined histogram
    instead.
    """
    rows = long_values(df, [value], list(by)).drop("variable")
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("v_lo"), F.max("value").alias("v_hi"))
    span = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = attach(rows, stats, list(by), "inner", counts=stats.select(*by, "n"))
    smooth = (F.col("n") >= 5) & (F.col("v_hi") > F.col("v_lo"))
    parts = _kernel_parts(rows.where(smooth), span, by, points).unionByName(
        _joined_parts(rows.where(~smooth), span, by, points))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    grid = with_facts(parts.groupBy(*by, "i").agg(F.sum("part").alias("density")), span)
    return grid.select(*by, "i", x.alias("x"), "density")


def _kernel_parts(rows: DataFrame, span: DataFrame, by: list[str], points: int) -> DataFrame:
    """(by…, i, part): what each cell of a group adds at each point in its reach, and 0 at the
    group's other points."""
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    cell = F.floor((F.col("value") - F.col("v_lo")) / (h * CELL_SHARE))
    rows = rows.withColumns({"h": h, "cell": cell})
    rows = rows.withColumn("center", F.col("v_lo") + (F.col("cell") + 0.5) * CELL_SHARE * F.col("h"))
    t = (F.col("value") - F.col("center")) / F.col("h")
    power = F.lit(1.0)
    sums = []
    for j in range(CELL_POWER + 1):
        sums.append(F.sum(power).alias(f"s{j}"))
        power = power * t
    facts = [F.max(c).alias(c) for c in ("n", "h", "center")]
    cells = with_facts(rows.groupBy(*by, "cell").agg(*sums, *facts), span)
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    reach = F.col("h") * KERNEL_REACH
    first = F.greatest(F.lit(0), F.ceil((F.col("center") - reach - F.col("lo")) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("center") + reach - F.col("lo")) / step).cast("int"))
    near = cells.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    u = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
         - F.col("center")) / F.col("h")
    near = near.withColumn("u", u)
    series = F.lit(0.0)
    for j, coefficients in enumerate(hermite(CELL_POWER)):
        value = F.lit(0.0)
        for c in reversed(coefficients):
            value = value * F.col("u") + F.lit(c)
        series = series + value * F.col(f"s{j}") / F.lit(float(factorial(j)))
    part = normal_density(F.col("u")) * series / (F.col("n") * F.col("h"))
    every = rows.select(*by).distinct().withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return near.select(*by, "i", part.alias("part")).unionByName(
        every.select(*by, "i", F.lit(0.0).alias("part")))


def _joined_parts(rows: DataFrame, span: DataFrame, by: list[str], points: int) -> DataFrame:
    """(by…, i, part): the same for a histogram whose bin centres are joined by lines."""
    bins = 30
    bin_of = bin_number(F.col("value"), F.col("v_lo"), F.col("v_hi"), bins)
    counted = rows.groupBy(*by, bin_of.alias("bin")).agg(
        F.count("*").alias("c"), *[F.max(c).alias(c) for c in ("n", "v_lo", "v_hi")])
    counted = with_facts(counted, span)
    counted = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    flat = F.col("v_hi") <= F.col("v_lo")
    low = F.when(flat, F.col("v_lo") - 0.5).otherwise(F.col("v_lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("v_hi") - F.col("v_lo")) / F.lit(float(bins))
    center = low + (F.col("bin") + 0.5) * width
    reach = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x - center) / width) / width
    inside = (x >= low + width * 0.5) & (x <= low + width * (bins - 0.5))
    part = F.when(inside, F.col("c") * reach / F.col("n")).otherwise(F.lit(0.0))
    return counted.select(*by, "i", part.alias("part"))


def overlap_window(df: DataFrame, value: str = "y", split: str = "split",
                   probs: tuple[float, float] = (0.05, 0.95), min_rows: int = 5) -> DataFrame:
    """One row (lo, hi, overlap): common part of the splits' central ranges, or the full
    range when a split is too small or they do not meet."""
    q = quantile_columns(df, [value], {"a": probs[0], "b": probs[1]}, [split])
    one = q.agg(F.max("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n"),
                F.count("*").alias("sides"))
    full = long_values(df, [value], []).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ok = (F.col("n") >= min_rows) & (F.col("sides") >= 2) & (F.col("b") > F.col("a"))
    out = with_facts(full, one)
    return out.select(F.when(ok, F.col("a")).otherwise(F.col("lo")).alias("lo"),
                      F.when(ok, F.col("b")).otherwise(F.col("hi")).alias("hi"),
                      F.coalesce(ok, F.lit(False)).alias("overlap"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_distinct), counted as one column of (name, value) pairs so that
    no column's values meet in one task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                      for c in columns])
    rows = df.select(F.explode(pairs).alias("r")).select("r.*")
    values = rows.groupBy("column", "v").agg(F.count("*").alias("c"))
    return values.groupBy("column").agg(F.sum("c").alias("n_rows"), F.count("v").alias("n_distinct"))


def target_category(target: Column) -> Column:
    out = None
    for name, members in (("Yield", YIELDS), ("Energy", ENERGY_CARBON), ("Bio-oil", BIOOIL),
                          ("Biochar", BIOCHAR), ("Ratio", RATIOS)):
        test = target.isin(members)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("Other"))


def result_summary(results: DataFrame, ratio_mode: str = "none",
                   derived: DataFrame | None = None) -> DataFrame:
    """Result rows with their category; ratio targets dropped, kept or replaced."""
    if ratio_mode not in ("none", "direct", "derived"):
        raise ValueError(f"unknown ratio mode {ratio_mode!r}")
    out = results
    if ratio_mode != "direct":
        out = out.where(~F.col("target").isin(RATIOS))
    if ratio_mode == "derived" and derived is not None:
        out = out.unionByName(derived, allowMissingColumns=True)
    return out.withColumn("category", target_category(F.col("target")))


def metric_matrix(results: DataFrame, prefix: str) -> DataFrame:
    """(target, <prefix>_rf, <prefix>_dt, <prefix>_lr); raises when one is missing."""
    names = [f"{prefix}_{m}" for m in ("rf", "dt", "lr")]
    missing = [c for c in names if c not in results.columns]
    if missing:
        raise KeyError(f"missing result columns {missing}")
    return results.select("target", *names)


def overview_stats(df: DataFrame, panels: list[tuple]) -> DataFrame:
    """(panel, variable, n, mean, std, min, max) after the clipping of each panel.

    The quantile bounds of all panels come from one exact-quantile pass over all columns.
    """
    rows = [(name, c, *(clip or (0.0, 1.0))) for name, columns, clip in panels
            for c in columns if c in df.columns]
    columns = list(dict.fromkeys(r[1] for r in rows))
    plan = df.sparkSession.createDataFrame(
        rows, "panel string, variable string, p_lo double, p_hi double")
    q = exact_quantiles(df, columns, sorted({p for r in rows for p in r[2:]}))
    bounds = plan.join(q, "variable").groupBy("panel", "variable").agg(
        F.max(F.when(F.col("prob") == F.col("p_lo"), F.col("q"))).alias("low"),
        F.max(F.when(F.col("prob") == F.col("p_hi"), F.col("q"))).alias("high"))
    values = long_values(df, columns, []).join(F.broadcast(bounds), "variable")  # few rows
    values = values.where(F.col("value").between(F.col("low"), F.col("high")))
    out = values.groupBy("panel", "variable").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    every = plan.select("panel", "variable").distinct()  # a column without values has n = 0
    return every.join(out, ["panel", "variable"], "left").fillna({"n": 0})


def long_targets(df: DataFrame, targets: list[str], keep: list[str] = (),
                 prediction: str = "p_") -> DataFrame:
    """(keep…, target, y, p) from truth columns and their ``p_`` counterparts."""
    pairs = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                 F.col(prediction + t).cast("double").alias("p")) for t in targets])
    return df.select(*keep, F.explode(pairs).alias("r")).select(*keep, "r.*")


