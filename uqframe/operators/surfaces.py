"""Local quadratic response surfaces for every block of rows at once.

A block is a (paper, feedstock) pair. The surface z(x, y) of a block is fitted to the
model's predictions from 22 sums that one map-side combined ``groupBy`` collects; only
those sums, one row per block, reach NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.constants import ELEMENT_NAMES, PHASE_NAMES, TARGET_LABELS
from uqframe.operators.columns import with_prefix
from uqframe.operators.metrics import r2, rmse
from uqframe.operators.skew import attach, with_facts

BLOCK = ["doi", "feedstock"]
# powers (a, b) of the six surface terms x^a * y^b, and of all sums that the fit needs
TERMS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
MOMENTS = [(a, b) for a in range(5) for b in range(5 - a)]
RESPONSES = TERMS
EDGE_SHARE = 0.15


def block_rows(df: DataFrame, x: str, y: str, truth: str, prediction: str,
               block: list[str] = BLOCK, keep: list[str] = ()) -> DataFrame:
    """(block…, keep…, x, y, y_exp, y_fit, residual) of complete rows."""
    out = df.select(*block, *keep, F.col(x).cast("double").alias("x"),
                    F.col(y).cast("double").alias("y"), F.col(truth).cast("double").alias("y_exp"),
                    F.col(prediction).cast("double").alias("y_fit"))
    out = out.dropna(subset=["x", "y", "y_exp"])
    return out.withColumn("residual", F.col("y_exp") - F.col("y_fit"))


def block_candidates(df: DataFrame, target: str, x: str = "temp_c", y: str = "t_min",
                     block: list[str] = BLOCK, min_points: int = 6, min_x_span: float = 10.0,
                     min_y_span: float = 10.0) -> DataFrame:
    """Blocks with enough rows and spread: counts and ranges of x, y and the target."""
    rows = df.select(*block, x, y, target).dropna()
    ranges = [f(c).alias(f"{c}_{n}") for c in (x, y, target)
              for n, f in (("min", F.min), ("max", F.max))]
    out = rows.groupBy(*block).agg(F.count("*").alias("n_points"), *ranges)
    out = out.withColumns({f"{c}_span": F.col(f"{c}_max") - F.col(f"{c}_min")
                           for c in (x, y, target)})
    return out.where((F.col("n_points") >= min_points) & (F.col(f"{x}_span") >= min_x_span)
                     & (F.col(f"{y}_span") >= min_y_span))


def top_blocks(candidates: DataFrame, target: str, k: int, block: list[str] = BLOCK,
               order: str = "points") -> DataFrame:
    """The report's ``k`` blocks: by row count then target span, or the other way round."""
    keys = ["n_points", f"{target}_span"]
    keys = keys if order == "points" else keys[::-1]
    return candidates.orderBy(*[F.desc(c) for c in keys], *block).limit(k)


def block_moments(rows: DataFrame, block: list[str] = BLOCK) -> DataFrame:
    """Per block: row count, ranges, and the sums of x^a·y^b and z·x^a·y^b.

    x and y are first centred and scaled by their moments over all rows, a single row of
    facts, so that the sums stay well conditioned without shuffling the rows.
    """
    facts = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y")
                       for n, f in (("mid", F.avg), ("sd", F.stddev_pop))])
    out = with_facts(rows.where(F.col("y_fit").isNotNull()), facts)
    for c in ("x", "y"):
        sd = F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(F.lit(1.0))
        out = out.withColumn(f"u{c}", (F.col(c) - F.col(f"mid_{c}")) / sd)

    def power(name: str, n: int) -> Column:
        value = F.lit(1.0)
        for _ in range(n):
            value = value * F.col(name)
        return value

    sums = [F.sum(power("ux", a) * power("uy", b)).alias(f"m{a}{b}") for a, b in MOMENTS]
    sums += [F.sum(F.col("y_fit") * power("ux", a) * power("uy", b)).alias(f"r{a}{b}")
             for a, b in RESPONSES]
    ranges = [f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    facts_back = [F.max(f"{n}_{c}").alias(f"{n}_{c}") for c in ("x", "y") for n in ("mid", "sd")]
    return out.groupBy(*block).agg(F.count("*").alias("n_points"), *ranges, *facts_back, *sums)


def solve_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least-squares surface of every row of sums, by one batched pseudo-inverse.

    The sums are moved to the centre and scale of each block before solving; coefficients
    refer to u = (x - x_mid) / x_scale and v likewise.
    """
    n = pdf["n_points"].to_numpy(float)
    m = {p: pdf[f"m{p[0]}{p[1]}"].to_numpy(float) for p in MOMENTS}
    r = {p: pdf[f"r{p[0]}{p[1]}"].to_numpy(float) for p in RESPONSES}
    cx, cy = m[1, 0] / n, m[0, 1] / n
    sx = np.sqrt(np.maximum(m[2, 0] / n - cx**2, 0.0))
    sy = np.sqrt(np.maximum(m[0, 2] / n - cy**2, 0.0))
    sx, sy = np.where(sx > 1e-9, sx, 1.0), np.where(sy > 1e-9, sy, 1.0)
    binomial = [[1], [1, 1], [1, 2, 1], [1, 3, 3, 1], [1, 4, 6, 4, 1]]

    def moved(source: dict, a: int, b: int) -> np.ndarray:
        total = np.zeros(len(n))
        for i in range(a + 1):
            for j in range(b + 1):
                total += (binomial[a][i] * binomial[b][j] * (-cx) ** (a - i)
                          * (-cy) ** (b - j) * source[i, j])
        return total / (sx**a * sy**b)

    gram = np.empty((len(n), 6, 6))
    right = np.empty((len(n), 6, 1))
    for i, (a, b) in enumerate(TERMS):
        right[:, i, 0] = moved(r, a, b)
        for j, (c, d) in enumerate(TERMS):
            gram[:, i, j] = moved(m, a + c, b + d)
    gram /= n[:, None, None]
    right /= n[:, None, None]
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-9 * values[:, -1:]
    inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    beta = vectors @ (inverse[:, :, None] * (np.swapaxes(vectors, 1, 2) @ right))
    out = pdf[[c for c in pdf.columns if c[:1] not in "mr" or c in ("row_id",)]].copy()
    sd_x = np.where(pdf["sd_x"] > 0, pdf["sd_x"], 1.0)
    sd_y = np.where(pdf["sd_y"] > 0, pdf["sd_y"], 1.0)
    out["x_mid"] = pdf["mid_x"] + cx * sd_x
    out["y_mid"] = pdf["mid_y"] + cy * sd_y
    out["x_scale"], out["y_scale"] = sx * sd_x, sy * sd_y
    for i in range(6):
        out[f"b{i}"] = beta[:, i, 0]
    out["full_rank"] = keep.sum(axis=1) == 6
    return out


def fit_surfaces(rows: DataFrame, block: list[str] = BLOCK, min_points: int = 6) -> DataFrame:
    """(block…, n_points, ranges, centre, scale, b0…b5, full_rank): one surface per block.

    Blocks whose design is rank deficient get the minimum-norm surface in centred and
    scaled coordinates and are marked.
    """
    moments = block_moments(rows, block).where(F.col("n_points") >= min_points)
    types = dict(moments.dtypes)
    ranges = ["x_min", "x_max", "y_min", "y_max"]
    numbers = ["x_mid", "y_mid", "x_scale", "y_scale", *[f"b{i}" for i in range(6)]]
    schema = ", ".join([f"`{c}` {types[c]}" for c in block] + ["n_points bigint"]
                       + [f"{c} double" for c in ranges + numbers] + ["full_rank boolean"])
    order = [*block, "n_points", *ranges, *numbers, "full_rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                names = pdf[block].add_prefix("k_")
                solved = solve_blocks(pdf.drop(columns=block))
                solved[block] = names.to_numpy()
                yield solved[order]

    return moments.mapInPandas(run, schema)


def surface_value(x: Column, y: Column) -> Column:
    u = (x - F.col("x_mid")) / F.col("x_scale")
    v = (y - F.col("y_mid")) / F.col("y_scale")
    return (F.col("b0") + F.col("b1") * u + F.col("b2") * v + F.col("b3") * u * u
            + F.col("b4") * u * v + F.col("b5") * v * v)


def physical_range(target: str) -> tuple[float, float | None]:
    """Range that a surface of this target is moved into."""
    if target.endswith("_y") or "yield" in target:
        return 0.0, 100.0
    if "hhv" in target:
        return 0.0, 50.0
    if target.startswith(("o_c", "h_c")):
        return 0.0, 3.0
    if target.split("_")[0] in ELEMENT_NAMES and target.endswith(("biooil", "biochar")):
        return 0.0, 100.0
    return 0.0, None


def surface_grid(surfaces: DataFrame, target: str, n_grid: int = 80, padding: float = 0.05,
                 absolute: dict[str, float] | None = None,
                 block: list[str] = BLOCK) -> DataFrame:
    """(block…, ix, iy, x, y, z): the surfaces on an even grid a little beyond the data.

    The grid is made per block row by two nested explodes.
    """
    out = surfaces
    for c in ("x", "y"):
        span = F.col(f"{c}_max") - F.col(f"{c}_min")
        pad = F.lit(float(absolute[c])) if absolute and c in absolute else span * F.lit(
            0.05 if absolute is not None else padding)
        out = out.withColumns({f"_lo_{c}": F.col(f"{c}_min") - pad,
                               f"_step_{c}": (span + pad * 2.0) / F.lit(float(n_grid - 1))})
    steps = F.sequence(F.lit(0), F.lit(n_grid - 1))
    out = out.withColumn("iy", F.explode(steps)).withColumn("ix", F.explode(steps))
    out = out.withColumns({
        "gx": F.col("_lo_x") + F.col("ix") * F.col("_step_x"),
        "gy": F.col("_lo_y") + F.col("iy") * F.col("_step_y")})
    low, high = physical_range(target)
    z = F.greatest(surface_value(F.col("gx"), F.col("gy")), F.lit(low))
    z = F.least(z, F.lit(high)) if high is not None else z
    return out.select(*block, "ix", "iy", F.col("gx").alias("x"), F.col("gy").alias("y"),
                      z.alias("z"))


def surface_optimum(surfaces: DataFrame, target: str, n_grid: int = 80, padding: float = 0.05,
                    block: list[str] = BLOCK, digits: int | None = None) -> DataFrame:
    """(block…, n_points, ranges, z_min, z_max, x_opt, y_opt, z_opt, opt_location).

    The first largest grid point in row order wins; it is interior when it keeps more than
    15 % of the data range to every edge.
    """
    grid = surface_grid(surfaces, target, n_grid, padding, block=block)
    z = F.round("z", digits) if digits is not None else F.col("z")
    grid = grid.withColumn("_z", z)
    place = F.struct(F.col("_z"), -(F.col("iy") * n_grid + F.col("ix")))
    best = grid.groupBy(*block).agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        F.max_by(F.struct("x", "y", "z"), place).alias("o"))
    out = attach(surfaces.drop("x_mid", "y_mid", "x_scale", "y_scale",
                               *[f"b{i}" for i in range(6)]), best, block, "inner", salted=False)
    shares = []
    for c in ("x", "y"):
        span = F.col(f"{c}_max") - F.col(f"{c}_min")
        span = F.when(span > 0, span).otherwise(F.lit(1.0))
        shares += [(F.col(f"o.{c}") - F.col(f"{c}_min")) / span,
                   (F.col(f"{c}_max") - F.col(f"o.{c}")) / span]
    place = F.when(F.least(*shares) > EDGE_SHARE, F.lit("interior")).otherwise(F.lit("edge"))
    return out.withColumns({"x_opt": F.col("o.x"), "y_opt": F.col("o.y"), "z_opt": F.col("o.z"),
                            "opt_location": place}).drop("o")


def block_metrics(rows: DataFrame, block: list[str] = BLOCK) -> DataFrame:
    """(block…, n, rmse, r2) of the model's predictions inside each block."""
    return rows.groupBy(*block).agg(
        F.count("*").alias("n"), rmse("y_exp", "y_fit").alias("rmse"),
        r2("y_exp", "y_fit").alias("r2"))


def block_tags(df: DataFrame, block: list[str] = BLOCK) -> DataFrame:
    """(block…, catalyst, solvent, subtype): the first one-hot column set in the block."""
    names = {p: with_prefix(df, p) for p in ("cat_", "solv_", "subtype_")}
    every = [c for group in names.values() for c in group]
    out = df.groupBy(*block).agg(F.lit(0).alias("_none"),
                                 *[F.max(F.col(f"`{c}`")).alias(f"_m{i}") for i, c in enumerate(every)])
    position = {c: i for i, c in enumerate(every)}

    def first(prefix: str, default: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"_m{position[c]}") > 0, F.lit(c.removeprefix(prefix)))
                            for c in names[prefix]], F.lit(default))

    return out.select(*block, first("cat_", "none").alias("catalyst"),
                      first("solv_", "water").alias("solvent"),
                      first("subtype_", "").alias("subtype"))


def target_label(target: str) -> tuple[str, str]:
    """(units, label) of a target, by table or by the parts of its name."""
    if target in TARGET_LABELS:
        return TARGET_LABELS[target]
    head, _, phase = target.partition("_")
    if head in ELEMENT_NAMES and phase in PHASE_NAMES:
        return "wt %", f"{ELEMENT_NAMES[head]} in {PHASE_NAMES[phase]} (wt%)"
    return "", target


def with_target_labels(df: DataFrame, targets: list[str]) -> DataFrame:
    """Add ``units`` and ``label`` by the ``target`` column from a generated dimension."""
    rows = [(t, *target_label(t)) for t in dict.fromkeys(targets)]
    dim = df.sparkSession.createDataFrame(rows, "target string, units string, label string")
    return df.join(F.broadcast(dim), "target", "left")  # one row per configured target


def composition_points(df: DataFrame, subtype: str, product: str,
                       side: str = "both") -> DataFrame:
    """(part, o_c, h_c) of feedstock and product for one subtype and part of the split."""
    if side not in ("train", "test", "both"):
        raise ValueError(f"unknown side {side!r}")
    rows = df.where(F.col(subtype) == 1)
    if side != "both":
        rows = rows.where(F.col(f"is_{side}"))
    parts = F.array(
        F.struct(F.lit("feedstock").alias("part"), F.col("o_c").cast("double").alias("o_c"),
                 F.col("h_c").cast("double").alias("h_c")),
        F.struct(F.lit(product).alias("part"),
                 F.col(f"o_c_{product}").cast("double").alias("o_c"),
                 F.col(f"h_c_{product}").cast("double").alias("h_c")))
    out = rows.select(F.explode(parts).alias("r")).select("r.*")
    return out.where(F.col("o_c").isNotNull() & F.col("h_c").isNotNull())


def composition_summary(points: DataFrame) -> DataFrame:
    """(part, n, mean_o_c, mean_h_c) with the padded ranges of both axes over all parts."""
    span = points.agg(F.min("o_c").alias("a"), F.max("o_c").alias("b"),
                      F.min("h_c").alias("c"), F.max("h_c").alias("d"))
    pad_x = F.lit(0.05) * F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0)
    pad_y = F.lit(0.05) * F.when(F.col("d") > F.col("c"), F.col("d") - F.col("c")).otherwise(1.0)
    facts = span.select(
        (F.col("a") - pad_x).alias("x_lo"), (F.col("b") + pad_x).alias("x_hi"),
        F.greatest(F.lit(0.0), F.col("c") - pad_y).alias("y_lo"), (F.col("d") + pad_y).alias("y_hi"))
    out = points.groupBy("part").agg(F.count("*").alias("n"), F.avg("o_c").alias("mean_o_c"),
                                     F.avg("h_c").alias("mean_h_c"))
    return with_facts(out, facts)


def composition_margins(points: DataFrame, bins: int = 20) -> DataFrame:
    """(part, axis, bin, cnt, density): filled bins of each marginal distribution."""
    from uqframe.functions.exprs import bin_number

    long = points.unpivot(["part"], ["o_c", "h_c"], "axis", "value")
    span = long.groupBy("part", "axis").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                            F.count("*").alias("n"))
    rows = long.join(F.broadcast(span), ["part", "axis"])  # two parts, two axes
    number = bin_number(F.col("value"), F.col("lo"), F.col("hi"), bins)
    out = rows.groupBy("part", "axis", number.alias("bin")).agg(
        F.count("*").alias("cnt"), F.max("n").alias("n"), F.max("hi").alias("hi"),
        F.max("lo").alias("lo"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / float(bins)
    return out.select("part", "axis", "bin", "cnt", (F.col("cnt") / (F.col("n") * width)).alias("density"))
