"""Response surface workflow: candidates, report blocks, surfaces, optima and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.constants import RATIOS
from uqframe.functions.exprs import atomic_ratio
from uqframe.operators.skew import attach
from uqframe.operators.surfaces import (
    BLOCK, block_candidates, block_metrics, block_rows, block_tags, fit_surfaces,
    surface_optimum, target_label, top_blocks,
)


def surface_report(df: DataFrame, target: str, prediction: str, x: str = "temp_c",
                   y: str = "t_min", k: int = 10, max_blocks: int = 20, min_points: int = 8,
                   candidates: DataFrame | None = None, n_grid: int = 80,
                   digits: int | None = None) -> DataFrame:
    """One row per report block: ranges, optimum, fit metrics, tags, units and label.

    The ``k`` best candidates are tried; blocks whose surface cannot be fitted drop out, and
    the first ``max_blocks`` of the others make the report. Rows are restricted to the
    candidates by a semi-join before fitting.
    """
    if candidates is None:
        candidates = block_candidates(df, target, x, y, min_points=min_points)
    best = top_blocks(candidates, target, k)
    chosen = F.broadcast(best.select(*BLOCK))  # k rows
    rows = df.join(chosen, BLOCK, "left_semi")
    points = block_rows(rows, x, y, target, prediction)
    fitted = fit_surfaces(points)
    if max_blocks < k:
        fits = best.join(fitted.select(*BLOCK), BLOCK, "left_semi")
        fitted = fitted.join(F.broadcast(top_blocks(fits, target, max_blocks).select(*BLOCK)), BLOCK, "left_semi")
    out = surface_optimum(fitted, target, n_grid, digits=digits)
    out = attach(out, block_metrics(points).drop("n"), BLOCK, bounded=True)
    out = attach(out, block_tags(rows), BLOCK, bounded=True)
    units, label = target_label(target)
    return out.withColumns({"target": F.lit(target), "units": F.lit(units), "label": F.lit(label)})


def with_ratio(df: DataFrame, ratio: str, prediction: str = "p_") -> DataFrame:
    """Add a ratio target and its prediction from the elements, where they are absent."""
    if ratio not in RATIOS:
        return df
    num, den, phase = ratio.split("_")
    new = {}
    if ratio not in df.columns:
        for c in (f"{num}_{phase}", f"{den}_{phase}"):
            if c not in df.columns:
                raise KeyError(f"missing column {c}")
        new[ratio] = atomic_ratio(f"{num}_{phase}", f"{den}_{phase}", num, den)
    if prediction + ratio not in df.columns:
        for c in (f"{prediction}{num}_{phase}", f"{prediction}{den}_{phase}"):
            if c not in df.columns:
                raise KeyError(f"missing prediction {c}")
        new[prediction + ratio] = atomic_ratio(
            f"{prediction}{num}_{phase}", f"{prediction}{den}_{phase}", num, den)
    return df.withColumns(new) if new else df


def ratio_surface_report(df: DataFrame, ratio: str, prediction: str = "p_", **options) -> DataFrame:
    return surface_report(with_ratio(df, ratio, prediction), ratio, prediction + ratio, **options)
