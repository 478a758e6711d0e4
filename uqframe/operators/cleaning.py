"""Cleaning: identifiers, yield basis, outlier clipping and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.constants import BASIS_YIELDS
from uqframe.functions.exprs import normalize_id
from uqframe.operators.quantiles import long_values, quantile_columns


def normalize_ids(df: DataFrame, column: str = "doi", strict: bool = False) -> DataFrame:
    return df.withColumn(column, normalize_id(column, strict))


def effective_ash(df: DataFrame, ash: str = "ash", imputed: str = "ash_imputed") -> Column:
    return F.coalesce(F.col(ash), F.col(imputed)) if imputed in df.columns else F.col(ash)


def basis_to_dry(df: DataFrame, yields: list[str] = BASIS_YIELDS) -> DataFrame:
    """Yields on an ash-free basis become dry-basis yields: times 1 - ash / 100.

    Rows without ash, or whose factor is not in (0, 1], keep their values and basis.
    """
    factor = F.lit(1.0) - effective_ash(df) / 100.0
    ok = F.coalesce((F.col("basis_class") == "daf") & (factor > 0) & (factor <= 1), F.lit(False))
    out = df.withColumns({"_f": factor, "_ok": ok})
    changed = {c: F.when(F.col("_ok"), F.col(c) * F.col("_f")).otherwise(F.col(c))
               for c in yields if c in df.columns}
    for name, value in (("basis_daf", 0.0), ("basis_dry_basis", 1.0)):
        if name in df.columns:
            changed[name] = F.when(F.col("_ok"), F.lit(value)).otherwise(F.col(name))
    if "yield_fill_method" in df.columns:
        tagged = F.concat(F.coalesce("yield_fill_method", F.lit("")), F.lit(";daf_to_dry"))
        changed["yield_fill_method"] = F.when(F.col("_ok"), tagged).otherwise(
            F.col("yield_fill_method"))
    changed["basis_class"] = F.when(F.col("_ok"), F.lit("dry_basis")).otherwise(
        F.col("basis_class"))
    return out.withColumns(changed).drop("_f", "_ok")


def clipped_values(df: DataFrame, columns: list[str],
                   clip: tuple[float, float] | None) -> DataFrame:
    """(variable, value): finite values of the columns inside their own quantile bounds.

    Rows keep their order of magnitude only inside the inclusive bounds; the bounds table
    has one row per column, so it is broadcast.
    """
    long = long_values(df, columns, [])
    if clip is None:
        return long
    bounds = quantile_columns(df, columns, {"low": clip[0], "high": clip[1]}).drop("n")
    joined = long.join(F.broadcast(bounds), "variable")
    return joined.where(F.col("value").between(F.col("low"), F.col("high"))).select(
        "variable", "value")


def read_json(c: str | Column, schema: str) -> Column:
    """JSON text to a struct; null or unreadable text gives null fields."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})
