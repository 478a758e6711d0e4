"""Mass balance and derived quantities on measured or predicted yields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.constants import ENERGY_CARBON, YIELDS
from uqframe.functions.exprs import row_sum
from uqframe.operators.columns import ensure_columns, present
from uqframe.operators.metrics import finite_pairs, r2, rmse

# derived target -> (yield, factor column, divisor of the factor)
DERIVED = {
    "e_b": ("b_y", "hhv_biooil", 1.0),
    "e_h": ("c_y", "hhv_biochar", 1.0),
    "c_b": ("b_y", "c_biooil", 100.0),
    "c_h": ("c_y", "c_biochar", 100.0),
}


def yield_closure(df: DataFrame, columns: list[str] = YIELDS, total: float = 100.0,
                  clip: bool = True, suffix: str = "", partial: bool = True) -> DataFrame:
    """Scale the yields of a row so that they sum to ``total``.

    ``clip`` first moves negative yields to 0. Rows whose sum is not positive are not
    scaled. Null yields stay null; with ``partial`` the others are still scaled, without
    it only rows with all yields are.
    """
    columns = present(df, columns)
    if not columns:
        return df
    raw = {c: F.col(c).cast("double") for c in columns}
    base = {c: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) if clip else v
            for c, v in raw.items()}
    out = df.withColumns({f"_b_{c}": v for c, v in base.items()})
    out = out.withColumn("_sum", row_sum([f"_b_{c}" for c in columns]))
    scale = F.col("_sum") > 0
    if not partial:
        for c in columns:
            scale = scale & F.col(f"_b_{c}").isNotNull()
    out = out.withColumns({
        c + suffix: F.when(scale, F.col(f"_b_{c}") / F.col("_sum") * F.lit(float(total)))
        .otherwise(F.col(f"_b_{c}")) for c in columns})
    return out.drop("_sum", *[f"_b_{c}" for c in columns])


def closure_error(df: DataFrame, columns: list[str] = YIELDS, total: float = 100.0,
                  name: str = "closure_error") -> DataFrame:
    """Sum of the present yields minus ``total``; null only if no yield column exists."""
    columns = present(df, columns)
    error = row_sum(columns) - F.lit(float(total)) if columns else F.lit(None).cast("double")
    return df.withColumn(name, error)


def derived_energy(df: DataFrame, yield_suffix: str = "", strict: bool = True) -> DataFrame:
    """Energy and carbon recoveries ``*_phys`` from yields, heating values and carbon.

    ``strict`` also returns columns whose inputs do not exist, as nulls.
    """
    if strict:
        df = ensure_columns(df, [c for y, f, _ in DERIVED.values() for c in (y + yield_suffix, f)])
    new = {}
    for target, (amount, factor, divisor) in DERIVED.items():
        amount = amount + yield_suffix
        if amount in df.columns and factor in df.columns:
            value = F.col(factor).cast("double")
            value = value / F.lit(divisor) if divisor != 1.0 else value
            new[target + "_phys"] = F.col(amount).cast("double") / 100.0 * value
    return df.withColumns(new) if new else df


def project_predictions(df: DataFrame) -> DataFrame:
    """Closure into ``*_phys`` yields, then the derived quantities from those; the original
    columns do not change. Without all four yields the frame comes back as it is."""
    if any(c not in df.columns for c in YIELDS):
        return df
    closed = yield_closure(df, clip=False, suffix="_phys", partial=False)
    return derived_energy(closed, yield_suffix="_phys", strict=False)


def physics_evaluation(df: DataFrame, targets: list[str], raw: str = "p_", phys: str = "q_",
                       min_rows: int = 15) -> DataFrame:
    """(target, n, r2_raw, rmse_raw, r2_phys, rmse_phys).

    Raw predictions are in ``p_<target>``, derived ones in ``q_<target>`` for energy and
    carbon targets. Two more rows hold the RMS closure error of the yields before and after
    the projection (``q_<yield>``), under the raw RMSE.
    """
    targets = [t for t in targets if raw + t in df.columns]
    rows = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                 F.col(raw + t).cast("double").alias("p"),
                 (F.col(phys + t).cast("double") if t in ENERGY_CARBON and phys + t in df.columns
                  else F.lit(None).cast("double")).alias("q"))
        for t in targets])
    long = finite_pairs(df.select(F.explode(rows).alias("r")).select("r.*"))
    both = long.withColumn("yq", F.when(F.col("q").isNotNull(), F.col("y")))
    n_q = F.count("q")
    out = both.groupBy("target").agg(
        F.count("*").alias("n"),
        *[F.when(F.count("*") >= min_rows, F.round(m, 3)).alias(k)
          for k, m in (("r2_raw", r2()), ("rmse_raw", rmse()))],
        *[F.when((F.count("*") >= min_rows) & (n_q >= min_rows), F.round(m, 3)).alias(k)
          for k, m in (("r2_phys", r2("yq", "q")), ("rmse_phys", rmse("yq", "q")))])
    names = df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    out = names.join(out, "target", "left").fillna({"n": 0})  # one row per target
    errors = {}
    for label, prefix in (("closure_raw", raw), ("closure_phys", phys)):
        errors[label] = row_sum([prefix + c for c in YIELDS if prefix + c in df.columns]) - 100.0
    one = df.agg(F.count("*").alias("n"),
                 *[F.sqrt(F.avg(e * e)).alias(label) for label, e in errors.items()])
    closure = one.unpivot(["n"], list(errors), "target", "rmse_raw")
    return out.unionByName(closure, allowMissingColumns=True)
