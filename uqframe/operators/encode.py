"""Feature engineering as column expressions and small aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.constants import (
    BIOCHAR, BIOOIL, CATALYST_RATIO, CORE_INTERACTIONS, ELEMENTAL_INTERACTIONS,
    GROUPING_COLUMNS, SMALL_SAMPLE, TEMPERATURE_EDGES,
)
from uqframe.functions.exprs import (
    frac_to_logit, logit_to_frac, logit_to_pct, pct_to_logit, row_sum, to_number,
    yeo_johnson, yeo_johnson_inverse,
)
from uqframe.operators.columns import catalyst_columns, complete_rows, present, with_prefix
from uqframe.operators.quantiles import long_values, quantile_columns
from uqframe.operators.skew import attach, with_facts


def add_interactions(df: DataFrame, elemental: bool = True,
                     pairs: list[tuple[str, str, str]] | None = None
                     ) -> tuple[DataFrame, list[str]]:
    """Products of column pairs (nulls count as 0) with a 0/1 flag for a missing side."""
    if pairs is None:
        pairs = CORE_INTERACTIONS + (ELEMENTAL_INTERACTIONS if elemental else [])
    new: dict[str, Column] = {}
    for name, left, right in pairs:
        if left not in df.columns or right not in df.columns:
            continue
        a, b = to_number(left), to_number(right)
        new[name] = F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))
        new[name + "_missing"] = (a.isNull() | b.isNull()).cast("int")
    return (df.withColumns(new) if new else df), list(new)


def learn_domain(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct labels of a categorical column, each of which becomes a column."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def label_name(prefix: str, label: str) -> str:
    return f"{prefix}{label}"


def one_hot(df: DataFrame, column: str, domain: list[str], prefix: str) -> DataFrame:
    """0/1 columns in domain order plus one for null; unseen labels have only zeros."""
    c = F.col(column)
    new = {label_name(prefix, v): F.when(c == F.lit(v), 1.0).otherwise(0.0) for v in domain}
    new[prefix + "nan"] = F.when(c.isNull(), 1.0).otherwise(0.0)
    return df.withColumns(new)


def decode_one_hot(columns: list[str], prefix: str, training: bool = True) -> Column:
    """Label of the largest column, the first one winning a tie.

    The training variant also names all-zero rows, nan and the empty label ``Unknown``;
    the other variant does so for the empty label only.
    """
    top = F.greatest(*[F.col(f"`{c}`") for c in columns]) if len(columns) > 1 else F.col(f"`{columns[0]}`")
    label = F.coalesce(*[
        F.when(F.col(f"`{c}`") == top, F.lit(c.removeprefix(prefix))) for c in columns
    ])
    if not training:
        return F.when(label == "", F.lit("Unknown")).otherwise(label)
    empty = row_sum([F.col(f"`{c}`") for c in columns]) == 0
    return F.when(empty | label.isin("nan", ""), F.lit("Unknown")).otherwise(label)


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present(df, columns)
    })


def fill_with_indicator(df: DataFrame, columns: list[str]) -> DataFrame:
    new: dict[str, Column] = {}
    for c in present(df, columns):
        new[c + "_missing"] = F.col(c).isNull().cast("int")
        new[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns(new)


def fill_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
        for c in present(df, columns)
    })


def flag_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_ones, pct) of 0/1 columns, in one pass."""
    parts = [F.sum(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.coalesce(F.col(f"s{i}"), F.lit(0.0)).cast("double").alias("ones"))
        for i, c in enumerate(columns)
    ]))
    return one.select("n", rows.alias("r")).select(
        "r.column", F.round("r.ones").cast("bigint").alias("n_ones"),
        F.coalesce(F.try_divide(F.col("r.ones") * 100.0, F.col("n")), F.lit(0.0)).alias("pct"),
    )


def target_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    """(target, n): non-null rows per target, in one pass."""
    targets = present(df, targets)
    one = df.agg(*[F.count(t).alias(t) for t in targets])
    return one.unpivot([], targets, "target", "n")


@dataclass
class Features:
    """A feature matrix with its manifest: which columns are X and which are Y."""

    df: DataFrame
    x_cols: list[str]
    y_cols: list[str]
    domains: dict[str, list[str]] = field(default_factory=dict)


def build_features(df: DataFrame, numeric: list[str], solvent_numeric: list[str],
                   solvent_flags: list[str], targets: list[str], use_tier: bool = False,
                   use_family: bool = True, use_basis: bool = True,
                   domains: dict[str, list[str]] | None = None,
                   keep: list[str] = ("row_id",)) -> Features:
    """One lazy projection holding X, Y and the grouping columns.

    Category domains are learned once and can be passed in again at scoring time, so
    that the same manifest comes out. Rows missing a core numeric feature are dropped.
    """
    domains = dict(domains or {})
    family = "family_std" if "family_std" in df.columns else "family"
    categories = [("tier", "tier_", use_tier), ("process_subtype", "subtype_", True),
                  (family, "family_", use_family)]
    numeric = present(df, numeric)
    core = complete_rows(df, numeric)
    x: dict[str, Column] = {c: F.col(c).cast("double") for c in numeric}
    for column, prefix, wanted in categories:
        if not wanted or column not in df.columns:
            continue
        if prefix not in domains:
            domains[prefix] = learn_domain(df, column)
        c = F.col(column)
        for v in domains[prefix]:
            x.setdefault(label_name(prefix, v), F.when(c == F.lit(v), 1.0).otherwise(0.0))
        x.setdefault(prefix + "nan", F.when(c.isNull(), 1.0).otherwise(0.0))

    def zeroed(names: list[str]) -> None:
        for c in names:
            x.setdefault(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))

    zeroed(with_prefix(df, "solv_", ordered=True))
    if use_basis:
        zeroed(with_prefix(df, "basis_", ordered=True))
    for c in present(df, solvent_numeric):
        x.setdefault(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        x.setdefault(c + "_missing", F.col(c).isNull().cast("double"))
    for c in present(df, solvent_flags):
        x.setdefault(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double"))
    zeroed(catalyst_columns(df))
    zeroed(present(df, [CATALYST_RATIO]))
    zeroed(with_prefix(df, "int_"))

    y_cols = present(df, targets)
    extra = [c for c in present(df, [*keep, *GROUPING_COLUMNS]) if c not in x and c not in y_cols]
    out = core.select(*extra, *[e.alias(n) for n, e in x.items()], *y_cols)
    return Features(out, list(x), y_cols + present(df, GROUPING_COLUMNS), domains)


def pairwise_design(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """The features and the product of every pair of them; no squares, no constant."""
    names = list(features)
    new = {}
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            new[f"{a}*{b}"] = F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double")
    return df.withColumns(new), names + list(new)


def temperature_bin(c: Column, edges: list[float] = TEMPERATURE_EDGES) -> Column:
    """Zero-based bin, right-closed, the first one closed on both sides; null outside."""
    out = F.when(c < edges[0], None)
    for i, high in enumerate(edges[1:]):
        out = out.when(c <= high, F.lit(i))
    return out


def sample_weights(df: DataFrame, strategy: str | None = "balance_temperature",
                   temperature: str = "temp_c") -> DataFrame:
    """Add ``weight``: 1, or one over the size of the row's temperature bin.

    A missing temperature counts as the median; one outside all bins has weight 1. Small
    samples are scaled up as a whole.
    """
    small, boost = SMALL_SAMPLE
    if strategy is None:
        out = df.withColumn("weight", F.lit(1.0))
    elif strategy == "balance_temperature":
        median = quantile_columns(df, [temperature], {"median": 0.5}).select("median")
        filled = with_facts(df, median).withColumn(
            "_bin", temperature_bin(F.coalesce(F.col(temperature), F.col("median"))))
        counts = filled.groupBy("_bin").agg(F.count("*").alias("_n"))
        out = attach(filled, counts, ["_bin"], bounded=True)  # one row per bin
        out = out.withColumn("weight", F.when(F.col("_bin").isNull(), F.lit(1.0)).otherwise(
            F.lit(1.0) / F.col("_n"))).drop("_bin", "_n", "median")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    total = df.agg(F.count("*")).scalar()
    return out.withColumn(
        "weight", F.col("weight") * F.when(total < small, F.lit(boost)).otherwise(F.lit(1.0)))


@dataclass(frozen=True)
class TargetTransform:
    """A label transform and its inverse, both column expressions."""

    kind: str
    lam: float | None = None

    def apply(self, c: str | Column) -> Column:
        return {"fraction": frac_to_logit, "percent": pct_to_logit,
                "power": lambda v: yeo_johnson(v, self.lam),
                "identity": lambda v: F.col(v) if isinstance(v, str) else v}[self.kind](c)

    def invert(self, c: str | Column) -> Column:
        return {"fraction": logit_to_frac, "percent": logit_to_pct,
                "power": lambda v: yeo_johnson_inverse(v, self.lam),
                "identity": lambda v: F.col(v) if isinstance(v, str) else v}[self.kind](c)


def transform_kind(target: str) -> str:
    """Which transform a target is trained under. Ratios stay as they are: the percent
    transform would move every ratio below 0.1 up to 0.1."""
    if target in ("c_b", "c_h"):
        return "fraction"
    if "hhv" in target:
        return "power"
    return "percent" if target in BIOOIL + BIOCHAR else "identity"


#: Rows that a task transforms at a time.
POWER_ROWS = 16384
POWER_SUMS = [f"{c} double" for c in ("lam", "n", "mean", "m2", "jac", "least", "most")]


def _power_sums(grid: np.ndarray):
    """Per task and power: count, mean and squared deviations of the transformed values, the sum of
    the logarithms in the transform's derivative, and the ends of the values. The logarithm of a
    value is taken once for all powers."""
    def run(batches):
        parts, ends, jac = [[] for _ in grid], [], 0.0
        for whole in batches:
            values = whole["value"].to_numpy()
            for at in range(0, len(values), POWER_ROWS):
                v = values[at:at + POWER_ROWS]
                up = v >= 0
                logs = np.log1p(np.abs(v))
                plus, minus = logs[up], logs[~up]
                jac += float(plus.sum() - minus.sum())
                ends = [min([v.min(), *ends[:1]]), max([v.max(), *ends[1:]])]
                for k, sums in zip(grid, parts):
                    with np.errstate(all="ignore"):
                        high = plus if abs(k) < 1e-12 else np.expm1(k * plus) / k
                        low = -minus if abs(k - 2.0) < 1e-12 else -np.expm1((2.0 - k) * minus) / (2.0 - k)
                        z = np.concatenate([high, low])
                        mean = z.mean()
                        sums.append((len(z), mean, ((z - mean) ** 2).sum()))
                        if len(sums) > 256:
                            sums[:] = [_added_sums(sums)]
        if ends:
            with np.errstate(all="ignore"):
                columns = [grid, *np.array([_added_sums(sums) for sums in parts]).T]
            columns += [np.full(len(grid), x) for x in (jac, *ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in POWER_SUMS])

    return run


def _added_sums(sums: list[tuple]) -> tuple:
    """Count, mean and squared deviations of all rows from those of parts of them."""
    n, mean, m2 = np.array(sums, float).T
    whole = (n * mean).sum() / n.sum()
    return n.sum(), whole, (m2 + n * (mean - whole) ** 2).sum()


def power_profile(df: DataFrame, column: str, candidates: list[float]) -> DataFrame:
    """(lam, n, loglik): profile log-likelihood of every candidate power, in one pass that
    only shuffles one partial row per candidate and task."""
    grid = np.array([float(v) for v in candidates])
    values = long_values(df, [column], []).select("value")
    parts = values.mapInArrow(_power_sums(grid), ", ".join(POWER_SUMS))
    whole = parts.groupBy("lam").agg(  # one row per task
        F.collect_list(F.struct("n", "mean", "m2")).alias("parts"), F.sum("n").alias("n"), F.sum("jac").alias("jac"),
        (F.min("least") == F.max("most")).alias("flat"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * p["mean"])
    whole = whole.withColumn("mean", total / F.col("n"))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), 2))
    v = F.when(F.col("flat"), F.lit(0.0)).otherwise(spread / F.col("n"))
    fit = F.lit(-0.5) * F.col("n") * F.log("v") + (F.col("lam") - 1.0) * F.col("jac")
    return whole.withColumn("v", v).select(
        "lam", F.col("n").cast("long").alias("n"), F.when(F.col("v") > 0, fit).alias("loglik"))


#: Powers beyond this overflow on ordinary values.
WIDEST_POWER = 100.0


def fit_power(df: DataFrame, column: str, low: float = -4.0, high: float = 6.0,
              points: int = 21, rounds: int = 4) -> float:
    """The power of largest likelihood, by narrowing a grid; each round is one pass. While
    the best point lies on the grid's edge, the grid moves and grows instead."""
    best, done = 1.0, 0
    while done < rounds:
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        top = power_profile(df, column, grid).where(F.col("loglik").isNotNull()).orderBy(
            F.desc("loglik"), "lam").limit(1).collect()
        if not top:
            return 1.0
        best = top[0]["lam"]
        if done == 0 and best in (grid[0], grid[-1]) and abs(best) < WIDEST_POWER:
            low, high = best - (high - low), best + (high - low)
            continue
        done += 1
        low, high = best - step, best + step
    return best


def choose_transform(df: DataFrame, target: str) -> TargetTransform:
    kind = transform_kind(target)
    return TargetTransform(kind, fit_power(df, target) if kind == "power" else None)
