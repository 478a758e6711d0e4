"""Projections, predicates and name-level checks that tolerate a changing schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from uqframe.constants import (
    CATALYST_CLASSES, CATALYST_DESCRIPTORS, CATALYST_RATIO, LEGACY_NAMES,
)
from uqframe.functions.exprs import to_number

# columns that only look like members of an encoding family
NOT_ENCODED = {CATALYST_RATIO, "basis_class"}


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in order, each once."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*present(df, wanted))


def ensure_columns(df: DataFrame, wanted: list[str], dtype: str = "double") -> DataFrame:
    missing = [c for c in dict.fromkeys(wanted) if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(dtype) for c in missing}) if missing else df


def align_features(df: DataFrame, manifest: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the manifest's features in its order: missing ones are 0.0, others go."""
    features = [
        F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c)
        for c in dict.fromkeys(manifest)
    ]
    return df.select(*keep, *features)


def rename_legacy(df: DataFrame, names: dict[str, str] = LEGACY_NAMES) -> DataFrame:
    return df.withColumnsRenamed(names)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def with_prefix(df: DataFrame, prefix: str, ordered: bool = False) -> list[str]:
    names = [c for c in df.columns if c.startswith(prefix) and c not in NOT_ENCODED]
    return sorted(names) if ordered else names


def catalyst_columns(df: DataFrame) -> list[str]:
    """Coarse classes, then descriptor flags, then every other catalyst column."""
    return present(df, CATALYST_CLASSES + CATALYST_DESCRIPTORS + with_prefix(df, "cat_"))


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*with_prefix(df, prefix))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=present(df, columns))


def readable_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` reads as a finite number, with that number in it.

    A double is only filtered: conditions on a replaced column are pushed below it with its whole
    expression, and three references per step triple that expression each time rows are read again.
    """
    if df.schema[column].dataType != DoubleType():
        return df.withColumn(column, to_number(column)).where(F.col(column).isNotNull())
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def rows_for_target(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Rows on which a target can be trained: a readable target and no missing feature."""
    return readable_rows(df, target).dropna(subset=list(features))


def members(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def flagged(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) == 1)


def fallback_column(df: DataFrame, column: str, other: str) -> DataFrame:
    """Take ``other`` for the whole column, only if ``column`` is absent or has no value."""
    if column not in df.columns:
        return df.withColumn(column, F.col(other))
    filled = df.agg(F.count(column)).scalar()
    return df.withColumn(column, F.when(filled > 0, F.col(column)).otherwise(F.col(other)))


def process_label(primary: str = "process_type_a", other: str = "process_type_b") -> Column:
    """Row-level choice that only looks at null: an empty label is kept."""
    return F.coalesce(F.col(primary), F.col(other))


def process_tag(primary: str = "process_type_a", other: str = "process_type_b") -> Column:
    """Lower-case label that also treats the words nan and none as missing."""
    low = F.lower(F.col(primary))
    return F.when(low.isNull() | low.isin("nan", "none"), F.lower(F.col(other))).otherwise(low)


def first_present(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns])


def name_audit(configured: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Both set differences: configured but not observed, and observed but not configured."""
    missing = configured.select(*by).exceptAll(observed.select(*by))
    extra = observed.select(*by).exceptAll(configured.select(*by))
    return missing.withColumn("status", F.lit("missing")).unionByName(
        extra.withColumn("status", F.lit("extra"))
    )


def check_targets(expected: list[str], count: int) -> None:
    if len(expected) != count:
        raise ValueError(f"{len(expected)} targets are configured, {count} are expected")


def untrained_targets(results: DataFrame, expected: list[str]) -> DataFrame:
    """Expected targets without a result row."""
    spark = results.sparkSession
    names = spark.createDataFrame([(t,) for t in expected], "target string")
    return F.broadcast(names).join(results.select("target").distinct(), "target", "left_anti")


def preview(df: DataFrame, condition: Column, columns: list[str], n: int,
            order: list[str]) -> DataFrame:
    """The first ``n`` rows, by ``order``, that meet a condition."""
    return df.where(condition).orderBy(*order).limit(n).select(*present(df, columns))


