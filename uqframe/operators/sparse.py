"""Sparse feature vectors for categories with any number of labels.

The labels of a column are a table with a slot each; it is joined and never listed on the driver,
and no label becomes a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from uqframe.operators.skew import attach, fits
from uqframe.operators.splits import ranked

ENTRIES = "array<struct<slot:int,value:double>>"


def label_slots(df: DataFrame, categories: list[str], offset: int = 0) -> DataFrame:
    """(column, label, slot): every label that occurs in the columns, and one null label per
    column, numbered from ``offset`` in the order of column, label, null last.

    The table is the domain of a model: write it, and pass it in again at scoring time.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))
                      for c in categories])
    seen = df.select(F.explode(pairs).alias("p")).select("p.*").where("label is not null")
    names = df.sparkSession.createDataFrame([(c, None) for c in categories], "column string, label string")
    rows = ranked(seen.distinct().unionByName(names), F.col("column"), F.asc_nulls_last("label"))
    return rows.select("column", "label", (F.col("rank") + offset).cast("int").alias("slot"))


def width(slots: DataFrame, numeric: list[str]) -> int:
    """Length of the vectors: the numeric columns and all slots."""
    return len(numeric) + slots.count()


def sparse_entries(df: DataFrame, numeric: list[str], slots: DataFrame, categories: list[str],
                   name: str = "entries") -> DataFrame:
    """Rows with ``name``, their (slot, value) pairs in the order of slots, without zeros.

    Numeric columns have the slots before the labels (``slots`` made with ``offset=len(numeric)``);
    nulls and values that are not finite count as 0. A label has value 1 in its slot, a null in the
    null's; an unseen label has no entry. A slot's label may hold any share of the rows.
    """
    found, plain, small = [], df, fits(slots)
    for i, c in enumerate(categories):
        own = slots.where(F.col("column") == c).select(
            F.col("label").alias(f"_label_{i}"), F.col("slot").alias(f"_slot_{i}"))
        label = F.col(c).cast("string").alias(f"_label_{i}")
        counts = plain.groupBy(label).agg(F.count("*").alias("n"))  # not of rows joined before
        df = attach(df.select("*", label), own, [f"_label_{i}"], bounded=small, counts=counts)
        df = df.drop(f"_label_{i}")
        found.append(F.struct(F.col(f"_slot_{i}").alias("slot"), F.lit(1.0).alias("value")))
    numbers = [F.struct(F.lit(i).alias("slot"), F.col(c).cast("double").alias("value"))
               for i, c in enumerate(numeric)]
    pairs = F.array(*numbers, *found).cast(ENTRIES)
    infinite = F.lit(float("inf"))
    used = F.filter(pairs, lambda e: e["slot"].isNotNull() & e["value"].isNotNull() & (e["value"] != 0)
                    & ~F.isnan(e["value"]) & (F.abs(e["value"]) < infinite))
    out = df.withColumn(name, F.array_sort(used))
    return out.drop(*[f"_slot_{i}" for i in range(len(categories))])


def sparse_vectors(df: DataFrame, size: int, entries: str = "entries",
                   name: str = "features") -> DataFrame:
    """Turn the entries into a vector column ``name`` of length ``size`` that Spark ML reads.

    The columns of a sparse vector are made by expressions; the Arrow pass only gives
    them the vector's type and looks at no row.
    """
    e = F.col(entries)
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     F.transform(e, lambda p: p["slot"]).alias("indices"),
                     F.transform(e, lambda p: p["value"]).alias("values"))
    rows = df.withColumn(name, parts).drop(entries)
    fields = [f if f.name != name else StructField(name, VectorUDT()) for f in rows.schema]

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    return rows.mapInArrow(same, StructType(fields))


def sparse_features(df: DataFrame, numeric: list[str], categories: list[str],
                    slots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a sparse ``features`` column, and the slots it was made with."""
    if slots is None:
        slots = label_slots(df, categories, len(numeric))
    rows = sparse_entries(df, numeric, slots, categories)
    return sparse_vectors(rows, width(slots, numeric)), slots
