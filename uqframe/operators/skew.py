"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of the rows, and more rows than this.
HEAVY_SHARE, HEAVY_ROWS = 1 / 64, 4096
MAX_LIST_ROWS = 100_000


def fits(df: DataFrame, limit: int = MAX_LIST_ROWS) -> bool:
    """Whether a list that the user passes in is small enough to broadcast: it is counted,
    no further than the limit."""
    return df.limit(limit + 1).count() <= limit


def heavy_keys(counts: DataFrame, on: list[str], rows: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(on…, _parts): the keys that hold a large share of the rows, fewer than ``1 / share``, and
    into how many parts of at most that share they are cut."""
    limit = F.greatest(counts.agg(F.sum(rows)).scalar() * share, F.lit(HEAVY_ROWS))
    return counts.where(F.col(rows) > limit).select(
        *on, F.ceil(F.col(rows) / limit).cast("int").alias("_parts"))


def _same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[k]) for c, k in keys.items()])


def _with_parts(df: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    keys = {c: f"_h_{i}" for i, c in enumerate(on)}
    marked = F.broadcast(heavy.withColumnsRenamed(keys))  # fewer than 1 / HEAVY_SHARE rows
    return df.join(marked, _same(df, marked, keys), "left").drop(*keys.values())


def copied(small: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``small`` with ``_salt_k``: those of heavy keys once per part, others once."""
    last = F.coalesce("_parts", F.lit(1)) - 1
    out = _with_parts(small, heavy, on)
    return out.withColumn("_salt_k", F.explode(F.sequence(F.lit(0), last))).drop("_parts")


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
           bounded: bool = False, salted: bool = True, salt_by: list[str] = (),
           counts: DataFrame | None = None) -> DataFrame:
    """Join per-key facts onto rows; null keys match null keys.

    ``small`` holds few rows per key. With ``bounded`` its size does not grow with the data
    and it is broadcast. Otherwise the keys of ``big`` are counted first (or come as ``counts``:
    on…, n). The rows of a heavy key are spread over parts in proportion to its share, by the
    hash of the ``salt_by`` columns or else by the task that holds them, and its facts are repeated
    once per part; all other keys are joined as they are. Not ``salted`` is a plain join, for
    sides that hold few rows per key.
    """
    keys = {c: f"_k_{i}" for i, c in enumerate(on)}
    if bounded:
        right = F.broadcast(small.withColumnsRenamed(keys))
        return big.join(right, _same(big, right, keys), how).drop(*keys.values())
    if not salted:
        right = small.withColumnsRenamed(keys)
        return big.join(right, _same(big, right, keys), how).drop(*keys.values())
    if counts is None:
        counts = big.groupBy(*on).agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, on, "n")
    spread = F.xxhash64(*salt_by) if salt_by else F.spark_partition_id()
    left = _with_parts(big, heavy, on)
    left = left.withColumn("_salt", F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int"))
    left = left.drop("_parts")
    right = copied(small, heavy, on).withColumnsRenamed(keys)
    same = _same(left, right, keys) & (left["_salt"] == right["_salt_k"])
    return left.join(right, same, how).drop(*keys.values(), "_salt", "_salt_k")


def with_facts(df: DataFrame, facts: DataFrame, prefix: str = "") -> DataFrame:
    """Put the single row of a global aggregate onto every row, as a scalar subquery."""
    names = facts.columns
    row = facts.select(F.struct(*names).alias("facts")).scalar()
    out = df.withColumn("_facts", row)
    return out.withColumns({prefix + n: F.col(f"_facts.{n}") for n in names}).drop("_facts")
