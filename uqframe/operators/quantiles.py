"""Exact quantiles with linear interpolation, without holding a group in one task.

Spark's ``percentile`` keeps one map entry per distinct value of a group, which fails for
a group with billions of distinct doubles. Here a pilot pass sketches each group and brackets
every wanted rank between two values, a fixed small share of the rows apart, however the values
are spread. One exact pass then counts the rows of each stretch between these values, and the
different values inside the brackets only; the wanted ranks are found in these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uqframe.functions.exprs import finite
from uqframe.operators.skew import attach, fits
from uqframe.sources.session import cut_lineage

#: Rank error of the sketch is one in ACCURACY; brackets reach SLACK to either side, which is
#: at least a few ranks for keys of more than FEW_ROWS rows.
ACCURACY, SLACK, FEW_ROWS = 10_000, 4e-4, 20_000
STEPS = 1 << 12


def value_code(v: Column) -> Column:
    """Order-preserving integer code with 4096 even logarithmic steps per octave."""
    step = F.floor(F.log2(F.abs(v)) * F.lit(float(STEPS))) + F.lit(1100 * STEPS)
    return F.when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step).cast("bigint")


def long_values(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by…, variable, value) with only finite values."""
    wide = df.select(*by, *[finite(F.col(c).cast("double")).alias(c) for c in values])
    if len(values) == 1:
        out = wide.withColumn("variable", F.lit(values[0])).withColumnRenamed(values[0], "value")
        out = out.select(*by, "variable", "value")
    else:
        out = wide.unpivot(by, values, "variable", "value")
    return out.where(F.col("value").isNotNull())


def _brackets(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys…, n, edges, narrow): for each key the sorted ends of its brackets, and which of the
    stretches between them (the ones beside them included) lie inside a bracket. A key of few rows
    is one bracket as a whole."""
    low = [max(0.0, p - SLACK) for p in probs]
    high = [min(1.0, p + SLACK) for p in probs]
    sketch = F.percentile_approx("value", F.array(*map(F.lit, [*low, *high])), F.lit(ACCURACY))
    pilot = long.groupBy(*keys).agg(F.count("*").alias("n"), sketch.alias("at"))
    ends = F.arrays_zip(F.slice("at", 1, len(probs)).alias("lo"), F.slice("at", len(probs) + 1, len(probs)).alias("hi"))
    none = F.array().cast("array<double>")
    few = F.col("n") <= FEW_ROWS
    pilot = pilot.withColumns({"ends": ends, "edges": F.when(few, none).otherwise(
        F.array_sort(F.array_distinct("at")))})
    inside = F.transform("edges", lambda e, i: F.exists("ends", lambda s: (
        (s["lo"] < e) & (e <= s["hi"]) & (F.get("edges", i - 1) >= s["lo"]))))
    narrow = F.when(few, F.array(F.lit(True))).otherwise(F.concat(inside, F.array(F.lit(False))))
    return pilot.select(*keys, "n", "edges", narrow.alias("narrow"))


def rank_values(long: DataFrame, keys: list[str], wanted: list[Column], probs: list[float],
                bounded: bool) -> DataFrame:
    """For each key and each wanted zero-based position (an expression over ``n``) the value
    at the whole rank below it and the one above it: (keys…, slot, pos, n, v_lo, v_hi).

    ``probs`` says about where the positions lie, as shares of the rows: within a few ranks.
    """
    brackets = _brackets(long, keys, probs)
    if bounded:
        placed = attach(long, brackets, keys, "inner", bounded=True)
    else:  # the pilot has counted the keys: few are broadcast, and no row moves
        brackets = cut_lineage(brackets, "brackets")
        placed = attach(long, brackets, keys, "inner", bounded=fits(brackets), counts=brackets.select(*keys, "n"))
    # odd cells are single ends of brackets, even ones the stretches between them
    below = F.size(F.filter("edges", lambda e: e < F.col("value")))
    placed = placed.select(*keys, "n", "value", "narrow", below.alias("below"),
                           F.coalesce(F.get("edges", below) == F.col("value"), F.lit(False)).alias("at_edge"))
    looked_at = F.col("at_edge") | F.get("narrow", F.col("below"))
    counted = placed.groupBy(
        *keys, "n", (2 * F.col("below") + F.col("at_edge").cast("int")).alias("cell"),
        F.when(looked_at, F.col("value")).alias("exact")).agg(
        F.count("*").alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
    # the same aggregates as below, so that both read one exchange
    cells = counted.groupBy(*keys, "n", "cell").agg(
        F.sum("c").alias("cnt"), F.min("least").alias("from"), F.max("most").alias("to"))
    running = Window.partitionBy(*keys).orderBy("cell")  # a few cells per wanted position
    cells = cells.withColumn("before", F.sum("cnt").over(running) - F.col("cnt"))
    slots = F.array(*[
        F.struct(F.lit(i).alias("slot"), w.cast("double").alias("pos"))
        for i, w in enumerate(wanted)
    ])
    hit = cells.withColumn("s", F.explode(slots)).select(
        *keys, "cell", "n", "before", "cnt", "from", "to", "s.slot", "s.pos",
        F.floor("s.pos").alias("r_lo"), F.ceil("s.pos").alias("r_hi"),
    )
    end = F.col("before") + F.col("cnt")
    hit = hit.where(
        ((F.col("r_lo") >= F.col("before")) & (F.col("r_lo") < end))
        | ((F.col("r_hi") >= F.col("before")) & (F.col("r_hi") < end))
    )
    inside = counted.drop("n").withColumn("upto", F.sum("c").over(
        Window.partitionBy(*keys, "cell").orderBy("exact")))  # the different values of a bracket
    found = attach(inside, hit.drop("cnt"), [*keys, "cell"], "inner", bounded=bounded, salted=False)
    first = F.col("before") + F.col("upto") - F.col("c")
    last = F.col("before") + F.col("upto")

    def value_at(rank: str) -> Column:
        here = (F.col(rank) >= first) & (F.col(rank) < last)
        # a stretch that was only counted still knows its two ends
        value = F.when(F.col("least") == F.col("most"), F.col("least")).when(
            F.col(rank) == first, F.greatest("least", "from")).when(
            F.col(rank) == last - 1, F.least("most", "to")).otherwise(
            F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
        return F.max(F.when(here, value))

    return found.groupBy(*keys, "slot").agg(
        F.max("pos").alias("pos"), F.max("n").alias("n"),
        value_at("r_lo").alias("v_lo"), value_at("r_hi").alias("v_hi"))


def exact_quantiles(df: DataFrame, values: list[str], probs: list[float],
                    by: list[str] = ()) -> DataFrame:
    """(by…, variable, prob, n, q): exact quantiles per group and column.

    Nulls, NaN and infinities are left out. A group without values has no row.
    """
    by = list(by)
    keys = [*by, "variable"]
    wanted = [F.lit(float(p)) * (F.col("n") - 1).cast("double") for p in probs]
    ranked = rank_values(long_values(df, values, by), keys, wanted, list(probs), bounded=not by)
    share = F.col("pos") - F.floor("pos")
    names = F.array(*[F.lit(float(p)) for p in probs])
    return ranked.select(
        *keys,
        F.element_at(names, F.col("slot") + 1).alias("prob"),
        "n",
        (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * share).alias("q"),
    )


def quantile_columns(df: DataFrame, values: list[str], probs: dict[str, float],
                     by: list[str] = ()) -> DataFrame:
    """Wide form: one row per (by…, variable) with one column per named probability."""
    by = list(by)
    q = exact_quantiles(df, values, list(probs.values()), by)
    return q.groupBy(*by, "variable").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(name)
          for name, p in probs.items()],
    )


def nth_smallest(df: DataFrame, value: str, n: Column, prob: float) -> DataFrame:
    """One row: the value at the zero-based position ``n`` (an expression over ``n``, the
    count of rows), which lies about at the share ``prob`` of the rows."""
    ranked = rank_values(long_values(df, [value], []), ["variable"], [n], [prob], bounded=True)
    return ranked.select(F.col("v_lo").alias("value"), "n")
