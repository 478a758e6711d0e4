"""Plausible ranges per row (envelopes), distributions against them, and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.constants import (
    ENERGY_CAP_SLACK, ENERGY_CARBON, ENERGY_ENVELOPES, ENERGY_PROCESS_RULES, ENVELOPE_LOWER,
    MASS_BALANCE_RANGE, QUALITY_RULES, YIELD_CAP_SLACK, YIELD_ENVELOPES, YIELD_PROCESS_RULES,
    YIELDS,
)
from uqframe.functions.exprs import bin_number, norm_text, to_number
from uqframe.operators.cleaning import read_json
from uqframe.operators.columns import ensure_columns, process_label
from uqframe.operators.physics import DERIVED

# names that the JSON envelope uses for our columns
JSON_NAMES = {"e_b": "E_B_range", "e_h": "E_H_range", "c_b": "C_B_range", "c_h": "C_H_range",
              "b_y": "B_Y_range", "c_y": "C_Y_range", "a_y": "A_Y_range", "g_y": "G_Y_range"}
JSON_SCHEMA = ("QA struct<envelope: struct<"
               + ", ".join(f"{n}: array<double>" for n in JSON_NAMES.values()) + ">>")


def process_class(label: Column, rules: list) -> Column:
    """Process family of a label; the first rule that matches wins."""
    text, out = norm_text(label), None
    for name, parts, exact in rules:
        test = F.lit(False)
        for part in parts:
            test = test | text.contains(part)
        if exact:
            test = test | (text == exact)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("other"))


def default_upper(kind: Column, table: dict, name: str) -> Column:
    out = None
    for process, uppers in table.items():
        test = kind == process
        out = F.when(test, F.lit(uppers[name])) if out is None else out.when(test, F.lit(uppers[name]))
    return out


def default_lower(kind: Column, name: str) -> Column:
    out = F.lit(0.0)
    for (process, column), low in ENVELOPE_LOWER.items():
        if column == name:
            out = F.when(kind == process, F.lit(low)).otherwise(out)
    return out


def energy_cap(name: str) -> Column:
    """Upper end from the row's own measurements; null unless both inputs exist."""
    amount, factor, divisor = DERIVED[name]
    value = to_number(amount) / 100.0 * (to_number(factor) / F.lit(divisor))
    cap = value * F.lit(1.0 + ENERGY_CAP_SLACK)
    return F.when(cap.isNotNull(), F.greatest(F.lit(0.0), cap))


def yield_cap(name: str) -> Column:
    """What the other three yields leave of 100; null unless all three exist."""
    others = [to_number(c) for c in YIELDS if c != name]
    left = F.lit(100.0) - (others[0] + others[1] + others[2])
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), left) * F.lit(1.0 + YIELD_CAP_SLACK))


def add_envelopes(df: DataFrame, kind: str = "energy") -> DataFrame:
    """Add ``<column>_lo`` and ``<column>_hi``.

    An envelope in the JSON column ``extra`` comes first: the ranges it does not name are
    the defaults of the process, and measurements are then not looked at. Otherwise a cap
    from the row's measurements goes before the default.
    """
    energy = kind == "energy"
    columns = ENERGY_CARBON if energy else YIELDS
    table, rules = ((ENERGY_ENVELOPES, ENERGY_PROCESS_RULES) if energy
                    else (YIELD_ENVELOPES, YIELD_PROCESS_RULES))
    cap = energy_cap if energy else yield_cap
    inputs = [c for y, f, _ in DERIVED.values() for c in (y, f)] if energy else YIELDS
    df = ensure_columns(df, ["extra", "process_type_a", "process_type_b"], "string")
    df = ensure_columns(df, [*inputs, *columns])
    out = df.withColumns({
        "_json": read_json("extra", JSON_SCHEMA)["QA"]["envelope"],
        "_any": F.get_json_object("extra", "$.QA.envelope"),
        "_kind": process_class(process_label(), rules),
    })
    explicit = F.col("_any").isNotNull() & ~F.col("_any").isin("{}", "")
    new = {}
    for c in columns:
        pair = F.col("_json")[JSON_NAMES[c]]
        low, high = default_lower(F.col("_kind"), c), default_upper(F.col("_kind"), table, c)
        named = explicit & pair.isNotNull()
        own = cap(c)
        new[c + "_lo"] = F.when(named, F.get(pair, F.lit(0))).when(
            explicit | own.isNull(), low).otherwise(F.lit(0.0))
        new[c + "_hi"] = F.when(named, F.get(pair, F.lit(1))).when(
            explicit | own.isNull(), high).otherwise(own)
    return out.withColumns(new).drop("_json", "_any", "_kind")


def envelope_bounds(df: DataFrame, kind: str = "energy") -> DataFrame:
    """(variable, lo, hi): smallest lower and largest upper end over all rows, one pass."""
    columns = ENERGY_CARBON if kind == "energy" else YIELDS
    one = add_envelopes(df, kind).agg(
        *[F.min(c + "_lo").alias(c + "_lo") for c in columns],
        *[F.max(c + "_hi").alias(c + "_hi") for c in columns])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c + "_lo").alias("lo"),
                 F.col(c + "_hi").alias("hi")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def envelope_histogram(df: DataFrame, kind: str = "energy", bins: int = 40) -> DataFrame:
    """(variable, bin, cnt, env_lo, env_hi): filled bins of each column's values and the
    global envelope to draw around them."""
    columns = ENERGY_CARBON if kind == "energy" else YIELDS
    df = ensure_columns(df, columns)
    rows = df.select(*[to_number(c).alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value").where(F.col("value").isNotNull())
    span = rows.groupBy("variable").agg(F.min("value").alias("v_lo"), F.max("value").alias("v_hi"))
    facts = span.join(F.broadcast(envelope_bounds(df, kind)), "variable")  # one row per column
    placed = rows.join(F.broadcast(facts), "variable")
    number = bin_number(F.col("value"), F.col("v_lo"), F.col("v_hi"), bins)
    return placed.groupBy("variable", number.alias("bin")).agg(
        F.count("*").alias("cnt"), F.max("lo").alias("env_lo"), F.max("hi").alias("env_hi"))


def mass_balance(df: DataFrame) -> DataFrame:
    """One row (checked, violations): rows with all yields and those that miss 100."""
    low, high = MASS_BALANCE_RANGE
    total = F.col(YIELDS[0])
    for c in YIELDS[1:]:
        total = total + F.col(c)
    return df.agg(F.count(total).alias("checked"),
                  F.count_if((total < low) | (total > high)).alias("violations"))


def rule_test(column: str, low: float | None, high: float | None) -> Column:
    v, test = to_number(column), F.lit(False)
    if low is not None:
        test = test | (v < low)
    if high is not None:
        test = test | (v > high)
    return F.coalesce(test, F.lit(False))


def rule_counts(df: DataFrame, rules: list = QUALITY_RULES) -> DataFrame:
    """(rule, n_rows) for every rule, in one pass."""
    df = ensure_columns(df, [c for _, c, _, _ in rules])
    one = df.agg(*[F.count_if(rule_test(c, lo, hi)).alias(n) for n, c, lo, hi in rules])
    return one.unpivot([], [n for n, *_ in rules], "rule", "n_rows")


def rule_violations(df: DataFrame, keep: list[str], rules: list = QUALITY_RULES) -> DataFrame:
    """One row per broken rule: (keep…, rule)."""
    df = ensure_columns(df, [c for _, c, _, _ in rules])
    broken = F.array_compact(F.array(*[
        F.when(rule_test(c, lo, hi), F.lit(n)) for n, c, lo, hi in rules]))
    return df.select(*keep, F.explode(broken).alias("rule"))


