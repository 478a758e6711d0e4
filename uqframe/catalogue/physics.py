"""Mass balance, derived quantities, envelopes and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import (
    experiments, measured, r2_sql, r6, rmse_sql, rnd, with_e, with_m,
)
from uqframe.constants import ENERGY_CARBON, ENERGY_ENVELOPES, YIELD_ENVELOPES, YIELDS
from uqframe.operators import envelopes, physics
from uqframe.operators.envelopes import JSON_NAMES
from uqframe.plans.scoring import corrected_predictions

RAW = ["b_y", "c_y", "a_y", "g_y", "hhv_biooil", "hhv_biochar", "c_biooil", "c_biochar"]


def guessed(df):
    """Arithmetic raw predictions; some yields come out negative."""
    return df.withColumns({f"p_{t}": F.col(t) * 1.1 - F.col("t_min") / 5 for t in [*RAW, "e_b", "e_h", "c_b", "c_h"]})


def closure(spark, sf):
    """Yields projected to 100, negative ones first moved to 0."""
    df = experiments(spark, sf).withColumn("b_y", F.col("b_y") - 8)
    return rnd(physics.yield_closure(df).select("row_id", *YIELDS), *YIELDS, digits=9)


def closure_suffix(spark, sf):
    """Corrected copies beside the originals, for rows with all yields."""
    df = experiments(spark, sf, part=True)
    out = physics.project_predictions(df)
    names = [c for c in out.columns if c.endswith("_phys")]
    return out.select("row_id", "b_y", *names)


def error(spark, sf):
    """Closure error; an empty row misses all of 100."""
    df = experiments(spark, sf).withColumns(
        {c: F.when(F.col("t_min") == 25, None).otherwise(F.col(c)) for c in YIELDS})
    return rnd(physics.closure_error(df).select("row_id", "closure_error"), "closure_error", digits=9)


def derived(spark, sf):
    """Energy and carbon recoveries."""
    out = physics.derived_energy(experiments(spark, sf, part=True).drop("c_biochar"))
    names = [t + "_phys" for t in ENERGY_CARBON]
    return rnd(out.select("row_id", *names), *names, digits=9)


def evaluation(spark, sf):
    """Raw and corrected predictions against the truth."""
    df = corrected_predictions(guessed(measured(experiments(spark, sf, part=True))))
    out = physics.physics_evaluation(df, ["b_y", "c_y", *ENERGY_CARBON])
    return rnd(out, "rmse_raw")


def _resolved(kind):
    columns = ENERGY_CARBON if kind == "energy" else YIELDS

    def query(spark, sf):
        out = envelopes.add_envelopes(measured(experiments(spark, sf, part=True)), kind)
        names = [f"{c}_{e}" for c in columns for e in ("lo", "hi")]
        return rnd(out.select("row_id", *names), *names, digits=9)

    query.__doc__ = "K1-K3: ranges per row." if kind == "energy" else "K5-K7: ranges per row."
    return query


def _bounds(kind):
    def query(spark, sf):
        return rnd(envelopes.envelope_bounds(measured(experiments(spark, sf, part=True)), kind), "lo", "hi")

    return query


def _histogram(kind):
    def query(spark, sf):
        df = envelopes.envelope_histogram(measured(experiments(spark, sf, part=True)), kind)
        return rnd(df, "env_lo", "env_hi")

    return query


def balance(spark, sf):
    """K9: rows that miss 100."""
    return envelopes.mass_balance(experiments(spark, sf))


def rules(spark, sf):
    """Rule counts."""
    return envelopes.rule_counts(measured(experiments(spark, sf, part=True)))


def violations(spark, sf):
    """The rows that break rules."""
    return envelopes.rule_violations(measured(experiments(spark, sf, part=True)), ["row_id"])


def _case(kinds: str, table: dict, name: str) -> str:
    return f"case {kinds} " + " ".join(f"when '{k}' then {v[name]}" for k, v in table.items()) + " end"


_LABEL = "lower(trim(coalesce(process_type_a, process_type_b, '')))"
_KIND = (f"case when contains({_LABEL}, 'liquefaction') or {_LABEL} = 'htl' then 'liquefaction' "
         f"when contains({_LABEL}, 'hydrothermal carbon') or contains({_LABEL}, 'carbonization') or {_LABEL} = 'htc' "
         f"then 'carbonization' when contains({_LABEL}, 'pyrolysis') then 'pyrolysis' else 'other' end")
_CAPS = {"e_b": "b_y / 100 * (hhv_biooil / 1.0) * (1 + 0.05)",
         "e_h": "c_y / 100 * (hhv_biochar / 1.0) * (1 + 0.05)",
         "c_b": "b_y / 100 * (c_biooil / 100) * (1 + 0.05)",
         "c_h": "c_y / 100 * (c_biochar / 100) * (1 + 0.05)"}
for _y in YIELDS:
    _o = [c for c in YIELDS if c != _y]
    _CAPS[_y] = f"(100 - ({_o[0]} + {_o[1]} + {_o[2]}))"


def _json(column: str, i: int) -> str:
    return f"cast(json_extract_string(env, '$.{JSON_NAMES[column]}[{i}]') as double)"


def _envelope_cte(kind: str) -> str:
    columns, table = (ENERGY_CARBON, ENERGY_ENVELOPES) if kind == "energy" else (YIELDS, YIELD_ENVELOPES)
    parts = []
    for c in columns:
        cap = f"greatest(0, {_CAPS[c]})" + ("" if kind == "energy" else " * (1 + 0.02)")
        low = "case when kind = 'carbonization' then 20.0 else 0.0 end" if c == "c_y" else "0.0"
        high = _case("kind", table, c)
        parts.append(f"cast(case when env is not null then coalesce({_json(c, 0)}, {low}) "
                     f"when {_CAPS[c]} is null then {low} else 0.0 end as double) AS {c}_lo")
        parts.append(f"cast(case when env is not null then coalesce({_json(c, 1)}, {high}) "
                     f"when {_CAPS[c]} is null then {high} else {cap} end as double) AS {c}_hi")
    return (f", k AS (SELECT *, {_KIND} AS kind, case when json_valid(extra) then "
            f"json_extract(extra, '$.QA.envelope') end AS env FROM m), v AS (SELECT *, {', '.join(parts)} FROM k) ")


def _rows_sql(kind: str) -> str:
    columns = ENERGY_CARBON if kind == "energy" else YIELDS
    names = ", ".join(f"round({c}_{e}, 9) AS {c}_{e}" for c in columns for e in ("lo", "hi"))
    return with_m(_envelope_cte(kind) + f"SELECT row_id, {names} FROM v")


def _bounds_sql(kind: str) -> str:
    columns = ENERGY_CARBON if kind == "energy" else YIELDS
    return with_m(_envelope_cte(kind) + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {r6(f'min({c}_lo)')} AS lo, {r6(f'max({c}_hi)')} AS hi FROM v" for c in columns))


def _histogram_sql(kind: str) -> str:
    columns = ENERGY_CARBON if kind == "energy" else YIELDS
    return with_m(_envelope_cte(kind) + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, cast(least(floor(({c} - a) / (b - a) * 40), 39) as integer) AS bin, count(*) AS cnt, "
        f"{r6('any_value(el)')} AS env_lo, {r6('any_value(eh)')} AS env_hi FROM v, (SELECT min({c}) AS a, max({c}) AS b, "
        f"min({c}_lo) AS el, max({c}_hi) AS eh FROM v) WHERE {c} IS NOT NULL GROUP BY 2" for c in columns))


_CLIPPED = {c: f"case when {v} is not null then greatest({v}, 0) end"
            for c, v in (("b_y", "(b_y - 8)"), ("c_y", "c_y"), ("a_y", "a_y"), ("g_y", "g_y"))}
_SUM = " + ".join(f"coalesce({c}, 0)" for c in YIELDS)
_ALL = " AND ".join(f"{c} IS NOT NULL" for c in YIELDS)
_N = "(b_y + c_y + a_y + g_y)"


def _phys(c: str) -> str:
    return f"case when {_ALL} AND {_N} > 0 then {c} / {_N} * 100 else {c} end"


_GUESS = "({c} * cast('1.1' as double) - t_min / 5)"
_P = {c: _GUESS.format(c=c) for c in [*RAW, "e_b", "e_h", "c_b", "c_h"]}
_EVAL = with_m(", p AS (SELECT *, " + ", ".join(f"{v} AS p_{c}" for c, v in _P.items()) + " FROM m), "
    "c AS (SELECT *, " + ", ".join(f"case when p_{c} is not null then greatest(p_{c}, 0) end AS z_{c}" for c in YIELDS)
    + " FROM p), n AS (SELECT *, " + " + ".join(f"coalesce(z_{c}, 0)" for c in YIELDS) + " AS tot FROM c), "
    "q AS (SELECT *, " + ", ".join(f"case when tot > 0 then z_{c} / tot * 100 else z_{c} end AS q_{c}" for c in YIELDS)
    + " FROM n), r AS (SELECT *, q_b_y / 100 * p_hhv_biooil AS q_e_b, q_c_y / 100 * p_hhv_biochar AS q_e_h, "
    "q_b_y / 100 * (p_c_biooil / 100) AS q_c_b, q_c_y / 100 * (p_c_biochar / 100) AS q_c_h FROM q) "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS target, count(*) AS n, round({r2_sql(t, 'p_' + t)}, 3) AS r2_raw, "
        f"round({rmse_sql(t, 'p_' + t)}, 3) AS rmse_raw, "
        + (f"round({r2_sql(t, 'q_' + t)}, 3) AS r2_phys, round({rmse_sql(t, 'q_' + t)}, 3) AS rmse_phys"
           if t in ENERGY_CARBON else "cast(null as double) AS r2_phys, cast(null as double) AS rmse_phys")
        + f" FROM r WHERE {t} IS NOT NULL" for t in ["b_y", "c_y", *ENERGY_CARBON])
    + "".join(
        f" UNION ALL SELECT '{label}', count(*), null, "
        + r6("sqrt(avg(power(" + " + ".join(f"coalesce({p}_{c}, 0)" for c in YIELDS) + " - 100, 2)))")
        + ", null, null FROM r" for label, p in (("closure_raw", "p"), ("closure_phys", "q"))))
_RULES = {"e_h_high": "e_h > 25", "e_b_high": "e_b > 25", "b_y_range": "b_y < 0 or b_y > 100",
          "c_y_range": "c_y < 0 or c_y > 100", "c_b_high": "c_b > cast('0.6' as double)",
          "c_h_high": "c_h > cast('0.65' as double)", "hhv_input_low": "hhv_input < 12",
          "h_c_range": "h_c < cast('0.8' as double) or h_c > cast('1.9' as double)",
          "o_c_range": "o_c < cast('0.35' as double) or o_c > cast('0.95' as double)"}

QUERIES = {
    "yield_closure": (closure, with_e(
        ", c AS (SELECT row_id, " + ", ".join(f"{v} AS {c}" for c, v in _CLIPPED.items()) + f" FROM e), "
        f"t AS (SELECT *, {_SUM} AS tot FROM c) SELECT row_id, " + ", ".join(
            f"round(case when tot > 0 then {c} / tot * 100 else {c} end, 9) AS {c}" for c in YIELDS) + " FROM t")),
    "projected_predictions": (closure_suffix, with_e(
        "SELECT row_id, b_y, " + ", ".join(f"{_phys(c)} AS {c}_phys" for c in YIELDS)
        + f", {_phys('b_y')} / 100 * hhv_biooil AS e_b_phys, {_phys('c_y')} / 100 * hhv_biochar AS e_h_phys"
        + f", {_phys('b_y')} / 100 * (c_biooil / 100) AS c_b_phys, {_phys('c_y')} / 100 * (c_biochar / 100) "
        "AS c_h_phys FROM e")),
    "closure_error": (error, with_e(
        f"SELECT row_id, case when t_min = 25 then cast(-100 as double) else round({_SUM} - 100, 9) end AS closure_error FROM e")),
    "derived_energy": (derived, with_e(
        "SELECT row_id, round(b_y / 100 * hhv_biooil, 9) AS e_b_phys, round(c_y / 100 * hhv_biochar, 9) AS e_h_phys, "
        "round(b_y / 100 * (c_biooil / 100), 9) AS c_b_phys, cast(null as double) AS c_h_phys FROM e")),
    "physics_evaluation": (evaluation, _EVAL),
    "energy_envelope": (_resolved("energy"), _rows_sql("energy")),
    "yield_envelope": (_resolved("yield"), _rows_sql("yield")),
    "energy_bounds": (_bounds("energy"), _bounds_sql("energy")),
    "yield_bounds": (_bounds("yield"), _bounds_sql("yield")),
    "energy_histogram": (_histogram("energy"), _histogram_sql("energy")),
    "yield_histogram": (_histogram("yield"), _histogram_sql("yield")),
    "mass_balance": (balance, with_e(
        f"SELECT count(*) FILTER ({_ALL}) AS checked, count(*) FILTER ({_N} < 98 OR {_N} > 102) AS violations FROM e")),
    "rule_counts": (rules, with_m(" UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER ({t}) AS n_rows FROM m" for n, t in _RULES.items()))),
    "rule_violations": (violations, with_m(" UNION ALL ".join(
        f"SELECT row_id, '{n}' AS rule FROM m WHERE {t}" for n, t in _RULES.items()))),
}
