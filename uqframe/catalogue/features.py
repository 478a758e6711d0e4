"""Feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import experiments, number, r6, rnd, with_e
from uqframe.constants import BASE_NUMERIC, SOLVENT_FLAGS, SOLVENT_NUMERIC, TARGETS
from uqframe.functions.exprs import atomic_ratio, frac_to_logit, logit_to_frac, logit_to_pct, pct_to_logit
from uqframe.operators import encode, sparse
from uqframe.sources.session import cut_lineage

FAMILIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
LAMBDAS = [-1.0 + 0.25 * i for i in range(13)]


def interactions(spark, sf):
    """Products with missing flags."""
    df, names = encode.add_interactions(experiments(spark, sf, part=True))
    return df.select("row_id", *names)


def one_hot(spark, sf):
    """One column per family and one for null."""
    df = experiments(spark, sf, part=True)
    domain = encode.learn_domain(df, "family")
    out = encode.one_hot(df, "family", domain, "family_")
    out = encode.zero_fill(out, ["solv_methanol"])
    return out.select("row_id", *[f"family_{v}" for v in domain], "family_nan", "solv_methanol")


SPARSE = (["temp_c", "frac_water"], ["family", "process_subtype", "doi"])


def sparse_matrix(spark, sf):
    """Sparse features of all labels of three columns, summed by slot."""
    df = cut_lineage(experiments(spark, sf, part=True).select(*SPARSE[0], *SPARSE[1]), "labels")
    slots = sparse.label_slots(df, SPARSE[1], len(SPARSE[0]))
    entries = sparse.sparse_entries(df, SPARSE[0], slots, SPARSE[1])
    entries = entries.select(F.explode("entries").alias("e")).select("e.*")
    totals = entries.groupBy("slot").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = totals.join(slots, "slot", "left")
    return rnd(out.select("slot", "column", "label", "n", "total"), "total", digits=4)


def decode(spark, sf):
    """Labels back from the one-hot columns, both variants."""
    df = experiments(spark, sf, part=True)
    seen = FAMILIES[:-1]
    out = encode.one_hot(df, "family", seen, "family_")
    names = [f"family_{v}" for v in seen] + ["family_nan"]
    out = out.select(encode.decode_one_hot(names, "family_").alias("training"),
                     encode.decode_one_hot(names, "family_", training=False).alias("analysis"))
    return out.groupBy("training", "analysis").agg(F.count("*").alias("n"))


def flags(spark, sf):
    """Ones and their share."""
    df = experiments(spark, sf)
    out = encode.flag_counts(df, ["cat_acid", "cat_metal", "cat_is_base", "solv_ethanol", "solv_methanol"])
    return rnd(out, "pct")


def indicators(spark, sf):
    """Fills with indicators."""
    df = encode.fill_with_indicator(experiments(spark, sf), ["frac_water", "acid_m"])
    df = encode.fill_flags(df, ["acid_flag", "base_flag"])
    return df.select("row_id", "frac_water", "frac_water_missing", "acid_flag")


def counts(spark, sf):
    """Rows per target."""
    return encode.target_counts(experiments(spark, sf, part=True), TARGETS)


def matrix(spark, sf):
    """The whole feature matrix, checked by column totals."""
    df, _ = encode.add_interactions(experiments(spark, sf, part=True))
    out = encode.build_features(df, BASE_NUMERIC, SOLVENT_NUMERIC, SOLVENT_FLAGS, TARGETS,
                                domains={"subtype_": ["Brand#1", "Brand#2"]})
    names = out.x_cols
    one = out.df.agg(F.count("*").alias("n"), *[F.sum(F.col(f"`{c}`")).alias(f"s{i}")
                                                for i, c in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                                        F.col("n").alias("n"), F.round(f"s{i}", 4).alias("total"))
                               for i, c in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def design(spark, sf):
    """Pairwise products."""
    df = experiments(spark, sf).select("row_id", "temp_c", "t_min", "o_c", "h_c")
    out, names = encode.pairwise_design(df, ["temp_c", "t_min", "o_c", "h_c"])
    return out.select("row_id", *[F.col(f"`{n}`").alias(n.replace("*", "_x_")) for n in names])


def weights(spark, sf):
    """Inverse bin frequency, missing temperatures at the median."""
    df = experiments(spark, sf).select(
        "row_id", F.when(F.col("t_min") == 35, None).otherwise(F.col("temp_c")).alias("temp_c"))
    return encode.sample_weights(df).select("row_id", "weight")


def logits(spark, sf):
    """Logit transforms and back."""
    df = experiments(spark, sf)
    out = df.select(
        "row_id", frac_to_logit(F.col("b_y") / 50).alias("z_frac"),
        pct_to_logit(F.col("c_y")).alias("z_pct"))
    out = out.withColumns({"frac": logit_to_frac("z_frac"), "pct": logit_to_pct("z_pct")})
    return rnd(out, "z_frac", "z_pct", "frac", "pct", digits=9)


def power(spark, sf):
    """Profile likelihood over a grid of powers."""
    return rnd(encode.power_profile(experiments(spark, sf), "hhv_biooil", LAMBDAS), "loglik", digits=3)


def transforms(spark, sf):
    """Every target under its own label transform and back."""
    df = experiments(spark, sf, part=True)
    out = df.select("row_id")
    parts = []
    for t in ("b_y", "c_biooil", "o_biooil", "hhv_biochar"):
        how = encode.choose_transform(df, t)
        parts.append(F.struct(F.lit(t).alias("target"), F.lit(how.kind).alias("kind"), F.col(t).alias("y"),
                              how.invert(how.apply(t)).alias("back")))
    out = df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    return out.groupBy("target", "kind").agg(
        F.count("y").alias("n"), F.round(F.max(F.abs(F.col("y") - F.col("back"))), 6).alias("max_error"))


def ratios(spark, sf):
    """Atomic ratios, measured and from predictions."""
    df = experiments(spark, sf, part=True)
    out = df.select(
        "row_id", atomic_ratio("o_biooil", "c_biooil", "o", "c").alias("o_c_biooil"),
        atomic_ratio("h_biochar", "c_biochar", "h", "c").alias("h_c_biochar"),
        atomic_ratio(F.col("o_biooil") * 1.05, F.col("c_biooil") - 1, "o", "c").alias("p_o_c_biooil"))
    return rnd(out, "o_c_biooil", "h_c_biochar", "p_o_c_biooil", digits=9)


def _matrix_sql() -> str:
    core = ["o_c", "h_c", "ash", "o", "c", "h", "temp_c", "ic", "lignin"]
    numeric = ["o_c", "h_c", "ash", "o", "c", "h", "temp_c", "t_min", "ic", "lignin"]
    x = [(c, c) for c in numeric]
    x += [(f"subtype_{b}", f"case when process_subtype = '{b}' then 1.0 else 0.0 end")
          for b in ("Brand#1", "Brand#2")]
    x += [("subtype_nan", "case when process_subtype is null then 1.0 else 0.0 end")]
    x += [(f"family_{v}", f"case when family = '{v}' then 1.0 else 0.0 end") for v in FAMILIES]
    x += [("family_nan", "case when family is null then 1.0 else 0.0 end")]
    x += [(c, f"coalesce({c}, 0)") for c in ("solv_ethanol", "solv_methanol", "basis_daf",
                                             "basis_dry_basis", "basis_unknown")]
    x += [("frac_water", "coalesce(frac_water, 0)"),
          ("frac_water_missing", "case when frac_water is null then 1.0 else 0.0 end"),
          ("acid_flag", "case when acid_flag then 1.0 else 0.0 end")]
    x += [(c, f"coalesce({c}, 0)") for c in ("cat_acid", "cat_metal", "cat_is_base", "cat_ratio_log10")]
    for n, a, b in _pairs():
        x += [(n, f"coalesce({a}, 0) * coalesce({b}, 0)"),
              (n + "_missing", f"case when {a} is null or {b} is null then 1.0 else 0.0 end")]
    where = " AND ".join(f"{c} IS NOT NULL" for c in core)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{n}' AS feature, count(*) AS n, round(sum(cast({s} as double)), 4) AS total FROM g"
        for i, (n, s) in enumerate(x))
    return with_e(f", g AS (SELECT * FROM e WHERE {where}) {rows}")


def _pairs() -> list[tuple[str, str, str]]:
    return [("int_t_ic", "temp_c", "ic"), ("int_t_lignin", "temp_c", "lignin"),
            ("int_t_h_over_c", "temp_c", "h_c"), ("int_t_o_over_c", "temp_c", "o_c"),
            ("int_t_c", "temp_c", "c"), ("int_t_h", "temp_c", "h"), ("int_t_o", "temp_c", "o"),
            ("int_t_ash", "temp_c", "ash"), ("int_ash_lignin", "ash", "lignin"),
            ("int_ash_c", "ash", "c")]


_PAIR_SQL = ", ".join(
    f"coalesce({a}, 0) * coalesce({b}, 0) AS {n}, "
    f"cast({a} is null or {b} is null as integer) AS {n}_missing" for n, a, b in _pairs())
_LABEL = "case when family = 'STANDARD' then 'Unknown' when family is null then 'Unknown' else family end"
_TARGETS = ["b_y", "c_y", "a_y", "g_y", "hhv_biooil", "c_biooil", "o_biooil", "h_biooil",
            "hhv_biochar", "c_biochar", "o_biochar", "h_biochar"]
_BIN = "case when t < 0 then null when t <= 250 then 0 when t <= 300 then 1 when t <= 350 then 2 when t <= 1000 then 3 end"
_NAMES = ["temp_c", "t_min", "o_c", "h_c"]
_DESIGN = ", ".join(f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])


def _clip(x: str) -> str:
    return f"least(greatest({x}, {number(1e-3)}), {number(1 - 1e-3)})"


_YJ = ("case when abs(lam) < 1e-12 then ln(1 + hhv_biooil) "
       "else (pow(hhv_biooil + 1, lam) - 1) / lam end")

QUERIES = {
    "interactions": (interactions, with_e(f"SELECT row_id, {_PAIR_SQL} FROM e")),
    "onehot_encode": (one_hot, with_e(
        "SELECT row_id, " + ", ".join(
            f"cast(coalesce(family = '{v}', false) as double) AS family_{v}" for v in FAMILIES)
        + ", cast(family is null as double) AS family_nan, coalesce(solv_methanol, 0) AS solv_methanol FROM e")),
    "onehot_decode": (decode, with_e(
        f"SELECT {_LABEL} AS training, case when family = 'STANDARD' then 'ECONOMY' "
        "when family is null then 'nan' else family end AS analysis, count(*) AS n FROM e GROUP BY 1, 2")),
    "sparse_matrix": (sparse_matrix, with_e(f"""
, p AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c} AS v FROM e" for c in SPARSE[1])}),
 d AS (SELECT DISTINCT c, v FROM p WHERE v IS NOT NULL UNION ALL
 SELECT unnest([{', '.join(f"'{c}'" for c in SPARSE[1])}]), null),
 s AS (SELECT *, cast(row_number() OVER (ORDER BY c, v NULLS LAST) + 1 as integer) AS slot FROM d),
 t AS (SELECT c, v, count(*) AS n FROM p GROUP BY 1, 2)
SELECT slot, c AS "column", s.v AS label, n, cast(n as double) AS total FROM s JOIN t USING (c)
 WHERE s.v IS NOT DISTINCT FROM t.v
"""
        + " UNION ALL ".join(["", *[
            f"SELECT {i}, null, null, count(*), round(sum({c}), 4) FROM e WHERE {c} <> 0"
            for i, c in enumerate(SPARSE[0])]]))),
    "flag_counts": (flags, with_e(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast(sum({c}) as bigint) AS n_ones, "
        f"{r6(f'100 * sum({c}) / count(*)')} AS pct FROM e"
        for c in ("cat_acid", "cat_metal", "cat_is_base", "solv_ethanol", "solv_methanol")))),
    "missing_indicators": (indicators, with_e(
        "SELECT row_id, coalesce(frac_water, 0) AS frac_water, cast(frac_water is null as integer) "
        "AS frac_water_missing, cast(coalesce(acid_flag, false) as integer) AS acid_flag FROM e")),
    "target_counts": (counts, with_e(" UNION ALL ".join(
        f"SELECT '{t}' AS target, count({t}) AS n FROM e" for t in _TARGETS))),
    "feature_matrix": (matrix, _matrix_sql()),
    "pairwise_design": (design, with_e(f"SELECT row_id, {', '.join(_NAMES)}, {_DESIGN} FROM e")),
    "temperature_weights": (weights, with_e(f"""
, t0 AS (SELECT row_id, case when t_min = 35 then null else temp_c end AS temp FROM e),
 t1 AS (SELECT row_id, coalesce(temp, (SELECT quantile_cont(temp, 0.5) FROM t0)) AS t FROM t0),
 t2 AS (SELECT row_id, {_BIN} AS bin FROM t1)
SELECT row_id, case when bin is null then cast(1 as double) else cast(1 as double) / count(*) OVER
 (PARTITION BY bin) end * case when (SELECT count(*) FROM e) < 600 then 1.5 else 1 end AS weight FROM t2""")),
    "logit_roundtrip": (logits, with_e(f"""
, z AS (SELECT row_id, ln({_clip('b_y / 50')} / (1 - {_clip('b_y / 50')})) AS z_frac,
 ln({_clip('c_y / 100')} / (1 - {_clip('c_y / 100')})) AS z_pct FROM e)
SELECT row_id, round(z_frac, 9) AS z_frac, round(z_pct, 9) AS z_pct,
 round({_clip('1 / (1 + exp(-z_frac))')}, 9) AS frac,
 round(100 * {_clip('1 / (1 + exp(-z_pct))')}, 9) AS pct FROM z""")),
    "power_transform_profile": (power, with_e(f"""
, l AS (SELECT unnest([{', '.join(number(v) for v in LAMBDAS)}]) AS lam)
SELECT lam, count(*) AS n, round(-0.5 * count(*) * ln(var_pop({_YJ}))
 + (lam - 1) * sum(ln(1 + hhv_biooil)), 3) AS loglik FROM e, l GROUP BY lam""")),
    "target_transforms": (transforms, with_e(" UNION ALL ".join(
        f"SELECT '{t}' AS target, '{k}' AS kind, count({t}) AS n, cast(0 as double) AS max_error FROM e"
        for t, k in (("b_y", "identity"), ("c_biooil", "percent"), ("o_biooil", "percent"),
                     ("hhv_biochar", "power"))))),
    "atomic_ratios": (ratios, with_e(
        "SELECT row_id, round((o_biooil / 15.999) / (c_biooil / 12.011), 9) AS o_c_biooil, "
        "round((h_biochar / 1.008) / (c_biochar / 12.011), 9) AS h_c_biochar, "
        "round((o_biooil * 1.05 / 15.999) / ((c_biooil - 1) / 12.011), 9) AS p_o_c_biooil FROM e")),
}
