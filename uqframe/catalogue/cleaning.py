"""Projections, predicates, name checks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import experiments, measured, r6, rnd, with_e, with_m
from uqframe.constants import OVERVIEW_PANELS
from uqframe.functions.exprs import norm_text, normalize_id, to_number
from uqframe.operators import cleaning, columns
from uqframe.operators.envelopes import rule_test
from uqframe.operators.metrics import frequency, overview_stats

MANIFEST = ["temp_c", "t_min", "pressure_effective_mpa", "b_y", "lri"]
CORE = ["temp_c", "ic", "ash", "lignin"]
CONFIGURED = {"family": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "TINY"],
              "feedstock": ["AF", "AO", "NF", "NO", "RF", "RO"],
              "basis_class": ["daf", "dry_basis", "carbon_basis", "other", "unknown"]}


def align(spark, sf):
    """A fixed manifest from whatever columns exist."""
    df = columns.drop_prefix(experiments(spark, sf), "basis_")
    df = columns.ensure_columns(df, ["moisture_min"])
    df = columns.select_present(df, ["row_id", "temp_c", "temp_c", "t_min", "b_y", "moisture_min",
                                     "absent"])
    return columns.align_features(df, MANIFEST, keep=["row_id"])


def rename(spark, sf):
    """C4: legacy names."""
    df = experiments(spark, sf).select(
        "row_id", F.col("temp_c").alias("temperature"), F.col("t_min").alias("time"),
        F.col("b_y").alias("oil_yield"), F.col("c_y").alias("char_yield"))
    return columns.rename_legacy(df)


def coerce(spark, sf):
    """Numbers hidden in text; anything else is null."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("nan")).when(
        F.col("o_orderkey") % 7 == 0, F.lit(" 12.5 ")).otherwise(
        F.substring("o_orderpriority", 1, 1))
    df = orders.select("o_orderkey", text.alias("code"), F.col("o_orderpriority").alias("label"),
                       F.col("o_totalprice").alias("price"))
    return columns.coerce_numeric(df, ["code", "label", "price"])


def prefixes(spark, sf):
    """Encoding columns by family, in configured order, as totals."""
    df = experiments(spark, sf)
    names = (columns.catalyst_columns(df) + columns.with_prefix(df, "solv_", ordered=True)
             + columns.with_prefix(df, "basis_", ordered=True))
    one = df.agg(*[F.sum(c).alias(c) for c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"),
                                        F.col(c).alias("total")) for i, c in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def complete(spark, sf):
    """Complete core rows, and trainable rows per target."""
    df = experiments(spark, sf, part=True)
    core = columns.complete_rows(df, CORE + ["absent"])
    out = core.agg(F.count("*").alias("n")).withColumn("target", F.lit("(core)"))
    for t in ("b_y", "a_y", "g_y"):
        part = columns.rows_for_target(df, t, CORE).agg(F.count("*").alias("n"))
        out = out.unionByName(part.withColumn("target", F.lit(t)))
    return out


def membership(spark, sf):
    """Selected families of one subtype, by frequency."""
    df = columns.members(experiments(spark, sf, part=True), "family", ["LARGE", "PROMO", "SMALL"])
    return frequency(columns.flagged(df, "subtype_htc"), "process_subtype")


def fallback(spark, sf):
    """C14: alternative columns only where the first choice has no value at all."""
    df = experiments(spark, sf).select(
        "row_id", F.lit(None).cast("double").alias("temp_c"), F.col("temp_c").alias("temp_c_alt"),
        "t_min", (F.col("t_min") * 2).alias("t_min_alt"))
    df = columns.fallback_column(df, "temp_c", "temp_c_alt")
    return columns.fallback_column(df, "t_min", "t_min_alt").select("row_id", "temp_c", "t_min")


def labels(spark, sf):
    """Row-level process labels, both readings of missing."""
    df = experiments(spark, sf).select(
        columns.process_label().alias("label"), columns.process_tag().alias("tag"),
        columns.first_present("process_type_b", "feedstock").alias("present"))
    return df.groupBy("label", "tag", "present").agg(F.count("*").alias("n"))


def audit(spark, sf):
    """Configured labels against the labels in the data."""
    df = experiments(spark, sf, part=True)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label"))
                      for c in CONFIGURED])
    seen = df.select(F.explode(pairs).alias("r")).select("r.*").where("label is not null").distinct()
    rows = [(c, v) for c, values in CONFIGURED.items() for v in values]
    known = spark.createDataFrame(rows, "column string, label string")
    return columns.name_audit(known, seen, ["column", "label"])


def untrained(spark, sf):
    """C17: expected targets for which the data gives no result."""
    df = experiments(spark, sf)
    expected = ["b_y", "c_y", "a_y", "g_y", "n_biooil", "s_biooil"]
    columns.check_targets(expected, 6)
    have = columns.present(df, expected)
    found = df.agg(*[F.count(c).alias(c) for c in have]).unpivot([], have, "target", "n")
    return columns.untrained_targets(found.where("n >= 30"), expected)


def preview(spark, sf):
    """The first violating rows."""
    df = measured(experiments(spark, sf, part=True))
    return columns.preview(df, rule_test("e_b", None, 8.0),
                           ["row_id", "feedstock", "temp_c", "e_b", "source_figure"], 5, ["row_id"])


def ids(spark, sf):
    """Identifiers."""
    df = experiments(spark, sf).select("row_id", "doi", F.col("doi").alias("strict"))
    df = cleaning.normalize_ids(df, "doi")
    return cleaning.normalize_ids(df, "strict", strict=True)


def page_ids(spark, sf):
    """D1 on web addresses turned into identifiers."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    doi = F.regexp_replace("url", "^https?://[a-z]+[.]", "HTTPS://DOI.org/")
    return pages.select("page_id", normalize_id(doi).alias("id"), normalize_id("url").alias("url"))


def basis(spark, sf):
    """Ash-free yields to dry basis."""
    df = cleaning.basis_to_dry(experiments(spark, sf))
    return df.select("row_id", "b_y", "c_y", "a_y", "g_y", "basis_class", "basis_daf",
                     "basis_dry_basis", "yield_fill_method")


def overview(spark, sf):
    """Statistics per panel after quantile clipping."""
    df = experiments(spark, sf, part=True)
    return rnd(overview_stats(df, OVERVIEW_PANELS), "mean", "std", "min", "max")


def json_text(spark, sf):
    """Tolerant JSON and text."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("not json")).when(
        F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("props"))
    kind = F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    df = events.select(norm_text(kind).alias("event_type"),
                       cleaning.read_json(broken, "k double")["k"].alias("k"))
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum(to_number("k")).alias("sum_k"))


def _overview_sql() -> str:
    have = {"A_feedstock": ["c", "h", "o", "ash", "lignin"], "B_conditions": ["ic", "temp_c", "t_min"],
            "C_yields": ["b_y", "a_y", "g_y", "c_y"],
            "D_biooil": ["c_biooil", "h_biooil", "o_biooil", "hhv_biooil"],
            "E_biochar": ["c_biochar", "h_biochar", "o_biochar", "hhv_biochar"]}
    clip = {name: c for name, _, c in OVERVIEW_PANELS}
    parts = []
    for panel, names in have.items():
        for c in names:
            keep = ""
            if clip[panel]:
                lo, hi = clip[panel]
                keep = (f" AND {c} >= (SELECT quantile_cont({c}, {lo}) FROM e)"
                        f" AND {c} <= (SELECT quantile_cont({c}, {hi}) FROM e)")
            parts.append(
                f"SELECT '{panel}' AS panel, '{c}' AS variable, count(*) AS n, {r6(f'avg({c})')} AS mean, "
                f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max "
                f"FROM e WHERE {c} IS NOT NULL{keep}")
    return with_e(" UNION ALL ".join(parts))


_BASIS_OK = ("coalesce(basis_class = 'daf' AND 1 - coalesce(ash, ash_imputed) / 100 > 0 "
             "AND 1 - coalesce(ash, ash_imputed) / 100 <= 1, false)")
_AUDIT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{v}' AS label" for c, vs in CONFIGURED.items() for v in vs)
_PREFIXES = "'^(https://doi[.]org/|http://doi[.]org/|http://dx[.]doi[.]org/|dx[.]doi[.]org/|doi:)'"
_STRICT = _PREFIXES.replace("^(", "^(https://dx[.]doi[.]org/|")

QUERIES = {
    "align_features": (align, with_e(
        "SELECT row_id, temp_c, t_min, cast(0 as double) AS pressure_effective_mpa, b_y, "
        "cast(0 as double) AS lri FROM e")),
    "rename_legacy": (rename, with_e("SELECT row_id, temp_c, t_min, b_y, c_y FROM e")),
    "numeric_coercion": (coerce, """
SELECT o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0
 then cast(12.5 as double) else try_cast(substr(o_orderpriority, 1, 1) as double) end AS code,
 cast(null as double) AS label, o_totalprice AS price FROM orders"""),
    "encoding_columns": (prefixes, with_e(" UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS name, sum({c}) AS total FROM e" for i, c in enumerate(
            ["cat_acid", "cat_metal", "cat_is_base", "solv_ethanol", "solv_methanol",
             "basis_daf", "basis_dry_basis", "basis_unknown"])))),
    "complete_rows": (complete, with_e(
        "SELECT '(core)' AS target, count(*) AS n FROM e WHERE temp_c IS NOT NULL AND ic IS NOT "
        "NULL AND ash IS NOT NULL AND lignin IS NOT NULL" + "".join(
            f" UNION ALL SELECT '{t}', count(*) FROM e WHERE {t} IS NOT NULL AND temp_c IS NOT NULL "
            "AND ic IS NOT NULL AND ash IS NOT NULL AND lignin IS NOT NULL"
            for t in ("b_y", "a_y", "g_y")))),
    "membership_filter": (membership, with_e(
        "SELECT process_subtype, count(*) AS n FROM e WHERE family IN ('LARGE', 'PROMO', 'SMALL') "
        "AND subtype_htc = 1 GROUP BY 1 ORDER BY n DESC, 1")),
    "fallback_columns": (fallback, with_e("SELECT row_id, temp_c, t_min FROM e")),
    "process_labels": (labels, with_e(
        "SELECT coalesce(process_type_a, process_type_b) AS label, "
        "case when lower(process_type_a) is null or lower(process_type_a) in ('nan', 'none') "
        "then lower(process_type_b) else lower(process_type_a) end AS tag, "
        "coalesce(process_type_b, feedstock) AS present, count(*) AS n FROM e GROUP BY 1, 2, 3")),
    "coverage_audit": (audit, with_e(f"""
, k AS ({_AUDIT_SQL}),
 o AS (SELECT DISTINCT 'family' AS "column", family AS label FROM e WHERE family IS NOT NULL
 UNION SELECT DISTINCT 'feedstock', feedstock FROM e
 UNION SELECT DISTINCT 'basis_class', basis_class FROM e)
SELECT *, 'missing' AS status FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM o)
 UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM k)""")),
    "untrained_targets": (untrained, with_e("""
, f AS (SELECT 'b_y' AS target, count(b_y) AS n FROM e UNION ALL SELECT 'c_y', count(c_y) FROM e
 UNION ALL SELECT 'a_y', count(a_y) FROM e UNION ALL SELECT 'g_y', count(g_y) FROM e)
SELECT t AS target FROM (VALUES ('b_y'), ('c_y'), ('a_y'), ('g_y'), ('n_biooil'), ('s_biooil')) v(t)
 WHERE t NOT IN (SELECT target FROM f WHERE n >= 30)""")),
    "violation_preview": (preview, with_m(
        "SELECT row_id, feedstock, temp_c, e_b FROM m WHERE e_b > 8 ORDER BY row_id LIMIT 5")),
    "normalize_ids": (ids, with_e(
        f"SELECT row_id, regexp_replace(lower(trim(doi)), {_PREFIXES}, '') AS doi, "
        f"trim(regexp_replace(lower(trim(doi)), {_STRICT}, '')) AS strict FROM e")),
    "normalize_page_ids": (page_ids, f"""
SELECT page_id, regexp_replace(lower(trim(regexp_replace(url, '^https?://[a-z]+[.]',
 'HTTPS://DOI.org/'))), {_PREFIXES}, '') AS id,
 regexp_replace(lower(trim(url)), {_PREFIXES}, '') AS url FROM pages"""),
    "basis_to_dry": (basis, with_e(
        "SELECT row_id, " + ", ".join(
            f"case when {_BASIS_OK} then {c} * (1 - coalesce(ash, ash_imputed) / 100) else {c} end AS {c}"
            for c in ("b_y", "c_y", "a_y", "g_y"))
        + f", case when {_BASIS_OK} then 'dry_basis' else basis_class end AS basis_class"
        + f", case when {_BASIS_OK} then cast(0 as double) else basis_daf end AS basis_daf"
        + f", case when {_BASIS_OK} then cast(1 as double) else basis_dry_basis end AS basis_dry_basis"
        + f", case when {_BASIS_OK} then coalesce(yield_fill_method, '') || ';daf_to_dry' "
        "else yield_fill_method end AS yield_fill_method FROM e")),
    "clip_overview_stats": (overview, _overview_sql()),
    "text_and_json": (json_text, """
, """.join(["""WITH v AS (SELECT trim(lower(coalesce(case when event_id % 6 = 0 then null
 else '  ' || upper(event_type) || ' ' end, ''))) AS event_type,
 case when event_id % 10 = 0 then 'not json' when event_id % 11 = 0 then null else props end AS j
 FROM events)""", """w AS (SELECT event_type, case when json_valid(j)
 then try_cast(json_extract_string(j, '$.k') as double) end AS k FROM v)
SELECT event_type, count(*) AS n, count(k) AS n_k, sum(k) AS sum_k FROM w GROUP BY 1"""])),
}
