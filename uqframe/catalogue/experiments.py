"""The experiment table as a view of the driver's order tables, one row per line item.

Each column is one SQL expression that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uqframe.operators.skew import attach
from uqframe.sources.session import spread

ENVELOPE = '{"QA":{"envelope":{"E_B_range":[0.5,20.0],"B_Y_range":[5.0,60.0],"C_H_range":[0.1,0.7]}}}'

LINE_COLUMNS = {
    "row_id": "md5(concat_ws('|', "
              "cast(l_orderkey as string), cast(l_linenumber as string), "
              "cast(l_partkey as string), cast(l_suppkey as string), "
              "cast(cast(round(l_quantity) as bigint) as string), "
              "cast(cast(round(l_extendedprice * 100) as bigint) as string)))",
    "doi": "concat(case l_suppkey % 3 when 0 then 'https://doi.org/' when 1 then ' DOI:' else '' end, "
           "'10.1/S', cast(l_suppkey as string))",
    "title": "concat('Study ', cast(l_suppkey % 40 as string))",
    "feedstock": "concat(l_returnflag, l_linestatus)",
    "temp_c": "cast(180 + 4 * l_quantity as double)",
    "t_min": "cast(5 * l_linenumber as double)",
    "ic": "case when l_orderkey % 7 = 0 then null else cast(100 * l_tax as double) end",
    "ash": "case when l_orderkey % 11 = 0 then null else cast(200 * l_discount as double) end",
    "ash_imputed": "case when l_orderkey % 2 = 0 then cast(3 * l_linenumber as double) end",
    "o_c": "cast(0.4 as double) + 3 * l_discount",
    "h_c": "cast(0.9 as double) + 10 * l_tax",
    "c": "cast(40 as double) + 100 * l_discount",
    "h": "cast(5 as double) + 10 * l_tax",
    "o": "cast(45 as double) - 100 * l_discount",
    "hhv_input": "cast(10 as double) + 50 * l_tax",
    "basis_class": "case l_returnflag when 'A' then 'daf' when 'N' then 'dry_basis' else 'unknown' end",
    "basis_daf": "cast(l_returnflag = 'A' as double)",
    "basis_dry_basis": "cast(l_returnflag = 'N' as double)",
    "basis_unknown": "cast(l_returnflag = 'R' as double)",
    "yield_fill_method": "case when l_linenumber = 2 then 'reported' end",
    "process_type_a": "case l_orderkey % 4 when 0 then 'Hydrothermal liquefaction' when 1 then 'HTC' "
                      "when 2 then 'Pyrolysis' end",
    "process_type_b": "case when l_linenumber = 1 then 'Slow pyrolysis' when l_linenumber = 2 "
                      "then 'nan' when l_linenumber = 3 then ' HTL ' end",
    "extra": f"case when l_orderkey % 13 = 0 then '{ENVELOPE}' "
             "when l_orderkey % 17 = 0 then 'not json' end",
    "frac_water": "case when l_orderkey % 5 = 0 then null else cast(10 * l_discount as double) end",
    "acid_flag": "case when l_orderkey % 9 = 0 then null else l_linenumber = 3 end",
    "cat_acid": "cast(l_suppkey % 5 = 0 as double)",
    "cat_metal": "cast(l_suppkey % 3 = 0 as double)",
    "cat_is_base": "case when l_orderkey % 6 = 0 then null else cast(l_linenumber = 5 as double) end",
    "cat_ratio_log10": "case when l_orderkey % 10 = 0 then null else cast(l_tax * 10 as double) end",
    "solv_ethanol": "cast(l_suppkey % 4 = 1 as double)",
    "solv_methanol": "case when l_orderkey % 8 = 0 then null else cast(l_suppkey % 7 = 2 as double) end",
    "subtype_htc": "cast(l_orderkey % 4 = 1 as double)",
    "b_y": "cast(l_quantity as double)",
    "c_y": "cast(30 as double) + 400 * l_discount",
    "a_y": "nullif(cast(500 * l_tax as double), cast(0 as double))",
    "g_y": "case when l_linenumber % 5 = 0 then null else cast(2 * l_linenumber as double) end",
    "hhv_biooil": "cast(l_extendedprice / l_quantity / 100 as double)",
    "o_biooil": "cast(10 as double) + l_quantity / 5",
    "h_biooil": "cast(5 as double) + 20 * l_tax",
    "o_biochar": "cast(5 as double) + 100 * l_tax",
    "h_biochar": "cast(2 as double) + 20 * l_discount",
}
PART_COLUMNS = {
    "family": "case when l_orderkey % 19 = 0 then null else p_type end",
    "process_subtype": "p_brand",
    "lignin": "case when l_orderkey % 23 = 0 then null else cast(5 as double) + cast(p_size as double) / 2 end",
    "hhv_biochar": "cast(15 as double) + cast(p_size as double) / 4",
    "c_biooil": "cast(60 as double) + cast(p_size as double) / 5",
    "c_biochar": "cast(55 as double) + cast(p_size as double) / 5",
}
ALL_COLUMNS = {**LINE_COLUMNS, **PART_COLUMNS}


def experiments(spark: SparkSession, sf_dir: str, part: bool = False) -> DataFrame:
    """The experiment table. Only queries that need a part column pay for that join."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = spread(rows, "l_orderkey", "l_linenumber")
    if part:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_partkey", "l_partkey")
        rows = attach(rows, parts, ["l_partkey"], "inner", salt_by=["l_orderkey", "l_linenumber"])
    columns = ALL_COLUMNS if part else LINE_COLUMNS
    return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def measured(df: DataFrame) -> DataFrame:
    """Add energy and carbon recoveries as if measured, for the columns that exist."""
    noise = F.col("t_min") / 50
    new = {"e_b": F.col("b_y") / 100 * F.col("hhv_biooil") + noise}
    if "hhv_biochar" in df.columns:
        new["e_h"] = F.col("c_y") / 100 * F.col("hhv_biochar") + noise
        new["c_b"] = F.col("b_y") / 100 * (F.col("c_biooil") / 100) + noise / 10
        new["c_h"] = F.col("c_y") / 100 * (F.col("c_biochar") / 100)
    return df.withColumns(new)


def scored(df: DataFrame) -> DataFrame:
    """Add an arithmetic model of ``b_y`` with its interval: y, p, lo, hi."""
    p = F.lit(0.8) * F.col("b_y") + F.lit(0.05) * (F.col("temp_c") - 180) + F.col("t_min") / 10
    return df.withColumns({"y": F.col("b_y"), "p": p}).withColumns(
        {"lo": F.col("p") - 5, "hi": F.col("p") + 5})


_SELECT = ", ".join(f"{e} AS {n}" for n, e in ALL_COLUMNS.items())
E_SQL = f"e AS (SELECT {_SELECT} FROM lineitem JOIN part ON l_partkey = p_partkey)"
M_SQL = E_SQL + """, m AS (SELECT *, b_y / 100 * hhv_biooil + t_min / 50 AS e_b,
 c_y / 100 * hhv_biochar + t_min / 50 AS e_h,
 b_y / 100 * (c_biooil / 100) + t_min / 50 / 10 AS c_b, c_y / 100 * (c_biochar / 100) AS c_h FROM e)"""
S_SQL = E_SQL + """, s0 AS (SELECT *, b_y AS y, cast(0.8 as double) * b_y
 + cast(0.05 as double) * (temp_c - 180) + t_min / 10 AS p FROM e),
 s AS (SELECT *, p - 5 AS lo, p + 5 AS hi FROM s0)"""


def with_e(body: str) -> str:
    return f"WITH {E_SQL} {body}"


def with_m(body: str) -> str:
    return f"WITH {M_SQL} {body}"


def with_s(body: str) -> str:
    return f"WITH {S_SQL} {body}"


def rnd(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums depend on their order in the last digits: round them on both engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bucket_sql(key: str, seed: str = "42") -> str:
    return f"cast(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) as bigint)"


def r2_sql(y: str = "y", p: str = "p", n: str = "count(*)") -> str:
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * {n})"
    return (f"(case when {n} < 2 then null when {sst} = 0 then case when {sse} = 0 "
            f"then cast(1 as double) else cast(0 as double) end else 1 - {sse} / {sst} end)")


def rmse_sql(y: str = "y", p: str = "p") -> str:
    return f"sqrt(avg(({y} - {p}) * ({y} - {p})))"


def r6(expression: str) -> str:
    return f"round({expression}, 6)"


def number(x: float) -> str:
    return f"cast('{x!r}' as double)"
