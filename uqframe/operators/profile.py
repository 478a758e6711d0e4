"""Input quality profile, correlation, and bootstrap confidence of a metric."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.functions.exprs import finite
from uqframe.operators.metrics import finite_pairs
from uqframe.operators.quantiles import exact_quantiles, long_values, quantile_columns


def quality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, type, n_rows, n_missing, min, max, q25, q75, n_outliers).

    Outliers lie more than 1.5 interquartile ranges outside the quartiles.
    """
    types = dict(df.dtypes)
    q = quantile_columns(df, columns, {"q25": 0.25, "q75": 0.75}).drop("n")
    total = df.agg(F.count("*")).scalar()
    rows = long_values(df, columns, []).join(F.broadcast(q), "variable")  # one row per column
    reach = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    outside = (F.col("value") < F.col("q25") - reach) | (F.col("value") > F.col("q75") + reach)
    stats = rows.groupBy("variable").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max("q25").alias("q25"), F.max("q75").alias("q75"),
        F.count_if(outside).alias("n_outliers"))
    names = df.sparkSession.createDataFrame([(c, types[c]) for c in columns],
                                            "variable string, type string")
    out = F.broadcast(names).join(stats, "variable", "full")  # one row per column
    return out.select("variable", "type", total.alias("n_rows"),
                      (total - F.coalesce("n", F.lit(0))).alias("n_missing"), "min", "max",
                      "q25", "q75", F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur more than once, with their number of copies."""
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, corr) for every pair of columns over rows where both exist, in one pass."""
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    parts = []
    for i, (a, b) in enumerate(pairs):
        parts += [F.corr(a, b).alias(f"r{i}"), F.count_if(both[i]).alias(f"n{i}")]
    one = clean.agg(*parts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"),
                 F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("r")).select("r.*")


# cumulative Poisson(1) probabilities on the 16-bit scale, from the rule e^-1 / i!
def poisson_edges() -> list[int]:
    term, total, out = 0.36787944117144233, 0.0, []
    for i in range(9):
        total += term
        out.append(round(total * 65536))
        term /= i + 1
    return out


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count from a 16-bit uniform integer."""
    out = None
    for i, edge in enumerate(poisson_edges()):
        out = F.when(u < edge, F.lit(i)) if out is None else out.when(u < edge, F.lit(i))
    return out.otherwise(F.lit(len(poisson_edges()))).cast("double")


def bootstrap_rmse(df: DataFrame, replicates: int = 40, alpha: float = 0.05,
                   key: str = "row_id", seed: str = "42") -> DataFrame:
    """One row (rmse, lo, hi, replicates): Poisson bootstrap of the RMSE of (y, p).

    Every row gets a hash-derived weight per replicate, so there is no sampling state. One
    hash serves eight replicates, and all replicates are summed in one pass.
    """
    groups = -(-replicates // 8)
    rows = finite_pairs(df).select(key, ((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("e"))
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    text = F.concat_ws("|", F.lit(seed), F.col("g").cast("string"), F.col(key).cast("string"))
    rows = rows.withColumn("h", F.md5(text))
    sums = []
    for j in range(8):
        u = F.conv(F.substring("h", 1 + 4 * j, 4), 16, 10).cast("int")
        w = poisson_weight(u)
        sums += [F.sum(w).alias(f"w{j}"), F.sum(w * F.col("e")).alias(f"s{j}")]
    wide = rows.groupBy("g").agg(*sums)
    each = F.explode(F.array(*[
        F.struct((F.col("g") * 8 + j).alias("replicate"),
                 F.sqrt(F.try_divide(F.col(f"s{j}"), F.col(f"w{j}"))).alias("rmse"))
        for j in range(8)]))
    reps = wide.select(each.alias("r")).select("r.*").where(F.col("replicate") < replicates)
    q = exact_quantiles(reps, ["rmse"], [alpha / 2, 1 - alpha / 2])
    q = q.agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.max("n").alias("replicates"))
    point = rows.where("g = 0").agg(F.sqrt(F.avg("e")).alias("rmse"))
    return q.withColumn("rmse", point.scalar()).select("rmse", "lo", "hi", "replicates")


