"""Hold-outs, splits and folds. Every choice is a hash of a key, so it does not depend on
partitioning, order or retries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uqframe.functions.exprs import hash_bucket, to_number
from uqframe.operators.quantiles import nth_smallest
from uqframe.operators.skew import MAX_LIST_ROWS, attach, fits
from uqframe.sources.session import cut_lineage

HASH_RANGE = float(1 << 32)
UNKNOWN_GROUP = "UNKNOWN_DOI"
#: So many groups and their folds (some 50 MB) go to all tasks instead of the rows to the groups.
MAX_LIST_GROUPS = 500_000


def split_rows(df: DataFrame, test_fraction: float = 0.2, key: str = "row_id",
               seed: str = "42") -> DataFrame:
    """Row split: a row is in the test part when its hash falls below the fraction."""
    is_test = hash_bucket(key, seed=seed) < F.lit(int(test_fraction * HASH_RANGE))
    return df.withColumns({"is_train": ~is_test, "is_test": is_test})


def group_position(group: str | Column, seed: str) -> Column:
    """A place in [0, 2**52) for a group, exact as a double."""
    g = F.col(group) if isinstance(group, str) else group
    text = F.concat_ws("|", F.lit(seed), g.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def split_groups(df: DataFrame, group: str = "doi", test_fraction: float = 0.2,
                 seed: str = "42") -> DataFrame:
    """Group split: the groups with the smallest hashes form the test part.

    Their number is the rounded fraction, at least one. Rows without a group are trained
    on. Only the threshold hash travels to the rows, never a list of groups.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    placed = groups.select(group_position(group, seed).alias("h"))
    count = F.greatest(F.lit(1.0), F.rint(F.lit(float(test_fraction)) * F.col("n")))
    threshold = nth_smallest(placed, "h", count - 1, test_fraction).select("value").scalar()
    is_test = F.coalesce(group_position(group, seed) <= threshold, F.lit(False))
    is_test = F.col(group).isNotNull() & is_test
    return df.withColumn("is_test", is_test).withColumn("is_train", ~F.col("is_test"))


def materialize(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; without a split everything is trained on."""
    if "is_train" not in df.columns:
        return df, df.where(F.lit(False))
    return df.where("is_train"), df.where("is_test")


def join_split(df: DataFrame, split: DataFrame, key: str = "row_id",
               strict: bool = False) -> DataFrame:
    """Put a stored split back onto rows; rows it does not know belong to neither part.

    ``strict`` raises unless both sides hold exactly the same keys.
    """
    if strict:
        lost = df.join(split, key, "left_anti").limit(1).count()
        extra = split.join(df, key, "left_anti").limit(1).count()
        if lost or extra:
            raise ValueError("the stored split and the rows have different keys")
    out = df.join(split.select(key, "is_train", "is_test"), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_train", "is_test")})


def holdout_match(df: DataFrame, papers: DataFrame, id_col: str = "doi",
                  title_col: str = "title") -> DataFrame:
    """Add ``label``, the smallest label of a selected paper that a row belongs to by id
    or by exact title; null for other rows.

    ``papers`` (id, title, label) is the user's list. Two equi-joins stand for the OR.
    """
    small = fits(papers)

    def side(key: str, name: str) -> DataFrame:
        rows = papers.where((F.trim(F.col(key)) != "") & F.col(key).isNotNull())
        return rows.groupBy(F.trim(F.col(key)).alias(name)).agg(F.min("label").alias(name + "_l"))

    out = df.withColumns({"_id": F.trim(F.col(id_col)), "_title": F.trim(F.col(title_col))})
    out = attach(out, side("id", "_id"), ["_id"], bounded=small)
    out = attach(out, side("title", "_title"), ["_title"], bounded=small)
    return out.withColumn("label", F.least("_id_l", "_title_l")).drop(
        "_id", "_title", "_id_l", "_title_l")


def without_holdouts(df: DataFrame, papers: DataFrame, id_col: str = "doi",
                     title_col: str = "title") -> DataFrame:
    """The rows that may be trained on: those of no selected paper."""
    return holdout_match(df, papers, id_col, title_col).where(F.col("label").isNull()).drop("label")


def unmatched_papers(df: DataFrame, papers: DataFrame, id_col: str = "doi",
                     title_col: str = "title") -> DataFrame:
    """Selected papers without any row."""
    small = fits(papers)

    def known(column: str, key: str) -> DataFrame:
        rows = df.select(F.trim(F.col(column)).alias(key))
        wanted = papers.select(key).distinct()
        return attach(rows, wanted, [key], "inner", bounded=small).distinct()

    by_id = papers.join(known(id_col, "id"), "id", "left_anti")
    return by_id.join(known(title_col, "title"), "title", "left_anti")


def tag_conditions(df: DataFrame, wanted: DataFrame, keys: list[str],
                   require: Column | None = None) -> DataFrame:
    """Add ``tag`` from a list of (keys…, tag) conditions; number keys are read leniently.

    The last tag in sort order wins when several conditions meet one row. Rows must pass
    ``require`` where the condition says so in a boolean column ``required``; without that
    column every condition does.
    """
    read = {c: (to_number(c) if dict(wanted.dtypes)[c] == "double" else F.trim(F.col(c)))
            for c in keys}
    out = df.withColumns({f"_c_{c}": e for c, e in read.items()})
    required = F.col("required") if "required" in wanted.columns else F.lit(True)
    tags = {"_tag": F.max("tag"), "_free": F.max(F.when(~required, F.col("tag")))}
    facts = wanted.groupBy(*[F.col(c).alias(f"_c_{c}") for c in keys]).agg(
        *[v.alias(n) for n, v in tags.items()])
    out = attach(out, facts, [f"_c_{c}" for c in keys], bounded=fits(wanted)).drop(*[f"_c_{c}" for c in keys])
    passed = F.lit(True) if require is None else F.coalesce(require, F.lit(False))
    out = out.withColumn("tag", F.when(passed, F.col("_tag")).otherwise(F.col("_free")))
    return out.drop("_tag", "_free")


def row_folds(df: DataFrame, k: int = 10, key: str = "row_id", seed: str = "42") -> DataFrame:
    return df.withColumn("fold", F.pmod(hash_bucket(key, seed=seed), F.lit(k)).cast("int"))


def fold_count(n_groups: int, k: int = 10) -> int:
    if n_groups < 3:
        raise ValueError(f"group folds need at least 3 groups, there are {n_groups}")
    return max(3, min(k, n_groups))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, the place from 0 of each row in a total order: sorted by ranges, counted
    per range, and numbered within. No task sees more than a range."""
    place = F.monotonically_increasing_id()  # the range's number above, the row's below
    rows = cut_lineage(df.orderBy(*order).withColumn("_at", place), "ranked")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(starts), "_range")  # one row per range
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("rank", rank).drop("_at", "_range", "_start")


def group_folds(df: DataFrame, group: str = "doi", k: int = 10) -> DataFrame:
    """Fold per row such that a group is never split and folds have similar sizes.

    Groups are ranked by size, largest first, ties by key, and dealt to the folds to and fro:
    0 … k-1, k-1 … 0, and so on. The same rule holds for any number of groups.
    """
    keyed = _keyed(df, group)
    sizes = cut_lineage(keyed.groupBy("_g").agg(F.count("*").alias("_size")), "groups")
    n = sizes.count()
    return attach(keyed, _dealt(sizes, fold_count(n, k)), ["_g"], bounded=n <= MAX_LIST_GROUPS).drop("_g")


def _keyed(df: DataFrame, group: str) -> DataFrame:
    return df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_GROUP)))


def _dealt(sizes: DataFrame, k: int) -> DataFrame:
    """(_g, fold) of the groups (_g, _size), as ``group_folds`` deals them."""
    places = ranked(sizes, F.desc("_size"), F.col("_g"))
    step, turn = F.col("rank") % k, F.floor(F.col("rank") / k) % 2
    fold = F.when(turn == 0, step).otherwise(F.lit(k - 1) - step).cast("int")
    return places.select("_g", fold.alias("fold"))


@dataclass
class EachFolds:
    """Rows with the folds of several conditions, and what is known of each condition."""

    df: DataFrame
    rows: list[int]
    groups: list[int]
    k: list[int]
    alike: list[int]


def group_folds_each(df: DataFrame, usable: list[Column], group: str = "doi", k: int = 10) -> EachFolds:
    """Add ``folds``: for each condition the fold that ``group_folds`` gives among the rows that meet it, null
    where the row's group has none of them or there are fewer than 3 groups.

    Rows are read once for the sizes of the groups under all conditions and joined once. Beside them come
    the rows and the groups (rows without a group aside) that meet a condition, its number of folds (0 without folds), and
    the first condition with the same sizes and so the same folds.
    """
    keyed = _keyed(df, group)
    sizes = cut_lineage(keyed.groupBy("_g").agg(
        F.count("*").alias("n"), F.max(F.col(group).isNotNull()).alias("known"),
        *[F.count_if(c).alias(f"n_{i}") for i, c in enumerate(usable)]), "groups")
    at = range(len(usable))
    facts = sizes.agg(
        F.count("*").alias("all"), F.struct(*[F.coalesce(F.sum(f"n_{i}"), F.lit(0)) for i in at]).alias("rows"),
        F.struct(*[F.count_if(F.col("known") & (F.col(f"n_{i}") > 0)) for i in at]).alias("groups"),
        *[F.bool_and(F.col(f"n_{i}") == F.col(f"n_{j}")).alias(f"same_{i}_{j}") for i in at for j in range(i)]).first()
    alike = [next((j for j in range(i) if facts[f"same_{i}_{j}"]), i) for i in at]
    groups = list(facts["groups"])
    counts = [fold_count(n, k) if n >= 3 else 0 for n in groups]
    places = sizes.select("_g")
    for i in at:
        if alike[i] == i and counts[i]:
            own = sizes.where(F.col(f"n_{i}") > 0).select("_g", F.col(f"n_{i}").alias("_size"))
            places = places.join(_dealt(own, counts[i]).withColumnRenamed("fold", f"fold_{i}"), "_g", "left")
    folds = F.array(*[F.col(f"fold_{j}") if counts[j] else F.lit(None).cast("int") for j in alike])
    few = facts["all"] * len(usable) <= 4 * MAX_LIST_GROUPS  # a fold is short beside the name of its group
    out = attach(keyed, places.select("_g", folds.alias("folds")), ["_g"], bounded=few,
                 counts=sizes.select("_g", "n")).drop("_g")
    return EachFolds(out, list(facts["rows"]), groups, counts, alike)


def place_sizes(sizes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """How many groups of each size (descending) every fold gets when each group in turn goes to
    the lightest fold, the first of equally light ones.

    The groups of one size take the smallest of the loads that the folds pass through
    (load, load + size, …), so a threshold gives all of their places at once.
    """
    loads = np.zeros(k, np.int64)
    placed = np.zeros((len(sizes), k), np.int64)
    for row, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist())):
        low, high = int(loads.min()), int(loads.min()) + size * left + 1
        while high - low > 1:  # the largest threshold with no more than ``left`` loads below it
            middle = (low + high) // 2
            below = int(np.maximum(0, -((loads - middle) // size)).sum())
            low, high = (middle, high) if below <= left else (low, middle)
        own = np.maximum(0, -((loads - low) // size))
        at = np.flatnonzero(loads + own * size == low)
        own[at[:left - int(own.sum())]] += 1
        placed[row] = own
        loads = loads + own * size
    return placed


def balanced_folds(df: DataFrame, group: str = "doi", k: int = 10) -> DataFrame:
    """Fold per row such that a group is never split and folds are as even as placing the largest
    group first, always in the lightest fold, makes them.

    Only the histogram of group sizes reaches the driver: sizes that differ add up to no more than
    the rows, so ``n`` rows have fewer than ``sqrt(2 n)`` of them. Groups of one size are
    dealt by their key: the smallest keys to fold 0, the next ones to fold 1, and so on. Rows without
    a group are one group.
    """
    keyed = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_GROUP)))
    sizes = cut_lineage(keyed.groupBy("_g").agg(F.count("*").alias("_size")), "groups")
    found = sizes.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).toPandas()
    k = fold_count(int(found["n"].sum()), k)
    placed = place_sizes(found["_size"].to_numpy(), found["n"].to_numpy(), k)
    ends = found["n"].cumsum() - found["n"]
    found["_ends"] = [list(map(int, row)) for row in placed.cumsum(axis=1) + ends.to_numpy()[:, None]]
    table = df.sparkSession.createDataFrame(
        found[["_size", "_ends"]], "_size long, _ends array<long>")
    ranks = ranked(sizes, F.desc("_size"), F.col("_g"))
    ranks = attach(ranks, table, ["_size"], "inner", bounded=len(found) <= MAX_LIST_ROWS)
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("rank"))).cast("int")
    return attach(keyed, ranks.select("_g", fold.alias("fold")), ["_g"],
                  counts=sizes.withColumnRenamed("_size", "n")).drop("_g")


def subsample(df: DataFrame, n: int, key: str = "row_id", seed: str = "42") -> DataFrame:
    """``n`` rows without replacement: those with the smallest hashes."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(n)


def permuted(df: DataFrame, key: str = "row_id", seed: str = "42") -> DataFrame:
    """Rows in a fixed pseudo-random order, sorted by ranges."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)


def fill_group(df: DataFrame, group: str = "doi") -> DataFrame:
    return df.withColumn(group, F.coalesce(F.col(group), F.lit(UNKNOWN_GROUP)))
