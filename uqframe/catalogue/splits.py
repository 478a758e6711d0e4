"""Hold-outs, splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from uqframe.catalogue.experiments import E_SQL, bucket_sql, experiments, with_e
from uqframe.functions.exprs import hash_bucket
from uqframe.operators import splits
from uqframe.operators.cleaning import normalize_ids
from uqframe.operators.columns import process_label
from uqframe.sources.session import new_path
from uqframe.sources.tables import write_split

PAPERS = [("10.1/s7", "", "paper A"), ("", "Study 12", "paper B"),
          ("10.1/s40", "Study 0", "paper C"), ("10.1/none", "No such study", "paper D")]
#: Conditions of three papers; those of the second table need a measured initial concentration.
CONDITIONS = [(f"10.1/s{n}", feedstock, 180.0 + 4 * q, 5.0 * line, f"table {table}", table == 2)
              for n, table in ((4, 1), (7, 2), (9, 3)) for feedstock in ("AF", "NO", "RF")
              for q in range(2, 51, 3) for line in (1, 2, 4)]


def rows(spark, sf):
    """row split."""
    return splits.split_rows(experiments(spark, sf).select("row_id"))


def groups(spark, sf):
    """group split by paper."""
    df = splits.split_groups(experiments(spark, sf).select("row_id", "doi"))
    return df.select("row_id", "is_train", "is_test")


def feedstock_groups(spark, sf):
    """Hold out whole feedstocks."""
    df = splits.split_groups(experiments(spark, sf), "feedstock")
    return df.groupBy("feedstock", "is_test").agg(F.count("*").alias("n"))


def parts(spark, sf):
    """Both parts, their overlap and rows of an unknown group."""
    df = experiments(spark, sf).withColumn("grp", process_label())
    train, test = splits.materialize(splits.split_rows(splits.fill_group(df, "grp")))
    both = train.select("row_id").join(test.select("row_id"), "row_id", "left_semi")
    return train.agg(F.count("*").alias("n"), F.count_if(F.col("grp") == splits.UNKNOWN_GROUP).alias("unknown")
                     ).withColumn("part", F.lit("train")).unionByName(
        test.agg(F.count("*").alias("n"), F.count_if(F.col("grp") == splits.UNKNOWN_GROUP).alias("unknown")
                 ).withColumn("part", F.lit("test"))).unionByName(
        both.agg(F.count("*").alias("n")).withColumns({"unknown": F.lit(0).cast("bigint"),
                                                       "part": F.lit("both")}))


def stored(spark, sf):
    """A written split of some papers, joined back onto all rows."""
    df = experiments(spark, sf).select("row_id", "doi", "feedstock", "b_y")
    path = new_path(spark, "split")
    write_split(splits.split_rows(df.where("feedstock <> 'AF'")), path)
    out = splits.join_split(df, spark.read.parquet(path))
    return out.groupBy("feedstock", "is_train", "is_test").agg(
        F.count("*").alias("n"), F.sum("b_y").alias("total"))


def papers(spark, sf):
    """Whole papers by id or title, taken out of training."""
    df = normalize_ids(experiments(spark, sf).select("doi", "title", "b_y"))
    wanted = spark.createDataFrame(PAPERS, "id string, title string, label string")
    out = splits.holdout_match(df, wanted)
    found = out.groupBy("label").agg(F.count("*").alias("n"))
    lost = splits.unmatched_papers(df, wanted).select("label", F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(lost)


def trainable(spark, sf):
    """What is left for training without the selected papers, split by rows."""
    df = normalize_ids(experiments(spark, sf).select("row_id", "doi", "title", "feedstock", "b_y"))
    wanted = spark.createDataFrame(PAPERS, "id string, title string, label string")
    out = splits.split_rows(splits.without_holdouts(df, wanted))
    return out.groupBy("feedstock", "is_test").agg(
        F.count("*").alias("n"), F.sum("b_y").alias("total"), F.count_distinct("doi").alias("papers"))


def partial(spark, sf):
    """rows of one paper under listed conditions."""
    df = normalize_ids(experiments(spark, sf).select(
        "row_id", "doi", "feedstock", F.col("temp_c").cast("string").alias("temp_c"), "t_min", "ic"))
    wanted = spark.createDataFrame(
        CONDITIONS, "doi string, feedstock string, temp_c double, t_min double, tag string, required boolean")
    out = splits.tag_conditions(df, wanted, ["doi", "feedstock", "temp_c", "t_min"],
                                F.col("ic").isNotNull())
    return out.where("tag is not null").select("row_id", "tag")


def folds(spark, sf):
    """row folds."""
    return splits.row_folds(experiments(spark, sf).select("row_id"), 10)


def paper_folds(spark, sf):
    """group folds of balanced size."""
    df = splits.group_folds(experiments(spark, sf).select("doi"), "doi", 10)
    return df.groupBy("doi", "fold").agg(F.count("*").alias("n"))


def even_paper_folds(spark, sf):
    """groups of papers by size and fold, placed like the greedy rule does."""
    df = experiments(spark, sf).withColumn("doi", uneven("doi", "row_id"))
    sizes = splits.balanced_folds(df.select("doi"), "doi", 10).groupBy("doi", "fold").agg(
        F.count("*").alias("n"))
    return sizes.groupBy("fold", "n").agg(F.count("*").alias("groups"))


def uneven(doi: str, row: str):
    """A third of the rows under one paper, another eighth without any."""
    place = hash_bucket(row, seed="42") % 24
    return F.when(place < 8, F.lit("big")).when(place >= 11, F.col(doi))


def sample(spark, sf):
    """800 rows without replacement."""
    return splits.subsample(experiments(spark, sf).select("row_id", "b_y"), 800)


def permuted(spark, sf):
    """F8: fixed random order, with the rank a row has among its paper's rows."""
    from pyspark.sql import Window

    df = splits.permuted(experiments(spark, sf).select("row_id", "doi", "t_min"))
    place = F.md5(F.concat_ws("|", F.lit("42"), F.col("row_id")))
    order = Window.partitionBy("doi", "t_min").orderBy(place, "row_id")
    return df.select("row_id", F.row_number().over(order).alias("place"))


_POS = "cast(('0x' || substr(md5('42|' || {g}), 1, 13)) as bigint)"
_TEST = f"{bucket_sql('row_id')} < {int(0.2 * (1 << 32))}"


def _group_sql(group: str) -> str:
    pos = _POS.format(g=group)
    return (f", g AS (SELECT DISTINCT {group}, {pos} AS h FROM e), "
            "n AS (SELECT greatest(1, cast(round_even(cast('0.2' as double) * count(*), 0) as bigint)) AS k FROM g), "
            "t AS (SELECT max(h) AS top FROM (SELECT h FROM g ORDER BY h LIMIT (SELECT k FROM n)))")


_ID = "regexp_replace(lower(trim(doi)), '^(https://doi.org/|doi:)', '')"
QUERIES = {
    "split_rows": (rows, with_e(f"SELECT row_id, NOT ({_TEST}) AS is_train, {_TEST} AS is_test FROM e")),
    "split_groups": (groups, with_e(
        _group_sql("doi") + f" SELECT row_id, {_POS.format(g='doi')} > top AS is_train, "
        f"{_POS.format(g='doi')} <= top AS is_test FROM e, t")),
    "holdout_feedstock": (feedstock_groups, with_e(
        _group_sql("feedstock") + f" SELECT feedstock, {_POS.format(g='feedstock')} <= top AS is_test, "
        "count(*) AS n FROM e, t GROUP BY 1, 2")),
    "split_parts": (parts, with_e(f"""
, p AS (SELECT case when {_TEST} then 'test' else 'train' end AS part,
 coalesce(process_type_a, process_type_b) AS grp FROM e)
SELECT part, count(*) AS n, count(*) - count(grp) AS unknown FROM p GROUP BY 1
 UNION ALL SELECT 'both', 0, 0""")),
    "stored_split": (stored, with_e(f"""
SELECT feedstock, feedstock <> 'AF' AND NOT ({_TEST}) AS is_train, feedstock <> 'AF' AND {_TEST} AS is_test,
 count(*) AS n, sum(b_y) AS total FROM e GROUP BY 1, 2, 3""")),
    "paper_holdout": (papers, with_e(f"""
, l AS (SELECT least(case {_ID} when '10.1/s7' then 'paper A' when '10.1/s40' then 'paper C'
 when '10.1/none' then 'paper D' end, case trim(title) when 'Study 12' then 'paper B'
 when 'Study 0' then 'paper C' when 'No such study' then 'paper D' end) AS label FROM e)
SELECT label, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT p.label, 0 FROM (VALUES
 ('paper A', '10.1/s7', ''), ('paper B', '', 'Study 12'), ('paper C', '10.1/s40', 'Study 0'),
 ('paper D', '10.1/none', 'No such study')) p(label, id, title)
 WHERE NOT EXISTS (SELECT 1 FROM e WHERE {_ID} = p.id OR trim(e.title) = p.title)""")),
    "training_without_holdouts": (trainable, with_e(f"""
SELECT feedstock, {_TEST} AS is_test, count(*) AS n, sum(b_y) AS total, count(DISTINCT {_ID}) AS papers FROM e
 WHERE {_ID} NOT IN ('10.1/s7', '10.1/s40', '10.1/none')
 AND trim(title) NOT IN ('Study 12', 'Study 0', 'No such study') GROUP BY 1, 2""")),
    "partial_holdout": (partial, with_e(", w(id, feedstock, temp_c, t_min, tag, required) AS (VALUES " + ", ".join(
        f"('{d}', '{f}', {t}, {m}, '{g}', {r})" for d, f, t, m, g, r in CONDITIONS) + f""")
SELECT row_id, tag FROM e JOIN w ON {_ID} = w.id AND e.feedstock = w.feedstock
 AND e.temp_c = w.temp_c AND e.t_min = w.t_min WHERE ic IS NOT NULL OR NOT required""")),
    "kfold": (folds, with_e(f"SELECT row_id, cast({bucket_sql('row_id')} % 10 as integer) AS fold FROM e")),
    "group_kfold": (paper_folds, with_e("""
, g AS (SELECT doi, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, doi) - 1 AS r FROM g)
SELECT doi, cast(case when (r // 10) % 2 = 0 then r % 10 else 9 - r % 10 end as integer) AS fold, n FROM r""")),
    "group_kfold_even": (even_paper_folds, f"WITH RECURSIVE {E_SQL}" + """
, u AS (SELECT case when q < 8 then 'big' when q < 11 then 'UNKNOWN_DOI' else doi end AS doi
 FROM (SELECT doi, """ + bucket_sql("row_id") + """ % 24 AS q FROM e)),
s AS (SELECT doi, count(*) AS n FROM u GROUP BY 1),
g AS (SELECT n, row_number() OVER (ORDER BY n DESC, doi) AS r FROM s),
w(r, n, fold, loads) AS (
 SELECT cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), [cast(0 as bigint) for i in range(10)]
 UNION ALL SELECT g.r, g.n, list_position(loads, list_min(loads)),
 [case when i + 1 = list_position(loads, list_min(loads)) then loads[i + 1] + g.n else loads[i + 1] end for i in range(10)]
 FROM w JOIN g ON g.r = w.r + 1)
SELECT cast(fold - 1 as integer) AS fold, n, count(*) AS groups FROM w WHERE r > 0 GROUP BY 1, 2"""),
    "subsample": (sample, with_e("SELECT row_id, b_y FROM e ORDER BY md5('42|' || row_id), row_id LIMIT 800")),
    "permutation": (permuted, with_e(
        "SELECT row_id, cast(row_number() OVER (PARTITION BY doi, t_min ORDER BY md5('42|' || row_id), row_id) "
        "as integer) AS place FROM e")),
}
