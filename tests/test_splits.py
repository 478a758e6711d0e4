import pytest
from pyspark.sql import functions as F

from uqframe.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 37).cast("string").alias("doi"),
        F.concat(F.lit("T"), (F.col("id") % 11).cast("string")).alias("title"),
        (F.col("id") % 5 * 10).cast("double").alias("temp_c"))


def test_row_split(rows):
    out = splits.split_rows(rows)
    n = out.where("is_test").count()
    assert 700 < n < 900
    assert out.where("is_test = is_train").count() == 0
    again = splits.split_rows(rows.repartition(13))
    assert out.exceptAll(again).count() == 0
    train, test = splits.materialize(out)
    assert train.count() + test.count() == 4000
    assert splits.materialize(rows)[1].count() == 0


def test_group_split(rows):
    df = rows.withColumn("doi", F.when(F.col("doi") != "0", F.col("doi")))
    out = splits.split_groups(df)
    sides = out.groupBy("doi").agg(F.count_distinct("is_test").alias("s"), F.max(F.col("is_test").cast("int")).alias("t"))
    got = sides.collect()
    assert all(r["s"] == 1 for r in got)
    assert sum(r["t"] for r in got) == round(0.2 * 36)
    assert next(r["t"] for r in got if r["doi"] is None) == 0
    one = splits.split_groups(df.where("doi = '3'"))
    assert one.where("is_test").count() == one.count()


def test_holdout(spark, rows):
    papers = spark.createDataFrame(
        [("3", "", "by id"), ("", "T4", "by title"), ("5", "T6", "both"), ("99", "none", "lost")],
        "id string, title string, label string")
    out = splits.holdout_match(rows, papers)
    got = out.groupBy("doi", "title").agg(F.max("label").alias("l")).collect()
    for r in got:
        hit = r["doi"] in ("3", "5") or r["title"] in ("T4", "T6")
        assert (r["l"] is not None) == hit
    assert [r["label"] for r in splits.unmatched_papers(rows, papers).collect()] == ["lost"]


def test_conditions(spark, rows):
    df = rows.withColumn("temp_c", F.col("temp_c").cast("string"))
    wanted = spark.createDataFrame([("3", 10.0, "a"), ("4", 20.0, "b")], "doi string, temp_c double, tag string")
    out = splits.tag_conditions(df, wanted, ["doi", "temp_c"], F.col("title") != "T0")
    tagged = out.where("tag is not null")
    assert tagged.where("title = 'T0'").count() == 0
    assert tagged.where("not (doi = '3' and temp_c = '10.0' or doi = '4' and temp_c = '20.0')").count() == 0
    assert tagged.count() > 0 and out.count() == 4000
    free = wanted.withColumn("required", F.col("tag") == "b")
    tagged = splits.tag_conditions(df, free, ["doi", "temp_c"], F.col("title") != "T0").where("tag is not null")
    assert {r.tag for r in tagged.where("title = 'T0'").collect()} <= {"a"}
    assert tagged.count() > out.where("tag is not null").count()


def test_folds(spark, rows):
    sizes = [r["count"] for r in splits.row_folds(rows, 10).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 300
    out = splits.group_folds(rows, "doi", 5)
    assert out.groupBy("doi").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 200
    count = rows.groupBy("doi").count().collect()
    order = sorted(count, key=lambda r: (-r["count"], r["doi"]))
    place = {r["doi"]: k for k, r in enumerate(order)}
    for r in out.select("doi", "fold").distinct().collect():
        turn, step = divmod(place[r["doi"]], 5)
        assert r["fold"] == (4 - step if turn % 2 else step)


def test_dominant_null_and_few_groups(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") < 3000, None).otherwise((F.col("id") % 700).cast("string")).alias("doi"))
    out = splits.group_folds(df, "doi", 4)
    assert out.groupBy("doi").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert sizes[-1] < 3000 + 1000 and sizes[0] > 700  # the unknown group is dealt first
    with pytest.raises(ValueError):
        splits.group_folds(df.where("doi in ('1', '2')"), "doi", 4)


def test_sample_and_stored_split(spark, rows):
    assert splits.subsample(rows, 800).count() == 800
    assert splits.subsample(rows.repartition(3), 50).exceptAll(splits.subsample(rows, 50)).count() == 0
    known = splits.split_rows(rows.where("doi <> '1'"))
    out = splits.join_split(rows, known)
    assert out.where("doi = '1' and (is_train or is_test)").count() == 0
    with pytest.raises(ValueError):
        splits.join_split(rows, known, strict=True)
    assert splits.permuted(rows).count() == 4000
    assert splits.fill_group(spark.createDataFrame([(None,)], "doi string")).collect()[0][0] == "UNKNOWN_DOI"


def greedy(sizes, k):
    loads = [0] * k
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


@pytest.mark.parametrize("n", [300, 3_000, 30_000])
def test_balanced_folds(spark, n):
    """As even as the greedy placement, also with one group of a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, None).otherwise(F.floor(F.sqrt(F.col("id"))).cast("string"))
    df = spark.range(n).select("id", key.alias("doi"))
    out = splits.balanced_folds(df, "doi", 5)
    assert out.columns == ["id", "doi", "fold"] and out.count() == n
    assert out.groupBy("doi").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in df.groupBy("doi").count().collect()]
    got = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert [got[f] for f in range(5)] == greedy(sizes, 5)
    dealt = max(r["count"] for r in splits.group_folds(df, "doi", 5).groupBy("fold").count().collect())
    assert max(got.values()) < dealt
    again = splits.balanced_folds(df.repartition(7), "doi", 5)
    assert again.exceptAll(out).count() == 0


def test_balanced_folds_equal_sizes_and_few_groups(spark):
    df = spark.range(12).select(F.col("id").cast("string").alias("doi"))
    out = splits.balanced_folds(df, "doi", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in out] == [3, 3, 2, 2, 2]
    with pytest.raises(ValueError):
        splits.balanced_folds(df.limit(2), "doi", 5)
