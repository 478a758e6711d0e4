from tests.llm.data import prose
from uqframe.llm import suffix_tree as t

KIND = "doc_id long, text string"


def test_contexts_grow_with_the_texts(spark):
    """What was gathered has no limit: more texts of a source make held-out ones likelier."""
    means = []
    for n in (20, 400):
        rows = [(i, prose(i % 150, 120)) for i in range(n)] + [(10_000 + i, prose(i, 120)) for i in range(40, 60)]
        got = t.score(spark.createDataFrame(rows, KIND).repartition(4)).where("held_out and doc_id >= 10000")
        row = got.selectExpr("sum(score) / sum(n_tokens) AS m").first()
        means.append(row.m)
    assert means[1] > means[0] + 0.2


def test_settings_have_no_limit_on_contexts():
    assert set(t.Settings.__dataclass_fields__) == {
        "depth", "least_count", "least_gain", "modulus", "remainder", "shard_records"}
