import pyarrow as pa

import corpus_pipeline
from tests.llm.data import SCHEMA, documents, frame
from uqframe.llm.common import BATCH_BYTES


def test_stages(spark):
    docs, kept = frame(spark), []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, "")
        rows = docs.collect()
        kept.append({r.doc_id for r in rows})
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, SCHEMA)
    assert kept[0] == {r[0] for r in documents()} - {7, 8, 9, 10, 11, 12, 14, 15, 19}
    assert kept[1] == kept[0] - {1, 2, 3}
    assert kept[2] == kept[3] == kept[4] == kept[1]


def test_no_documents(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if "text" in docs.columns:
            docs = spark.createDataFrame([], SCHEMA)


def test_batches_of_a_stage_are_bounded(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(limit)
        stage(spark, frame(spark, []), "")
        rows = spark.range(16).coalesce(1).selectExpr("cast(repeat('x', 3 << 20) as binary) AS text")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 48 << 20 and max(found) < BATCH_BYTES + (4 << 20)
    spark.conf.unset(limit)
