"""Documents in blocks: rows of a few megabytes of text with an id of their own, written once to
a bucketed table, so that answers about a block are joined without moving its texts again."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from uqframe.llm.common import arrow_schema, slices
from uqframe.sources.session import new_path

BLOCK = "block long, doc_ids array<long>, texts array<binary>, n_bytes long"
BLOCK_BYTES = 4 << 20


def write_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES,
                 carry: list[str] = (), name: str | None = None) -> DataFrame:
    """Blocks of (doc_id, text) in the order of the tasks, with the columns of ``carry`` as an
    array of structs, ``rows``. A row of ``docs`` lies in exactly one block; a text that is
    longer than a block makes one of its own. Null texts are empty. The table is called ``name``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"),
                       *([F.struct(*carry).alias("row")] if carry else []))
    schema = StructType.fromDDL(BLOCK)
    if carry:
        schema = schema.add("rows", ArrayType(read.schema["row"].dataType))
    kind = arrow_schema(schema)

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        ids, texts, rows, size = [], [], [], 0

        def block():
            columns = [pa.array([(task << 32) | n]), pa.array([ids], kind.field("doc_ids").type),
                       pa.array([texts], kind.field("texts").type), pa.array([size])]
            if carry:
                values = pa.concat_arrays(rows)
                columns.append(pa.ListArray.from_arrays([0, len(values)], values))
            return pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

        for part in slices(batches):
            values = zip(part["doc_id"].to_pylist(), part["text"].to_pylist())
            for k, (doc_id, text) in enumerate(values):
                text = text or b""
                if ids and size + len(text) > block_bytes:
                    yield block()
                    ids, texts, rows, size, n = [], [], [], 0, n + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if carry:
                    rows.append(part["row"].slice(k, 1))
        if ids:
            yield block()

    spark = docs.sparkSession
    name = name or f"blocks_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (read.mapInArrow(run, schema).write.bucketBy(buckets, "block")
     .option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a table that nothing reads any more, its entry and its files."""
    where = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with an array ``name`` of the answers (shard, bits) that they got."""
    own = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name))
    return blocks.join(own.hint("shuffle_hash"), "block", "left")
