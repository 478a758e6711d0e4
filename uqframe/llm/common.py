"""Helpers that the operators share: batches, words, hashes and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python task looks at together: bounds memory whatever Spark's batches hold.
SLICE_ROWS = 256
#: Bytes of an Arrow batch, about, in the stages of the pipeline. Spark's own limit is 64 MB, which a
#: task holds several times over: as vectors of the JVM, as the batch of its Python worker, as its slices.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Let the Arrow batches of this session end at ``n_bytes``. A row is never cut."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def slices(batches: Iterable[pa.RecordBatch], step: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_rows(df: DataFrame, per_slice: Callable[[pa.RecordBatch], dict],
             schema: str | StructType, step: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` where ``per_slice`` turns up to ``step`` rows into columns of plain values."""
    kind = arrow_schema(schema)

    def run(batches):
        for part in slices(batches, step):
            yield pa.RecordBatch.from_pydict(per_slice(part), schema=kind)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs without blanks and the control characters 9 to 13: what ``bytes.split``
    splits at."""
    return text.split() if text else []


def hash64(data: bytes, seed: int = 0) -> int:
    """Unsigned 64-bit hash, the same in every process."""
    return xxhash.xxh3_64_intdigest(data, seed)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to ``most`` words (forgetting only costs time)."""

    def __init__(self, seed: int = 0, most: int = 100_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return out

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
