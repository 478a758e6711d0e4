"""Hard negatives from an inverted multi-index.

Vectors of whole numbers are cut into two halves, each with a codebook fitted on at most
``most_sampled`` vectors (those whose ids have the smallest hashes). A pair of codewords is a cell;
each codeword knows the radius of the halves that it holds, over all rows. For an anchor, half
score plus anchor length times radius bounds what a codeword's halves can add, so the sum of two
such bounds is above the score of every row of the cell. A heap over both sorted lists of half
bounds visits the cells by falling sums and stops at the first sum below what the anchor still
needs: all rows that were not looked at are certified to score less.

Each search goes twice. The first visit stops after ``probe_rows`` rows; the scores it finds say
what a row needs to be among the first ones. The second one looks into every cell that may hold
such a row and hands on only rows that reach that score, so the result is exact. First positives
are found, then for each of them the rows of other labels inside its window of scores. Cells are
dealt to tasks in parts of about ``part_rows`` rows, crowded cells in several ones, and anchors in
blocks of bounded size.

Defined results: rows whose id, label or vector is null, or whose vector holds a null or
non-finite component or has not the most frequent length, take no part; an id counts once, with
its smallest (label, vector); of equal rows (label, vector) the smallest ids come first, and only as
many as can matter are looked at. Scores are exact sums; those beyond 64 bits count as the nearest
64-bit number, and components beyond 2**62 as that. Without positives or negatives an anchor has
no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uqframe.llm.common import arrow_schema, slices
from uqframe.llm.postings import balanced_means
from uqframe.sources.session import cut_lineage

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95
    most_sampled: int = 20_000
    cell_rows: int = 256
    most_words: int = 64  # codewords of a half; beyond that cells hold more rows
    part_rows: int = 2048
    probe_rows: int = 4096
    block_anchors: int = 2048


@dataclass
class MultiIndex:
    """Codebooks of both halves with their radii, and the parts that hold a cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    parts: list[range]  # by cell
    sizes: list[int]  # rows, by part

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of all cells, highest bound first."""
        lists, orders = [], []
        for half, book, radius in zip(halves(anchor[None, :]), self.books, self.radii):
            bound = (half @ book.T)[0] + np.sqrt((half * half).sum()) * radius
            bound += 1e-9 * np.abs(bound) + 1e-6  # above any rounding
            order = np.argsort(-bound, kind="stable")
            lists.append(bound[order].tolist())
            orders.append(order.tolist())
        (a, b), (first, second), width = lists, orders, len(self.books[1])
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, first[i] * width + second[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def parts_for(self, anchor: np.ndarray, needed: int, most_rows: int | None) -> list[int]:
        """The parts to look into: until the bound falls below ``needed``, or, for a probe, until
        they hold ``most_rows`` rows."""
        out: dict[int, None] = {}
        rows = 0
        for bound, cell in self.visit(anchor):
            if bound < needed or (most_rows is not None and rows >= most_rows):
                break
            for part in self.parts[cell]:
                if part not in out:
                    out[part] = None
                    rows += self.sizes[part]
        return list(out)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of whole numbers, as doubles (which may round those beyond 2**53)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def inner(q: pa.Array, x: pa.Array) -> np.ndarray:
    """Exact inner products of whole numbers, held to 64 bits."""
    a, b = matrix(q), matrix(x)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.array(q.to_pylist(), object) @ np.array(x.to_pylist(), object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def whole_vectors(vectors: DataFrame, label: Column, scale: int = 256, key: str = "vec_id",
                  vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): usable rows with components ``floor(scale * x)``; each id once."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"),
                          label.cast("string").alias("label"), v.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                      & F.col("x").isNotNull() & ~bad)
    edge = float(1 << 62)

    def scaled(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x * scale, F.lit(-edge)), F.lit(edge))).cast("long")

    rows = rows.select("vec_id", "label", F.transform("x", scaled).alias("v"))
    first = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where((F.size("v") == (first["size"] if first else 0)) & (F.size("v") > 0))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one"))
    return one.select("vec_id", "one.label", "one.v")


PLACED = "vec_id long, label string, v array<long>, cell int, r1 double, r2 double"
ASKED = "part long, vec_id long, label string, v array<long>, low array<long>, high array<long>"
FOUND = "anchor_id long, place int, vec_id long, score long"


def _placed(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with their cell and how far each half lies from its codeword."""
    kind, width = arrow_schema(PLACED), len(books[1])

    def run(batches):
        for part in slices(batches, 1024):
            own, far = [], []
            for half, book in zip(halves(matrix(part["v"])), books):
                d = ((half * half).sum(axis=1)[:, None] - 2 * half @ book.T
                     + (book * book).sum(axis=1)[None, :])
                own.append(d.argmin(axis=1))
                gap = half - book[own[-1]]
                far.append(np.sqrt((gap * gap).sum(axis=1)))
            columns = [part["vec_id"], part["label"], part["v"], own[0] * width + own[1], *far]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type)
                 for c, f in zip(columns, kind)], schema=kind)

    return rows.mapInArrow(run, PLACED)


def build(rows: DataFrame, s: Settings) -> tuple[MultiIndex, DataFrame]:
    """The index, and all rows with the ``part`` that holds them."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.most_sampled).toArrow()
    x = matrix(sample["v"].combine_chunks()) if n else np.zeros((1, 2))
    words = min(s.most_words, max(1, round((n / s.cell_rows) ** 0.5)), max(1, len(x) // 8))
    books = tuple(balanced_means(h, words) if h.shape[1] else np.zeros((1, 0)) for h in halves(x))
    placed = cut_lineage(_placed(rows, books), "cells")
    width = len(books[1])
    cells = len(books[0]) * width
    radii = [np.zeros(len(b)) for b in books]
    counts = [0] * cells
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"),
                                        F.max("r2").alias("r2")).collect():  # most_words ** 2 at most
        counts[r["cell"]] = r["n"]
        for radius, word, far in zip(radii, divmod(r["cell"], width), (r["r1"], r["r2"])):
            radius[word] = max(radius[word], far)
    parts, sizes = [], [0]
    for count in counts:
        own = max(1, -(-count // s.part_rows))
        if sizes[-1] and sizes[-1] + count // own > s.part_rows:
            sizes.append(0)
        start = len(sizes) - 1
        sizes += [0] * (own - 1)
        for k in range(own):
            sizes[start + k] += -(-count // own)
        parts.append(range(start, start + own))
    first = F.array(*[F.lit(p.start) for p in parts])
    many = F.array(*[F.lit(len(p)) for p in parts])
    part = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("vec_id"), F.get(many, F.col("cell")))
    index = MultiIndex(books, tuple(radii), parts, sizes)
    return index, placed.select(part.cast("long").alias("part"), "vec_id", "label", "v")


def _asked(anchors: DataFrame, index: MultiIndex, probe_rows: int | None) -> DataFrame:
    """Anchors (vec_id, label, v, low, high) once per part that their windows make them look into."""
    kind = arrow_schema(ASKED)

    def run(batches):
        for batch in slices(batches, 64):
            for at, v in enumerate(matrix(batch["v"])):
                low = batch["low"][at].as_py()
                parts = index.parts_for(v, min(low), probe_rows) if low else []
                one = batch.slice(at, 1).select(kind.names[1:]).take(pa.array([0] * len(parts), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int64()), *[c.cast(f.type) for c, f in zip(one.columns, list(kind)[1:])]],
                    schema=kind)

    return anchors.select("vec_id", "label", "v", "low", "high").mapInArrow(run, ASKED)


def first_in(score: np.ndarray, ids: np.ndarray, low: int, high: int, k: int) -> list[int]:
    """Places of the ``k`` highest scores of a window, ties by smaller id."""
    at = np.flatnonzero((score >= low) & (score <= high))
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]].tolist()


def _look(rows: DataFrame, asked: DataFrame, same: bool, k: int, blocks: int) -> DataFrame:
    """(anchor_id, place, vec_id, score): for the window at each place, the ``k`` first rows of an
    anchor's label, or of the other ones, in each part that it was dealt to."""
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = cut_lineage(asked, "asked")
    units = asked.select(F.col("part").alias("of"), F.col("block").alias("unit")).distinct()
    kind = arrow_schema(FOUND)

    def compare(own: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {c: [] for c in kind.names}
        if own.num_rows and anchors.num_rows:
            own, anchors = own.combine_chunks(), anchors.combine_chunks()
            ids = own["vec_id"].to_numpy()
            labels = np.array(own["label"].to_pylist(), object)
            x = own["v"].combine_chunks()
            q = anchors["v"].combine_chunks()
            rest = anchors.select(["vec_id", "label", "low", "high"]).to_pylist()
            for start in range(0, len(rest), 512):
                scores = inner(q.slice(start, 512), x)
                for score, a in zip(scores, rest[start:start + 512]):
                    fit = (labels == a["label"]) == same
                    fit &= ids != a["vec_id"]
                    some, own_ids = score[fit], ids[fit]
                    for place, (low, high) in enumerate(zip(a["low"], a["high"])):
                        at = first_in(some, own_ids, low, high, k)
                        out["anchor_id"] += [a["vec_id"]] * len(at)
                        out["place"] += [place] * len(at)
                        out["vec_id"] += own_ids[at].tolist()
                        out["score"] += some[at].tolist()
        return pa.Table.from_pydict(out, schema=kind)

    left = rows.join(units, F.col("part") == F.col("of")).drop("of").groupBy("part", "unit")
    found = left.cogroup(asked.groupBy("part", "block")).applyInArrow(compare, FOUND)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cut_lineage(found, "found")


def _held(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(LOWEST)), F.lit(HIGHEST)).cast("long")


def _twice(rows: DataFrame, windows: DataFrame, index: MultiIndex, same: bool, k: int, blocks: int,
           s: Settings) -> DataFrame:
    """The ``k`` first rows of every window (vec_id, label, v, low, high): a probe, then all cells
    that may hold a row as good as the ``k``-th one that it found."""
    probe = _look(rows, _asked(windows, index, s.probe_rows), same, k, blocks)
    found = probe.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("least"))
    better = F.transform("low", lambda v, i: F.greatest(v, F.try_element_at("least", i)))
    narrowed = windows.join(found, "vec_id", "left").withColumn(
        "low", F.when(F.col("least").isNull(), F.col("low")).otherwise(better))
    return _look(rows, _asked(narrowed, index, None), same, k, blocks)


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows
    (vec_id, label, v) of ``whole_vectors``. ``is_anchor`` is a condition on ``vec_id``. An
    anchor's positives are its first other rows of the same label; their negatives the first rows
    of other labels between ``low`` and ``high`` per cent of the positive's score."""
    s = settings
    rows = cut_lineage(vectors, "vectors")
    # of equal rows the smallest ids come first, and no anchor needs more than these
    copies = Window.partitionBy("label", "v").orderBy("vec_id")
    most = max(s.positives + 1, s.negatives)
    first = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= most)
    index, placed = build(first.drop("_copy"), s)
    anchors = rows.where(is_anchor)
    blocks = max(1, -(-anchors.count() // s.block_anchors))

    every = F.array(F.lit(LOWEST))
    open_ = anchors.withColumns({"low": every, "high": F.array(F.lit(HIGHEST))})
    positive = _twice(placed, open_, index, True, s.positives, blocks, s)
    whole = F.col("score").cast("decimal(20,0)")
    positive = positive.select(
        "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        _held(F.ceil(whole * s.low / 100)).alias("low"),
        _held(F.floor(whole * s.high / 100)).alias("high"))
    parts = F.sort_array(F.collect_list(F.struct("place", "low", "high")))
    windows = positive.groupBy(F.col("anchor_id").alias("vec_id")).agg(parts.alias("w"))  # few each
    # a window that holds no number needs nothing
    low = F.transform("w", lambda w: F.when(w["low"] <= w["high"], w["low"]).otherwise(F.lit(HIGHEST)))
    windows = anchors.join(windows, "vec_id").select(
        "vec_id", "label", "v", low.alias("low"), F.transform("w", lambda w: w["high"]).alias("high"))
    negative = _twice(placed, windows, index, False, s.negatives, blocks, s)
    negative = negative.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"),
                               F.col("score").alias("negative_score"))
    both = negative.join(positive, ["anchor_id", "place"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                       "negative_id", "positive_score", "negative_score")
