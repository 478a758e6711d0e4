"""Nearest neighbours by balanced posting lists.

Vectors are lengthened by one component that gives all of them the same norm, so the largest
inner product is the smallest distance. Centroids are fitted on at most ``most_sampled`` vectors
(those whose ids have the smallest hashes) by k-means that charges a full cluster, and stay in
memory with a graph of their neighbours, which a beam searches. Every vector goes to the list of
its nearest centroid and, when it lies near a boundary, to up to ``copies`` lists whose centroids
are at most ``1 + spread`` times as far. A query is stretched to the norm of the vectors, which keeps
the order of its inner products, and looks into the lists whose centroids are at most ``ratio``
times as far as its nearest one: the beam finds that one, and the graph is walked on from every
centroid within the ratio and a margin, however many there are. The ratio is the one with which ``calibrated``
queries meet ``least_recall`` of their exact neighbours through the graph; those are found by
comparing these queries with all vectors. (A query on top of a centroid would ask for that list
alone, and the ratio that others then need would open all lists to them: so the median of the
nearest distances is the least that the ratio is applied to.)
Lists are dealt out in parts of bounded size, each compared with bounded blocks of queries, and every part hands on its
``k`` nearest only. Exact copies of a vector are reduced to the ``k + 1`` smallest ids first, of
which no query can need more.

Defined results: a vector takes no part when it or its id is null, when it is zero or holds a
null or non-finite component, or when its length is not the most frequent one; repeated rows of
an id count once; with fewer candidates than ``k`` all are returned; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uqframe.llm.common import slices
from uqframe.sources.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    k: int = 20
    most_sampled: int = 20_000
    list_rows: int = 128
    copies: int = 4
    spread: float = 0.10
    calibrated: int = 256
    least_recall: float = 0.99
    beam: int = 64
    links: int = 24
    part_rows: int = 4096
    block_queries: int = 1024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v as array of doubles), each id once, without vectors that take no part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size")
    first = size.first()
    rows = rows.where(F.size("v") == (first["size"] if first else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lengthen(x: np.ndarray, norm: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))
    return np.hstack([x, extra[:, None]]).astype(np.float32)


def balanced_means(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means in which a cluster's size adds to the distance to it; empty clusters restart
    inside the largest ones."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    centers = x[rng.choice(len(x), lists, replace=False)].copy()
    charge = np.zeros(lists, np.float32)
    for step in range(rounds):
        far = (centers * centers).sum(axis=1)[None, :] - 2 * x @ centers.T + charge[None, :]
        own = far.argmin(axis=1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centers, dtype=np.float64)
        np.add.at(sums, own, x)
        full = counts > 0
        centers[full] = (sums[full] / counts[full, None]).astype(np.float32)
        spread = float(np.mean(((x - centers[own]) ** 2).sum(axis=1)))
        charge = (0.2 * spread * (counts / max(1.0, len(x) / lists) - 1)).astype(np.float32)
        if step < rounds - 1 and not full.all():
            crowded = own[np.argsort(-counts[own], kind="stable")]
            pick = np.flatnonzero(np.isin(own, crowded[: max(1, len(x) // 4)]))
            centers[~full] = x[rng.choice(pick, int((~full).sum()))]
    return centers


class Graph:
    """Centroids, each linked to its nearest ones and to a few at random, searched by a beam."""

    def __init__(self, centers: np.ndarray, links: int, beam: int):
        self.centers, self.beam = centers, min(beam, len(centers))
        rng = np.random.default_rng(11)
        n = len(centers)
        near = np.zeros((n, min(links, n)), np.int32)
        for at in range(0, n, 1024):
            far = self._far(centers[at:at + 1024], None)
            near[at:at + 1024] = np.argpartition(far, near.shape[1] - 1, axis=1)[:, :near.shape[1]]
        self.near = np.hstack([near, rng.integers(0, n, (n, 2), dtype=np.int32)])
        self.walk = self._both_ways(n)
        self.norms = (centers ** 2).sum(axis=1)
        self.entries = rng.choice(n, min(n, 2 * self.beam), replace=False)

    def _both_ways(self, n: int) -> np.ndarray:
        """Links to walk on: also from its four nearest to each centroid, which few others may
        link to, and to the next one; rows are filled up with the centroid itself."""
        nodes = np.arange(n)
        closest = np.argsort(self._far(self.centers, self.near[:, :-2]), axis=1, kind="stable")[:, :5]
        closest = np.take_along_axis(self.near[:, :-2], closest, 1)
        source = np.concatenate([np.repeat(nodes, self.near.shape[1]), closest.ravel(), nodes])
        target = np.concatenate([self.near.ravel(), np.repeat(nodes, closest.shape[1]), (nodes + 1) % n])
        links = np.unique(np.column_stack([source, target]), axis=0)
        degree = np.bincount(links[:, 0], minlength=n)
        out = np.tile(nodes[:, None], (1, int(degree.max())))
        start = np.cumsum(degree) - degree
        out[links[:, 0], np.arange(len(links)) - start[links[:, 0]]] = links[:, 1]
        return out

    def _far(self, q: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Squared distances to all centroids, or to those of a row's ``ids``."""
        own = (q * q).sum(axis=1)[:, None]
        if ids is None:
            return own + (self.centers ** 2).sum(axis=1)[None, :] - 2 * q @ self.centers.T
        c = self.centers[ids]
        return own + (c * c).sum(axis=2) - 2 * np.einsum("qd,qnd->qn", q, c)

    def within(self, q: np.ndarray, ratio: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all that the graph reaches at no more than ``ratio`` times the
        nearest distance of the row, or times ``floor`` if that is more."""
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(q), 64):
            row, col = self._within(q[at:at + 64], ratio, floor)
            rows.append(row + at)
            cols.append(col)
        return np.concatenate(rows), np.concatenate(cols)

    def _within(self, q: np.ndarray, ratio: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        own, n = (q * q).sum(axis=1), len(self.centers)
        far = np.full((len(q), n), np.inf, np.float32)
        ids, found = self._search(q, self.beam)
        row, col = np.nonzero(np.isfinite(found))
        far[row, ids[row, col]] = found[row, col]
        left = np.ones(far.shape, bool)  # not walked on from
        while True:
            least = np.sqrt(np.maximum(far.min(axis=1), 0))
            bound = (ratio * np.maximum(least, floor))[:, None]
            row, col = np.nonzero((far <= (MARGIN * bound) ** 2) & left)
            if not len(row):
                near = far <= bound ** 2
                near[np.arange(len(q)), far.argmin(axis=1)] = True
                return np.nonzero(near)
            left[row, col] = False
            reached = np.zeros(far.shape, bool)
            for i in range(0, len(row), 16_384):
                reached[row[i:i + 16_384, None], self.walk[col[i:i + 16_384]]] = True
            row, col = np.nonzero(reached & np.isinf(far))
            for i in range(0, len(row), 65_536):
                r, c = row[i:i + 65_536], col[i:i + 65_536]
                both = np.einsum("pd,pd->p", q[r], self.centers[c])
                far[r, c] = own[r] + self.norms[c] - 2 * both

    def distances(self, q: np.ndarray) -> np.ndarray:
        """To all centroids: for the calibrated queries only."""
        return np.sqrt(np.maximum(0, self._far(q, None)))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``k`` nearest centroids of each row, nearest first;
        missing ones have an infinite distance."""
        ids, far = [], []
        for at in range(0, len(q), 64):
            a, b = self._search(q[at:at + 64], min(k, self.beam))
            ids.append(a)
            far.append(b)
        if not ids:
            return np.zeros((0, 1), np.int64), np.zeros((0, 1))
        return np.vstack(ids), np.sqrt(np.maximum(0, np.vstack(far)))

    def _search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.tile(self.entries, (len(q), 1))
        ids, far = self._best(q, ids)
        while True:
            wide = self.near[ids[:, :16]].reshape(len(q), -1)
            more, closer = self._best(q, np.hstack([ids, wide]))
            if np.array_equal(more, ids):
                return ids[:, :k], far[:, :k]
            ids, far = more, closer

    def _best(self, q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(ids, axis=1)
        far = self._far(q, ids)
        far[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        order = np.argsort(far, axis=1, kind="stable")[:, :self.beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


#: The walk goes on from centroids that are this much beyond the ratio, to miss fewer within.
MARGIN = 1.1

LISTED = "vec_id long, v array<double>, list long"
LISTED_KIND = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("list", pa.int64())])


def _listed(part: pa.RecordBatch, row: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    chosen = part.take(pa.array(row))
    return pa.RecordBatch.from_arrays(
        [chosen["vec_id"], chosen["v"].cast(LISTED_KIND.field("v").type), pa.array(ids, pa.int64())],
        schema=LISTED_KIND)


def _posted(rows: DataFrame, graph: Graph, norm: float, s: Settings) -> DataFrame:
    """Rows of (vec_id, v) once per list: the nearest, and those within ``1 + spread`` times its
    distance."""
    def run(batches):
        for part in slices(batches, 512):
            ids, far = graph.search(lengthen(matrix(part["v"]), norm), s.copies)
            fits = np.isfinite(far) & (far <= (1 + s.spread) * far[:, :1] + 1e-6)
            fits[:, :1] = np.isfinite(far[:, :1])
            row, col = np.nonzero(fits)
            yield _listed(part, row, ids[row, col])

    return rows.select("vec_id", "v").mapInArrow(run, LISTED)


def _stretched(q: np.ndarray, norm: float) -> np.ndarray:
    """Queries as long as vectors, with nothing in the component that lengthens those."""
    size = np.sqrt((q * q).sum(axis=1, keepdims=True))
    return np.hstack([q * (norm / size), np.zeros((len(q), 1))]).astype(np.float32)


def _asked(rows: DataFrame, graph: Graph, norm: float, bound: tuple[float, float]) -> DataFrame:
    """Queries of (vec_id, v) once per list within ``bound``, a ratio and a least distance."""
    def run(batches):
        for part in slices(batches, 512):
            row, ids = graph.within(_stretched(matrix(part["v"]), norm), *bound)
            yield _listed(part, row, ids)

    return rows.select("vec_id", "v").mapInArrow(run, LISTED)


def _bound(first: DataFrame, queries: DataFrame, posted: DataFrame, graph: Graph, norm: float,
           s: Settings) -> tuple[float, float]:
    """The ratio with which a bounded set of queries meets ``least_recall`` of its neighbours,
    and the least distance that it is applied to."""
    mixed = F.xxhash64("vec_id", F.lit(1))
    some = queries.select("vec_id", "v").orderBy(mixed, "vec_id").limit(s.calibrated).toArrow()
    if not some.num_rows:
        return 1.0, 0.0
    q_ids, q = some["vec_id"].to_numpy(), matrix(some["v"].combine_chunks())

    def run(batches):
        best = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for part in slices(batches, 4096):
            ids = part["vec_id"].to_numpy()
            score = q @ matrix(part["v"]).T
            score[q_ids[:, None] == ids[None, :]] = -np.inf
            score = np.hstack([best[0], score])
            found = np.hstack([best[1], np.tile(ids, (len(q), 1))])
            top = np.argsort(-score, axis=1, kind="stable")[:, :s.k]
            best = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
        row, col = np.nonzero(np.isfinite(best[0]))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(best[1][row, col]),
                                          pa.array(best[0][row, col])], schema=FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    exact = first.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
    exact = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    held = posted.select("vec_id", "list").join(F.broadcast(exact), "vec_id")  # k rows a query
    held = held.select("query_id", "vec_id", "list").toArrow()
    wide = _stretched(q, norm)
    far = graph.distances(wide)
    floor = float(np.median(far.min(axis=1)))
    if not held.num_rows:
        return 1.0, floor
    order = np.argsort(q_ids)
    row = order[np.searchsorted(q_ids, held["query_id"].to_numpy(), sorter=order)]
    at = held["list"].to_numpy()
    pairs = np.column_stack([row, held["vec_id"].to_numpy()])
    _, of = np.unique(pairs, axis=0, return_inverse=True)
    of = of.ravel()
    needed = np.full(of.max() + 1, np.inf)
    least = np.maximum(np.maximum(far.min(axis=1), floor), 1e-12)
    np.minimum.at(needed, of, far[row, at] / least[row])
    enough = int(np.ceil(s.least_recall * len(needed)))
    ratio = max(1.0, float(np.sort(needed)[enough - 1])) * (1 + 1e-5)
    while True:  # the graph may miss some of the lists within the ratio
        met, asked = np.zeros(len(needed), bool), np.zeros(far.shape, bool)
        asked[graph.within(wide, ratio, floor)] = True
        met[of[asked[row, at]]] = True
        if met.sum() >= enough or asked.all():
            return ratio, floor
        ratio *= 1.002


def nearest_in(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray,
               k: int) -> tuple[list, list, list]:
    """Query, vector and score of the ``k`` best of each query, itself left out."""
    out: tuple[list, list, list] = ([], [], [])
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    kept = min(k, len(ids))
    least = np.partition(rough, len(ids) - kept, axis=1)[:, len(ids) - kept]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    for i, query in enumerate(q_ids):
        best = np.flatnonzero((rough[i] >= least[i] - slack[i]) & np.isfinite(rough[i]))
        score = (x[best] * q[i]).sum(axis=1)  # the same for equal vectors, wherever they lie
        order = np.lexsort((ids[best], -score))[:k]
        out[0].extend([int(query)] * len(order))
        out[1].extend(ids[best[order]].tolist())
        out[2].extend(score[order].tolist())
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, is_query: Column, settings: Settings = Settings(),
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found of every query. ``is_query`` is a
    condition on ``vec_id``; candidates are all vectors but the query's own."""
    s = settings
    rows = cut_lineage(usable(vectors, key, vector), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    n, norm = facts["n"], float(facts["norm"] or 0.0) ** 0.5
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.most_sampled).toArrow()
    column = sample["v"].combine_chunks() if n else None
    x = lengthen(matrix(column), norm) if n else np.zeros((1, 2), np.float32)
    lists = max(1, min(-(-n // s.list_rows), len(x) // 8 or 1))
    graph = Graph(balanced_means(x, lists), s.links, s.beam)

    place = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("copy", F.row_number().over(place)).where(F.col("copy") <= s.k + 1)
    posted = cut_lineage(_posted(first, graph, norm, s), "postings")
    queries = rows.where(is_query)
    asked = _asked(queries, graph, norm, _bound(first, queries, posted, graph, norm, s))
    near = cut_lineage(_compared(posted, cut_lineage(asked, "probes"), s), "nearest")
    # Lists of very near centroids may hold less than k: such queries look into all lists.
    enough = near.groupBy("query_id").agg(F.count("*").alias("found"))
    enough = enough.where(F.col("found") >= min(s.k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = cut_lineage(rows.where(is_query).join(enough, "vec_id", "left_anti"), "short")
    if short.limit(1).count():
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(graph.centers) - 1)))
        again = _compared(posted, short.select("vec_id", "v", every.alias("list")), s)
        known = short.select(F.col("vec_id").alias("query_id"))
        near = near.join(known, "query_id", "left_anti").unionByName(again)
    return near


def _compared(posted: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """The ``k`` nearest of every query among the lists that it was dealt to."""
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / s.part_rows).alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / s.block_queries).alias("blocks"))
    sizes = F.broadcast(cut_lineage(parts.join(blocks, "list"), "lists"))  # a row per list

    def dealt(rows, own, other):
        out = rows.join(sizes, "list")
        out = out.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(own + "s")))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.col(other + "s") - 1)))

    left = dealt(posted, "part", "block").select("list", "part", "block", "vec_id", "v")
    right = dealt(asked, "block", "part").select("list", "part", "block", "vec_id", "v")

    def compare(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not own.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        a, b = own.combine_chunks(), queries.combine_chunks()
        found = nearest_in(a["vec_id"].to_numpy(), matrix(a["v"].combine_chunks()),
                           b["vec_id"].to_numpy(), matrix(b["v"].combine_chunks()), s.k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, FOUND)], schema=FOUND)

    keys = ("list", "part", "block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order).cast("int"))
    return near.where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
