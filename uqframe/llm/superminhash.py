"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Every shingle of a document gives one value to each slot, in the order of a random permutation
of its own: its j-th slot gets a value between j and j + 1. The ranks of a shingle are thus
correlated, which makes the estimate of similarity less variable than independent hashes do, and
once every slot is filled below j + 1 no shingle needs its later ranks. Signatures of equal sets
are taken once (their smallest ``doc_id`` stands for all copies) and cut into bands; documents
that share a band are candidates.

Links are confirmed on full sets. First every member of a band is compared with the band's
smallest id. Where members of a band are then still in different components, they are compared
in tiles, tile against tile, of which only the links that join components come back. A tile holds
members of one class of set sizes, at most ``TILE`` of them and at most ``TILE_ITEMS`` shingles (or
one longer document), and meets tiles of its own class and the next one only: sets further apart
in size cannot be similar. Members get their tiles from their place in an order sorted by ranges,
so no task sees all of a band. So a group of many near copies costs one comparison each, and no link is
lost that a shared band shows: with 24 bands of 4 rows a pair of similarity 0.8 shares none with
a probability of 3 in a million.

Defined results: a null text is an empty one; an empty document has no shingles and is linked
with nothing; a document without id has no component, is linked with nothing and is kept;
repeated rows get a row each, and of an id with several texts each is a set of its own in the bands,
while links are confirmed on the one that is smallest as bytes of hashes; texts of any length are
compared whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import WordHashes, map_rows, mix, slices
from uqframe.llm.components import Forest, components
from uqframe.operators.skew import attach, fits
from uqframe.operators.splits import ranked
from uqframe.sources.session import cut_lineage

SLOTS, ROWS = 96, 4
BANDS = SLOTS // ROWS
CHUNK = 4096
TILE, TILE_ITEMS = 64, 1 << 20
KIND_AT = 40  # a tile's number has its class of sizes above this bit
GRID_COLUMNS = 1 << 16  # shingles that a comparison of tiles looks at together
SALTS = 16
ODD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_HASHES = WordHashes()


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; with fewer words, one of
    the whole sequence; without words, none."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = _HASHES.array(ws)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for j in range(size):
        out = mix(out * ODD[j] + h[j:len(h) - size + 1 + j])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """SuperMinHash of a non-empty set: rank in the upper 8 bits, 56 random bits below."""
    out = np.full(SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(items), CHUNK):
        part = items[at:at + CHUNK]
        row = np.arange(len(part))
        order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(part), 1))
        for j in range(SLOTS):
            if int(out.max()) >> 56 < j:
                break
            bits = mix(part + ODD[j])
            k = j + (bits % np.uint64(SLOTS - j)).astype(np.int64)
            slot = order[row, k]
            order[row, k] = order[:, j]
            order[:, j] = slot
            value = (mix(bits) >> np.uint64(8)) | np.uint64(j << 56)
            np.minimum.at(out, slot, value)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * ODD[j] + rows[:, j])
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set) and bands."""
    def per_slice(part):
        sets = [shingles(t or b"", size) for t in part["text"].to_pylist()]
        return {"doc_id": part["doc_id"], "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [band_keys(signature(s)) if len(s) else None for s in sets]}

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))
    return cut_lineage(map_rows(read, per_slice, "doc_id long, n_shingles long, set_key binary, "
                                                 "bands array<long>"), "signatures")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, items) of the documents listed in ``wanted`` (doc_id)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))
    wanted = F.broadcast(wanted) if fits(wanted, 500_000) else wanted
    read = read.join(wanted, "doc_id", "left_semi")

    def per_slice(part):
        return {"doc_id": part["doc_id"],
                "items": [shingles(t or b"", size).tobytes() for t in part["text"].to_pylist()]}

    sets = map_rows(read, per_slice, "doc_id long, items binary")
    sets = sets.groupBy("doc_id").agg(F.min("items").alias("items"))
    n = (F.octet_length("items") / 8).cast("long")
    return cut_lineage(sets.select("doc_id", n.alias("n"), "items"), "sets")


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def check_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (center, member) those that are similar, as (a, b). Members stream past
    their center's set; those of one center are dealt over ``SALTS`` tasks."""
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    members = stars.join(sets.withColumnRenamed("doc_id", "member"), "member")
    heads = stars.select("center", "salt").distinct().withColumn("member", F.lit(None).cast("long"))
    heads = heads.join(sets.withColumnRenamed("doc_id", "center"), "center")
    cols = ["center", "salt", "member", "items"]
    rows = members.select(*cols).unionByName(heads.select(*cols))
    rows = rows.repartition("center", "salt").sortWithinPartitions(
        "center", "salt", F.col("member").asc_nulls_first())

    def run(batches):
        head: np.ndarray = np.zeros(0, np.uint64)
        for part in slices(batches):
            found: dict[str, list] = {"a": [], "b": []}
            for center, member, items in zip(*(part[c].to_pylist() for c in (
                    "center", "member", "items"))):
                own = np.frombuffer(items, np.uint64)
                if member is None:
                    head = own
                elif similar(head, own, percent):
                    found["a"].append(center)
                    found["b"].append(member)
            yield pa.RecordBatch.from_pydict(found, schema=EDGES)

    return rows.mapInArrow(run, "a long, b long")


def tile_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int,
               split: int) -> Iterator[tuple[int, int]]:
    """Links that join different labels among some documents: all pairs if ``split`` is 0, else
    the first ``split`` against the others. Shingles that only one of them holds are counted,
    not compared."""
    if not sets:
        return
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    owner = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int((times > 1).sum()), GRID_COLUMNS):
        low, high = np.searchsorted(column, [at, at + GRID_COLUMNS])
        grid = np.zeros((len(sets), min(GRID_COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        grid[owner[low:high], column[low:high] - at] = 1
        both += (grid @ grid.T).astype(np.int64)
    n = np.array([len(s) for s in sets], np.int64)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (n[:, None] > 0)
    forest = Forest()
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        if split and (i >= split or j < split):
            continue
        if labels[i] != labels[j] and forest.union(labels[i], labels[j]):
            yield ids[i], ids[j]


def class_step(percent: int) -> float:
    """Similar sets lie in the same class of sizes or in adjacent ones: a class is a little wider
    than the largest quotient of their sizes."""
    return max(100 / percent, 1.01) * 1.001


def size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(math.log(class_step(percent))))


def check_tiles(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets (bucket, doc_id, label). A tile travels as one
    row; tiles of a bucket meet pairwise, but for two that hold one component only."""
    kind = size_class(F.col("n"), percent)
    rows = buckets.join(sets.select("doc_id", "n"), "doc_id").withColumn("kind", kind)
    rows = ranked(rows, *(F.col(c) for c in ("bucket", "kind", "label", "doc_id")))
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(
        F.lit(float(TILE_ITEMS)) / F.pow(F.lit(class_step(percent)), F.col("kind") + 1))))
    number = F.shiftleft("kind", KIND_AT) + F.floor(F.col("rank") / most)
    rows = rows.withColumn("tile", number).drop("kind", "n", "rank")
    tiles = rows.join(sets.select("doc_id", "items"), "doc_id").groupBy("bucket", "tile").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        F.collect_list(F.struct("doc_id", "label", "items")).alias("docs"))
    tiles = cut_lineage(tiles, "tiles")
    spans = tiles.select("bucket", "tile", "low", "high", F.shiftright("tile", KIND_AT).alias("kind"))
    x = spans.withColumn("meets", F.explode(F.array(F.col("kind"), F.col("kind") + 1)))
    x, y = x.alias("x"), spans.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.meets") == F.col("y.kind"))
                   & (F.col("x.tile") <= F.col("y.tile")))
    pairs = pairs.where(~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high"))
                          & (F.col("x.low") == F.col("y.low"))))
    pairs = pairs.select(F.col("x.bucket").alias("bucket"), F.col("x.tile").alias("i"),
                         F.col("y.tile").alias("j"))
    sides = pairs.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    full = sides.join(tiles.select("bucket", "tile", "docs"), ["bucket", "tile"])

    def run(table: pa.Table) -> pa.Table:
        parts = [sorted(docs, key=lambda d: d["doc_id"])
                 for docs in table.sort_by("tile")["docs"].to_pylist()]
        docs = [d for part in parts for d in part]
        links = list(tile_links([d["doc_id"] for d in docs], [d["label"] for d in docs],
                                [np.frombuffer(d["items"], np.uint64) for d in docs], percent,
                                len(parts[0]) if len(parts) > 1 else 0))
        return pa.Table.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]},
                                    schema=EDGES)

    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)
    and kept (whether that is the document itself)."""
    sigs = signatures(docs, size)
    known = sigs.where("doc_id is not null and set_key is not null")
    first = known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"),
                                         F.min_by("bands", "doc_id").alias("bands"))
    first = cut_lineage(first, "sets_once")
    bands = first.select(F.col("first").alias("doc_id"), F.posexplode("bands").alias("band", "key"))
    sizes = bands.groupBy("band", "key").agg(F.min("doc_id").alias("center"),
                                             F.count("*").alias("size")).where("size > 1")
    members = bands.join(sizes, ["band", "key"]).where("doc_id <> center")
    members = cut_lineage(members.select("band", "key", "center", "size",
                                         F.col("doc_id").alias("member")), "bands")
    stars = cut_lineage(members.select("center", "member").distinct(), "stars")
    wanted = stars.select(F.explode(F.array("center", "member")).alias("doc_id")).distinct()
    sets = full_sets(docs, cut_lineage(wanted, "wanted"), size)
    links = cut_lineage(check_stars(stars, sets, percent), "edges")
    labels = components(links)

    # Bands whose members are still apart; the same members in several bands count once.
    rows = members.where("size > 2").select("band", "key", F.col("member").alias("doc_id"))
    rows = rows.union(members.where("size > 2").select("band", "key", "center").distinct())
    rows = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.withColumn("label", F.coalesce("component", "doc_id"))
    apart = rows.groupBy("band", "key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum")).where("low <> high")
    apart = apart.groupBy("size", "sum").agg(F.min(F.struct("band", "key")).alias("b"))
    apart = apart.select("b.band", "b.key", F.xxhash64("b.band", "b.key").alias("bucket"))
    rows = rows.join(apart, ["band", "key"]).select("bucket", "doc_id", "label")
    more = cut_lineage(check_tiles(cut_lineage(rows, "apart"), sets, percent), "edges")
    if more.limit(1).count():
        labels = components(links.union(more))

    copies = first.where("n > 1").select("set_key", "first")
    out = attach(sigs.drop("bands"), copies, ["set_key"], bounded=fits(copies), salt_by=["doc_id"])
    out = out.withColumn("first", F.when(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull(),
                                         F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    labels = labels.withColumnRenamed("node", "first")
    out = attach(out, labels, ["first"], bounded=fits(labels), salt_by=["doc_id"])
    own = F.coalesce("component", "first")
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the
    smallest id. Repeated rows of a document stay or go together."""
    found = near_duplicates(docs, size, percent)
    gone = cut_lineage(found.where("not kept").select("doc_id").distinct(), "duplicates")
    gone = F.broadcast(gone) if fits(gone, 500_000) else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
