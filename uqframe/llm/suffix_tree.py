"""Language-model scores from a probabilistic suffix tree over the words of a text.

The symbols are the words of a text (ASCII capitals made small) and its end. In the texts that are
learned from, every symbol is counted after the 1 to ``depth`` symbols before it, ends standing
before the first. Without a context a symbol has the probability of the base formula, so
unknown words have one too. A context is kept when it was seen at least ``least_count`` times and
when it passes a divergence test: its count times the divergence of its next-symbol distribution
from that of its longest kept suffix exceeds ``least_gain`` for each of its different symbols.
Its distribution is smoothed with that of the suffix by the number of different symbols. The longest
kept suffix of what came before scores each symbol. Neither the number of contexts nor that of
symbols has a limit, so the tree grows with the texts.

Words get numbers first: blocks of texts ask shards of the vocabulary, as sorted arrays of 96-bit
hashes, for the counts and numbers of their words (frequent ones have small numbers), and are
written once more in numbers. The tree is never in one place: blocks send their different records (a
symbol and the ``depth`` symbols before it, its count in the texts to learn from) to shards by
the nearest symbol, and get the logarithms back in the same order. A shard has all records of its
contexts, so it builds its branch of the tree and answers from it.

A context with more records than four shards should have is hot, and its records are spread by the next
symbol further back. What it says itself, for each symbol after it, is then summed by Spark
over all blocks and handed to the shards that its records were spread to. There are fewer than
``depth`` hot contexts a shard, found by a count that every block cuts off where
it cannot matter; that list is all that the driver sees.

Defined results: a null text is an empty one (one end); a document without id is held out;
repeated rows get a row each; without any text to learn from all counts are 0 and every symbol is
as likely as any other; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.blocks import drop_table, total_bytes, with_answers, write_blocks
from uqframe.llm.common import arrow_schema, mix
from uqframe.llm.substrings import BYTES_PER_WORD, SHARD_WORDS
from uqframe.sources.session import cut_lineage, new_path

LOG_STEPS = 1 << 20  # a logarithm travels as a whole number of such parts
BLOCK_BYTES = 8 << 20
HOT_SHARDS = 4  # a context with the records of more shards than this is spread
END = 0  # the number of a text's end; words have greater ones


@dataclass(frozen=True)
class Settings:
    depth: int = 2  # symbols of the longest contexts
    least_count: int = 2
    least_gain: float = 2.0
    modulus: int = 7
    remainder: int = 2
    shard_records: int = 1 << 20  # that a shard should have


def held_out(doc_id: int | None, s: Settings) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % s.modulus == s.remainder


def _pack(values: np.ndarray) -> bytes:
    """Byte by byte of all values, which compresses sorted and small numbers well."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


ASK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary()),
                    ("tokens", pa.int64()), ("kinds", pa.int64())])


def _vocabulary(words: list[list[bytes]], shards: int):
    """The hashes of a block's different words as rows of three 32-bit numbers, sorted by shard and
    hash, where each shard's begin, and the place of every word among them."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    flat = list(chain.from_iterable(words))
    place = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), np.uint32).reshape(-1, 4)[:, :3]
    shard = digests[:, 0] % np.uint32(shards)
    order = np.lexsort((digests[:, 0], digests[:, 1], digests[:, 2], shard))
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    return digests[order], to[place], edges


def _numbered(shards: int):
    """Sums a shard's counts and tells every block the counts and numbers of its words; the first
    answer has the shard's tokens and different words as well."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        asked = [_unpack(w, np.uint32, 4 * n).reshape(4, -1)
                 for w, n in zip(table["words"].to_pylist(), sizes)]
        *words, counts = np.concatenate(asked, axis=1)
        every = np.column_stack(words)
        order = np.lexsort(words)
        new = np.ones(len(order), bool)
        new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        sums = np.bincount(group, counts[order].astype(float)).astype(np.int64)
        place = np.empty(len(sums), np.int64)
        place[np.argsort(-sums, kind="stable")] = np.arange(len(sums))
        ids = 1 + place * shards + table["shard"][0].as_py()
        back = np.empty((2, len(order)), np.uint64)
        back[:, order] = sums[group], ids[group]
        edges = np.cumsum([0, *sizes])
        first = [True] + [False] * (len(sizes) - 1)
        return pa.Table.from_pydict(
            {"block": table["block"], "shard": table["shard"],
             "bits": [_pack(back[:, a:b].ravel()) for a, b in zip(edges[:-1], edges[1:])],
             "tokens": [int(sums.sum()) if f else 0 for f in first],
             "kinds": [int((sums > 0).sum()) if f else 0 for f in first]}, schema=ANSWER)

    return run


def _vocabulary_answers(blocks: DataFrame, shards: int, s: Settings) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                block, ids, texts = (batch[c][at].as_py() for c in ("block", "doc_ids", "texts"))
                words = [t.lower().split() for t in texts]
                distinct, place, edges = _vocabulary(words, shards)
                train = np.repeat([not held_out(d, s) for d in ids], [len(w) for w in words])
                counts = np.bincount(place[train], minlength=len(distinct)).astype(np.uint32)
                values = np.vstack([distinct.T, counts])
                rows = [{"shard": k, "block": block, "n": int(b - a), "words": _pack(values[:, a:b].ravel())}
                        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                yield pa.RecordBatch.from_pylist(rows, schema=ASK)

    asked = blocks.select("block", "doc_ids", "texts").mapInArrow(
        ask, "shard long, block long, n long, words binary")
    return cut_lineage(asked.groupBy("shard").applyInArrow(
        _numbered(shards), "block long, shard long, bits binary, tokens long, kinds long"), "counts")


@dataclass(frozen=True)
class Totals:
    tokens: int  # learned from, ends included
    kinds: int
    ends: int

    @property
    def size(self) -> int:
        return self.tokens + self.kinds + 1


CODED = ("block long, doc_ids array<long>, sizes array<long>, known array<long>, base array<double>, "
         "kinds long, places binary, ids binary, counts binary")


def _coded(blocks: DataFrame, answers: DataFrame, shards: int, total: Totals) -> DataFrame:
    """Blocks in numbers: tokens of each text, the block's different words with number and count,
    and the place among these of every word; with the texts' base scores."""
    kind = arrow_schema(CODED)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                block, docs, texts, found = (
                    batch[c][at].as_py() for c in ("block", "doc_ids", "texts", "counts"))
                words = [t.lower().split() for t in texts]
                distinct, place, edges = _vocabulary(words, shards)
                facts = np.zeros((2, len(distinct)), np.uint64)
                for a in found or ():
                    first, last = edges[a["shard"]:a["shard"] + 2]
                    facts[:, first:last] = _unpack(a["bits"], np.uint64, 2 * (last - first)).reshape(2, -1)
                order = np.argsort(-np.bincount(place, minlength=len(distinct)), kind="stable")
                frequent = np.empty(len(order), np.uint32)
                frequent[order] = np.arange(len(order))
                n = np.array([len(w) for w in words], np.int64)
                own = np.repeat(np.arange(len(n)), n)
                logs = np.log10((facts[0].astype(float) + 1) / total.size)
                base = np.bincount(own, logs[place], len(n)) + np.log10((total.ends + 1) / total.size)
                known = np.bincount(own, (facts[0] > 0)[place], len(n)).astype(np.int64)
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "doc_ids": docs, "sizes": n + 1, "known": known + (total.ends > 0),
                      "base": base, "kinds": len(order), "places": _pack(frequent[place]),
                      "ids": _pack(facts[1][order]), "counts": _pack(facts[0][order])}], schema=kind)

    full = with_answers(blocks, answers, "counts").select("block", "doc_ids", "texts", "counts")
    spark = blocks.sparkSession
    name = f"coded_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (full.mapInArrow(run, CODED).write.bucketBy(buckets, "block").option("path", new_path(spark, name))
     .option("compression", "none").saveAsTable(name))
    return spark.table(name)


class Symbols:
    """The symbols of a coded block: ``columns[0]`` each symbol, ``columns[k]`` the one ``k`` before
    it, ``counts`` how often the symbol was learned, ``train`` whether its text is learned from."""

    def __init__(self, row: dict, total: Totals, s: Settings):
        self.sizes = np.array(row["sizes"], np.int64)
        n = int(self.sizes.sum())
        ids, counts = (_unpack(row[c], np.uint64, row["kinds"]) for c in ("ids", "counts"))
        place = _unpack(row["places"], np.uint32, n - len(self.sizes))
        word = np.ones(n, bool)
        word[np.cumsum(self.sizes) - 1] = False
        symbol = np.full(n, END, np.uint64)
        symbol[word] = ids[place]
        self.counts = np.full(n, total.ends, np.uint64)
        self.counts[word] = counts[place]
        at = np.arange(n) + s.depth * (np.repeat(np.arange(len(self.sizes)), self.sizes) + 1)
        data = np.full(n + s.depth * len(self.sizes), END, np.uint64)
        data[at] = symbol
        self.columns = [data[at - k] for k in range(s.depth + 1)]
        self.train = np.repeat([not held_out(d, s) for d in row["doc_ids"]], self.sizes).astype(bool)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, sorted, a place of each, and which one every place has: as ``np.unique``, by
    a sort that may put equal keys in any order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[:len(keys)]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], order[new], of


def _joint(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(before ^ mix(symbol + np.uint64(0x9E3779B97F4A7C15)))


def _contexts(columns: list[np.ndarray], most: int):
    """64-bit hashes of the contexts of 1, 2, … ``most`` symbols."""
    out = np.zeros(len(columns[0]), np.uint64)
    for k in range(1, most + 1):
        out = _joint(out, columns[k])
        yield out


class Hot:
    """The hot contexts of each length: sorted hashes, into how many parts each is spread."""

    def __init__(self, found: pd.DataFrame, shards: int, s: Settings):
        self.shards, self.levels = shards, []
        for k in range(1, s.depth):
            own = found[found["level"] == k]
            keys = own["context"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            parts = np.ceil(own["n"].to_numpy(float) / s.shard_records)
            parts = np.clip(parts, 1, shards).astype(np.uint64)
            self.levels.append((keys[order], parts[order]))

    def table(self) -> pd.DataFrame:
        rows = [pd.DataFrame({"context": keys.view(np.int64), "parts": parts.astype(np.int64),
                              "base": (keys % np.uint64(self.shards)).astype(np.int64)})
                for keys, parts in self.levels]
        return pd.concat(rows) if rows else pd.DataFrame()

    def any(self) -> bool:
        return any(len(keys) for keys, _ in self.levels)

    def find(self, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some contexts of ``k`` symbols are hot, and the place of each that is."""
        keys = self.levels[k - 1][0]
        if not len(keys):
            return np.zeros(len(contexts), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
        hot = keys[at] == contexts
        return hot, at[hot]

    def route(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each record, and how many symbols its longest hot context has."""
        many = np.uint64(self.shards)
        deepest = np.zeros(len(columns[0]), np.uint8)
        shard = base = parts = None
        for k, context in enumerate(_contexts(columns, len(columns) - 1), 1):
            own = deepest == k - 1
            if k == 1:
                shard = context % many
            else:
                shard[own] = (base[own] + mix(context[own]) % parts[own]) % many
            if k == len(columns) - 1 or not len(self.levels[k - 1][0]):
                break
            hot, at = self.find(k, context)
            deepest[hot] = k
            if k == 1:
                parts = np.ones(len(hot), np.uint64)
            base = context % many
            parts[hot] = self.levels[k - 1][1][at]
        return shard.astype(np.int64), deepest


class Records:
    """The different records of a block in the order in which shards are asked for them."""

    def __init__(self, symbols: Symbols, hot: Hot):
        columns = symbols.columns
        key = _joint(list(_contexts(columns, len(columns) - 1))[-1], columns[0])
        _, first, self.of = _groups(key)
        if any((c[first][self.of] != c).any() for c in columns):  # two records with one hash
            _, first, self.of = np.unique(np.column_stack(columns), axis=0, return_index=True,
                                          return_inverse=True)
            self.of = self.of.ravel()
        self.columns = [c[first] for c in columns]
        self.counts = symbols.counts[first]
        self.n = np.bincount(self.of, symbols.train, len(first)).astype(np.uint64)
        shard, self.deepest = hot.route(self.columns)
        low = np.uint64((1 << 21) - 1)
        near, symbol = self.columns[1] & low, self.columns[0] & low  # what sorted columns save in bytes
        key = (shard.astype(np.uint64) << np.uint64(42)) | (near << np.uint64(21)) | symbol
        self.order = np.argsort(key, kind="stable")  # the same wherever it is made
        self.edges = np.searchsorted(shard[self.order], np.arange(hot.shards + 1))


def _each(batches):
    for batch in batches:
        yield from batch.to_pylist() if batch.num_rows < 2 else (
            row for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist())


def find_hot(coded: DataFrame, blocks: int, shards: int, total: Totals, s: Settings) -> Hot:
    """A context of more than ``HOT_SHARDS * shard_records`` symbols is hot. A block names those that
    have half the mean share of such a one in it, so a hot one is found with more than half of its
    symbols; a block names fewer than ``depth`` a shard."""
    kind = pa.schema([("level", pa.int32()), ("context", pa.int64()), ("n", pa.int64())])
    none = pd.DataFrame({"level": [], "context": [], "n": []})
    if shards < 2 or s.depth < 2:
        return Hot(none, shards, s)
    least = HOT_SHARDS * s.shard_records / (2 * max(1, blocks))

    def run(batches):
        for row in _each(batches):
            columns = Symbols(row, total, s).columns
            for k in range(1, s.depth):
                *_, context = _contexts(columns, k)
                distinct, of, n = np.unique(context, return_inverse=True, return_counts=True)
                large = n >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(large.sum(), k, np.int32)), pa.array(distinct[large].view(np.int64)),
                     pa.array(n[large])], schema=kind)
                columns = [c[large[of]] for c in columns]  # longer ones are no more frequent

    named = coded.select("sizes", "doc_ids", "kinds", "places", "ids", "counts").mapInArrow(
        run, "level int, context long, n long")
    named = named.groupBy("level", "context").agg(F.sum("n").alias("n"))
    return Hot(named.where(F.col("n") >= HOT_SHARDS * s.shard_records / 2).toPandas(), shards, s)


HOT = "level int, context long, parent long, symbol long, n long, known long"


def hot_facts(coded: DataFrame, hot: Hot, total: Totals, s: Settings) -> DataFrame:
    """(shard, context, symbol, p): the probability of every symbol that occurs after a hot context,
    once for each shard that its records are spread to."""
    spark = coded.sparkSession
    empty = spark.createDataFrame([], "shard long, context long, symbol long, p double")
    if not hot.any():
        return empty
    kind = arrow_schema(HOT)

    def run(batches):
        for row in _each(batches):
            symbols = Symbols(row, total, s)
            parent = np.zeros(len(symbols.train), np.uint64)
            for k, context in enumerate(_contexts(symbols.columns, s.depth - 1), 1):
                at = np.flatnonzero(hot.find(k, context)[0])
                _, first, of = _groups(_joint(context[at], symbols.columns[0][at]))
                n = np.bincount(of, symbols.train[at], len(first)).astype(np.int64)
                at = at[first]
                values = [np.full(len(at), k, np.int32), context[at].view(np.int64),
                          parent[at].view(np.int64), symbols.columns[0][at].view(np.int64), n,
                          symbols.counts[at].view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(values, kind)], schema=kind)
                parent = context

    rows = coded.select("sizes", "doc_ids", "kinds", "places", "ids", "counts").mapInArrow(run, HOT)
    rows = cut_lineage(rows.groupBy("level", "context", "parent", "symbol").agg(
        F.sum("n").alias("n"), F.max("known").alias("known")), "hot_symbols")
    out, shorter = None, None
    for k in range(1, s.depth):
        own = rows.where(F.col("level") == k)
        if shorter is None:
            own = own.withColumn("before", (F.col("known") + 1) / F.lit(float(total.size)))
        else:
            lower = shorter.select(F.col("context").alias("parent"), "symbol", F.col("p").alias("before"))
            own = own.join(lower, ["parent", "symbol"])
        sums = own.groupBy("context").agg(F.sum("n").alias("sum"), F.count_if(F.col("n") > 0).alias("kinds"))
        own = own.join(F.broadcast(sums), "context")  # one row per hot context
        size = F.greatest(F.col("sum") + F.col("kinds"), F.lit(1))
        own = own.withColumn("own", (F.col("n") + F.col("kinds") * F.col("before")) / size)
        gains = own.groupBy("context").agg(
            F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("own") / F.col("before"))).otherwise(0.0))
            .alias("gain"))
        own = own.join(F.broadcast(gains), "context")
        kept = (F.col("sum") >= s.least_count) & (F.col("gain") > F.col("kinds") * s.least_gain)
        shorter = cut_lineage(own.select(
            "context", "symbol", F.when(kept, F.col("own")).otherwise(F.col("before")).alias("p")), "hot")
        out = shorter if out is None else out.unionByName(shorter)
    places = spark.createDataFrame(hot.table(), "context long, parts long, base long")
    out = out.join(F.broadcast(places), "context")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    out = out.withColumn("part", part)
    return out.select(((F.col("base") + F.col("part")) % hot.shards).alias("shard"), "context", "symbol", "p")


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values


def _branch(columns: list[np.ndarray], n: np.ndarray, p: np.ndarray, deepest: np.ndarray,
            handed: dict[int, np.ndarray], s: Settings) -> np.ndarray:
    """The probability of each record of a shard. ``p`` is that without a context, ``handed[k]`` that
    of the records whose longest hot context has ``k`` symbols after that context."""
    p = p.copy()
    alive = np.arange(len(n))  # records whose contexts so far were frequent enough
    run = np.zeros(len(n), np.uint64)
    symbol = _groups(columns[0])[2].astype(np.uint64)
    wide = np.uint64(32)
    for k in range(1, s.depth + 1):
        place = _groups(columns[k][alive])[2].astype(np.uint64)
        run = _groups((run << wide) | place)[2].astype(np.uint64)
        spread = deepest[alive] >= k
        at = alive[~spread]
        grams, first, of = _groups((run[~spread] << wide) | symbol[at])
        counts, before = np.bincount(of, n[at], len(grams)), p[at[first]]
        context = grams >> wide
        group = np.cumsum(np.append(False, context[1:] != context[:-1])[:len(grams)])
        sums, kinds = np.bincount(group, counts), np.bincount(group, counts > 0)
        size = np.maximum(sums + kinds, 1)
        own = counts / size[group] + (kinds / size)[group] * before
        gain = np.bincount(group, counts * np.log(np.where(counts > 0, own / before, 1)))
        frequent = sums >= s.least_count
        kept = frequent & (gain > s.least_gain * kinds)
        p[at] = np.where(kept[group], own, before)[of]
        if k in handed:
            p[deepest == k] = handed[k]
        go_on = np.ones(len(alive), bool)
        go_on[~spread] = frequent[group][of]
        alive, run = alive[go_on], run[go_on]
    return p


ASK_RECORDS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
                         ("records", pa.binary())])
LOGS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())])


def record_logs(coded: DataFrame, hot: Hot, total: Totals, s: Settings) -> DataFrame:
    """(block, shard, bits): log10 probabilities of the records that the block asked the shard for."""
    def ask(batches):
        for row in _each(batches):
            r = Records(Symbols(row, total, s), hot)
            values = np.array([*r.columns, r.counts, r.n, r.deepest.astype(np.uint64)], np.uint64)[:, r.order]
            rows = [{"shard": k, "block": row["block"], "n": int(b - a),
                     "records": _pack(values[:, a:b].ravel())}
                    for k, (a, b) in enumerate(zip(r.edges[:-1], r.edges[1:])) if b > a]
            yield pa.RecordBatch.from_pylist(rows, schema=ASK_RECORDS)

    def answer(asked: pa.Table, facts: pa.Table) -> pa.Table:
        sizes = asked["n"].to_pylist()
        if not sizes:
            return LOGS.empty_table()
        values = np.concatenate([
            _narrow(_unpack(bits.as_py(), np.uint64, (s.depth + 4) * n)).reshape(s.depth + 4, -1)
            for bits, n in zip(asked["records"], sizes)], axis=1)
        columns, (known, n, deepest) = list(values[:s.depth + 1]), values[s.depth + 1:]
        handed = {}
        if facts.num_rows:
            context, symbol = (facts[c].to_numpy().astype(np.int64).view(np.uint64)
                               for c in ("context", "symbol"))
            keys = _joint(context, symbol)
            order = np.argsort(keys)
            p = facts["p"].to_numpy()[order]
            for k, own in enumerate(_contexts(columns, s.depth - 1), 1):
                spread = deepest == k
                wanted = _joint(own[spread], columns[0][spread])
                handed[k] = p[np.searchsorted(keys[order], wanted)]
        start = (known.astype(float) + 1) / total.size
        found = _branch(columns, n.astype(float), start, deepest, handed, s)
        logs = np.rint(-np.log10(found) * LOG_STEPS).astype(np.uint32)
        edges = np.cumsum([0, *sizes])
        return pa.Table.from_pydict(
            {"block": asked["block"], "shard": asked["shard"],
             "bits": [_pack(logs[a:b]) for a, b in zip(edges[:-1], edges[1:])]}, schema=LOGS)

    questions = coded.select("block", "sizes", "doc_ids", "kinds", "places", "ids", "counts").mapInArrow(
        ask, "shard long, block long, n long, records binary")
    facts = hot_facts(coded, hot, total, s)
    return questions.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(
        answer, "block long, shard long, bits binary")


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score."""
    s = settings
    name = f"blocks_{uuid.uuid4().hex}"
    blocks = write_blocks(docs, BLOCK_BYTES, name=name)
    shards, size = 1, total_bytes(blocks)
    while shards * SHARD_WORDS * BYTES_PER_WORD < size:
        shards *= 2
    answers = _vocabulary_answers(blocks, shards, s)
    learned = F.size(F.filter("doc_ids", lambda d: d.isNotNull() & (
        F.crc32(d.cast("string").cast("binary")) % s.modulus != s.remainder)))
    ends = blocks.agg(F.coalesce(F.sum(learned), F.lit(0))).first()[0]
    facts = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total = Totals(facts[0] + ends, facts[1] + (ends > 0), ends)
    coded = _coded(blocks, answers, shards, total)
    symbols = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    drop_table(docs.sparkSession, name)
    n_symbols, many = coded.agg(F.coalesce(F.sum(symbols), F.lit(0)), F.count("*")).first()
    tree_shards = max(1, -(-n_symbols // s.shard_records))
    hot = find_hot(coded, many, tree_shards, total, s)
    logs = record_logs(coded, hot, total, s)
    kind = arrow_schema(SCORED)

    def finish(batches):
        for row in _each(batches):
            symbols = Symbols(row, total, s)
            records = Records(symbols, hot)
            found = np.empty(len(records.order))
            for a in row["logs"]:
                mine = records.order[records.edges[a["shard"]]:records.edges[a["shard"] + 1]]
                found[mine] = _unpack(a["bits"], np.uint32, len(mine)) / -LOG_STEPS
            sizes, ids = symbols.sizes, row["doc_ids"]
            scores = np.add.reduceat(found[records.of], np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, "held_out": [held_out(d, s) for d in ids], "n_tokens": sizes,
                 "n_known": row["known"], "train_tokens": [total.tokens] * len(ids),
                 "base_score": row["base"], "score": scores}, schema=kind)

    return with_answers(coded, logs, "logs").drop("block").mapInArrow(finish, SCORED)


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
