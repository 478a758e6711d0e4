"""Phrase collocations from count streams in prefix order and in suffix order.

Every word of a piece starts one sequence of up to four words. Blocks of documents sort and count
their sequences and cut the sorted stream at the bounds of the shards, which are quantiles of a
sample of sequences, one per ``SHARD_BYTES / SAMPLES`` bytes of text. A shard merges the streams of
all blocks; sequences with a common beginning are neighbours there, so one pass over the stream
counts every phrase of one to four words. A phrase that reaches over the border of a shard is
handed on as partial counts, which are added. What remains are the phrases that occur ``least``
times or more, and no part of such a phrase is rarer than the phrase.

These counts are sorted twice, by their words and by their words from the last to the first. One
walk along the first stream gives each phrase the counts of all its beginnings and its most
frequent extension to the right; the same walk along the second one gives its endings and its
extension to the left. Walks go in blocks of a bounded number of phrases, with the beginnings of
a block's first phrase before it. A merge join of both streams then gives the scores. A longer
phrase that holds a dropped one holds it in an extension by one word that is as frequent, so
extensions by one word decide what is dropped.

Defined results: null and empty texts hold no words; a null language is ``und``; repeated rows
count each; a piece of one word counts that word only; ties go to the smaller phrase in byte
order; no rows give no phrases; extra columns are ignored. A long text is cut between words, with
the three words after the cut looked at from both sides, so its length does not matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import arrow_schema, slices
from uqframe.operators.skew import attach, fits
from uqframe.operators.splits import ranked
from uqframe.sources.session import cut_lineage

LONGEST = 4
LEAST = 30
KEEP_SHARE = 80
FIRST = 2000
UNKNOWN_LANG = "und"
#: Text bytes of a block, of a shard, and sampled sequences per shard.
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 12 << 20
SAMPLES = 64
#: Phrases that one task walks along at a time.
WALK_ROWS = 1 << 15

END = b"."
_UPPER, _STOPS = bytes(range(65, 91)), b".,;:!?\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _STOPS, _UPPER.lower() + b"\n" * len(_STOPS))

STREAM = "shard long, lang string, words binary, grams binary, counts binary"
COUNTS = "lang string, words array<binary>, f long"
WALKED = "lang string, key array<binary>, f long, chain array<long>, extension long"


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text in order, with ``END`` wherever a piece ends."""
    return text.translate(_TABLE).replace(b"\n", b" . ").split()


def _keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = grams.astype(np.uint64)
    return (wide[:, 0] << np.uint64(32)) | wide[:, 1], (wide[:, 2] << np.uint64(32)) | wide[:, 3]


def _added(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``grams`` (numbers up to ``size``) in order, with added counts."""
    if not len(grams):
        return grams, counts
    high, low = _keys(grams)
    bits = max(1, int(size).bit_length())
    if 4 * bits <= 64:
        key = np.zeros(len(grams), np.uint64)
        for j in range(LONGEST):
            key = (key << np.uint64(bits)) | grams[:, j].astype(np.uint64)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    return grams[order[starts]], np.add.reduceat(counts[order], starts)


def sorted_stream(sequence: list[bytes], first: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words in order, sequences as numbers of words, counts): all sequences that start in the
    ``first`` entries of words and ends; 0 stands for no word."""
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in sequence), np.int64, len(sequence))
    vocabulary = sorted(w for w in ids if w != END)
    rank = np.zeros(len(ids) + 1, np.uint32)
    for place, w in enumerate(vocabulary):
        rank[ids[w]] = place + 1
    line = np.concatenate([rank[flat], np.zeros(LONGEST, np.uint32)])
    grams = np.empty((first, LONGEST), np.uint32)
    alive = np.ones(first, bool)
    for j in range(LONGEST):
        alive &= line[j:first + j] > 0
        grams[:, j] = np.where(alive, line[j:first + j], 0)
    grams = grams[grams[:, 0] > 0]
    return vocabulary, *_added(grams, np.ones(len(grams), np.int64), len(vocabulary))


def _place(vocabulary: list[bytes], grams: tuple[np.ndarray, np.ndarray], bound: tuple) -> int:
    """How many sequences of a sorted stream come before ``bound``."""
    target = [0] * LONGEST
    for j, w in enumerate(bound):
        at = bisect_left(vocabulary, w)
        target[j] = at + 1
        if at == len(vocabulary) or vocabulary[at] != w:
            break
    high, low = grams
    wanted = np.uint64((target[0] << 32) | target[1]), np.uint64((target[2] << 32) | target[3])
    a, b = np.searchsorted(high, wanted[0], "left"), np.searchsorted(high, wanted[0], "right")
    return int(a + np.searchsorted(low[a:b], wanted[1], "left"))


def _shard_rows(lang: str, sequence: list[bytes], first: int, bounds: list[tuple]) -> list[dict]:
    """The stream of a block and language, cut at the bounds (language, words…) of the shards."""
    vocabulary, grams, counts = sorted_stream(sequence, first)
    before = bisect_left(bounds, (lang,))
    own = bounds[before:bisect_right(bounds, (lang, b"\xff" * 9))]
    keys = _keys(grams)
    edges = [0, *[_place(vocabulary, keys, b[1:]) for b in own], len(grams)]
    pack, out = zstandard.ZstdCompressor(level=1), []
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
        if x == y:
            continue
        part = grams[x:y]
        used = np.unique(part[part > 0])
        number = np.zeros(len(vocabulary) + 1, np.uint32)
        number[used] = np.arange(1, len(used) + 1)
        out.append({"shard": before + k, "lang": lang,
                    "words": pack.compress(b" ".join([vocabulary[u - 1] for u in used.tolist()])),
                    "grams": pack.compress(number[part].T.tobytes()),
                    "counts": pack.compress(counts[x:y].tobytes())})
    return out


def _streams(docs: DataFrame, bounds: list[tuple]) -> DataFrame:
    kind = arrow_schema(STREAM)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            rows = [r for lang, line in held.items() for r in _shard_rows(lang, line, len(line), bounds)]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        for part in slices(batches):
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                line = words_and_ends(text)
                most = BLOCK_BYTES // 4
                if len(line) > most:  # a long text makes blocks of its own
                    for at in range(0, len(line), most):
                        own = line[at:at + most + LONGEST - 1]
                        rows = _shard_rows(lang, own, min(most, len(own), len(line) - at), bounds)
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    continue
                into = held.setdefault(lang, [])
                into += line
                into.append(END)
                size += len(text) + len(lang)
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, STREAM)


def _sampled(docs: DataFrame, stride: int) -> list[tuple]:
    """One sequence (language, words…) per ``stride`` bytes of the texts of a task."""
    kind = arrow_schema("lang string, words array<binary>")

    def run(batches):
        passed = 0
        for part in slices(batches):
            rows = []
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                for at in range(stride - passed % stride, len(text), stride):
                    start = text.find(b" ", at) + 1
                    line = words_and_ends(text[start:start + 256])[:-1] if start else []
                    line = line[:LONGEST]
                    if line and line[0] != END:
                        cut = line.index(END) if END in line else len(line)
                        rows.append({"lang": lang, "words": line[:cut]})
                passed += len(text)
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    found = docs.mapInArrow(run, "lang string, words array<binary>").collect()
    return sorted((r["lang"], *map(bytes, r["words"])) for r in found)


def _merge_shard(least: int):
    """Add the streams of a shard and count the phrases of each length along the result."""
    kind = arrow_schema(COUNTS)

    def merge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        by_lang: dict[str, list[dict]] = {}
        for row in table.select(["lang", "words", "grams", "counts"]).to_pylist():
            by_lang.setdefault(row["lang"], []).append(row)
        out = {"lang": [], "words": [], "f": []}
        for lang, rows in by_lang.items():
            lists = [unpack.decompress(r["words"]).split(b" ") for r in rows]
            vocabulary = sorted(set().union(*lists))
            number = {w: k + 1 for k, w in enumerate(vocabulary)}
            parts = []
            for r, own in zip(rows, lists):
                to = np.array([0, *[number[w] for w in own]], np.uint32)
                grams = np.frombuffer(unpack.decompress(r["grams"]), np.uint32)
                parts.append(to[grams.reshape(LONGEST, -1).T])
            counts = np.concatenate([np.frombuffer(unpack.decompress(r["counts"]), np.int64)
                                     for r in rows])
            grams, counts = _added(np.concatenate(parts), counts, len(vocabulary))
            out["lang"].append(lang)
            out["words"].append([])
            out["f"].append(int(counts.sum()))
            for words, f in phrase_counts(grams, counts, least):
                out["lang"].append(lang)
                out["words"].append([vocabulary[w - 1] for w in words])
                out["f"].append(f)
        return pa.Table.from_pydict(out, schema=kind)

    return merge


def phrase_counts(grams: np.ndarray, counts: np.ndarray, least: int):
    """Phrases of each length along a sorted stream that occur ``least`` times or more, and those
    at its two borders, with their counts."""
    new = np.zeros(len(grams), bool)
    new[0] = True
    for m in range(1, LONGEST + 1):
        new[1:] |= grams[1:, m - 1] != grams[:-1, m - 1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts, starts)
        wanted = sums >= least
        wanted[0] = wanted[-1] = True
        wanted &= grams[starts, m - 1] > 0
        for at, f in zip(starts[wanted].tolist(), sums[wanted].tolist()):
            yield grams[at, :m].tolist(), f


def count_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, f): all phrases of one to four words that occur ``least`` times or more, and
    one row without words per language, whose ``f`` counts all words."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    read = read.where(F.octet_length("text") > 0)
    n_bytes = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    bounds: list[tuple] = []
    if shards > 1:
        samples = _sampled(read, SHARD_BYTES // SAMPLES)
        bounds = sorted(set(samples[SAMPLES::SAMPLES]))
    parts = _streams(read, bounds).groupBy("shard").applyInArrow(_merge_shard(least), COUNTS)
    found = parts.groupBy("lang", "words").agg(F.sum("f").alias("f"))
    found = found.where((F.col("f") >= least) | (F.size("words") == 0))
    return cut_lineage(found, "phrases")


def _walk(table: pa.Table, kind: pa.Schema) -> pa.Table:
    """Along phrases in order: the counts of each one's beginnings, and of its most frequent
    extension by one word. Rows that are only there for their counts get no chain."""
    rows = sorted(zip(table["lang"].to_pylist(), table["key"].to_pylist(), table["f"].to_pylist(),
                      table["context"].to_pylist()), key=lambda r: (r[0], r[1]))
    chains, best, open_ = [], [0] * len(rows), []
    for at, (lang, key, f, context) in enumerate(rows):
        while open_ and (rows[open_[-1]][0] != lang
                         or rows[open_[-1]][1] != key[:len(rows[open_[-1]][1])]):
            open_.pop()
        chains.append(None if context else [rows[o][2] for o in open_])
        if open_ and len(rows[open_[-1]][1]) == len(key) - 1:
            best[open_[-1]] = max(best[open_[-1]], f)
        open_.append(at)
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], chains, best]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def walk(counts: DataFrame, key: Column) -> DataFrame:
    """(lang, key, f, chain, extension) of phrases in the order of ``key``: the counts of the
    phrases that begin it, shortest first, and that of the most frequent one word longer."""
    order = ranked(counts.select("lang", key.alias("key"), "f"), F.col("lang"), F.col("key"))
    order = order.withColumn("block", F.floor(F.col("rank") / WALK_ROWS))
    starts = order.where((F.col("rank") % WALK_ROWS == 0) & (F.size("key") > 1))
    begun = F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda i: F.slice("key", 1, i))
    wanted = starts.select("block", "lang", F.explode(begun).alias("key"))
    context = wanted.join(order.select("lang", "key", "f"), ["lang", "key"])
    rows = order.select("block", "lang", "key", "f", F.lit(False).alias("context")).unionByName(
        context.withColumn("context", F.lit(True)))
    kind = arrow_schema(WALKED)
    walked = rows.groupBy("block").applyInArrow(lambda t: _walk(t, kind), WALKED)
    return walked.groupBy("lang", "key").agg(
        F.max("f").alias("f"), F.max("chain").alias("chain"), F.max("extension").alias("extension"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, keep_share: int = KEEP_SHARE,
                 first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of two to four
    words by their lowest-scoring cut; see the module for what the columns hold."""
    counts = count_phrases(docs, least)
    phrases = counts.where(F.size("words") > 0)
    left = walk(phrases, F.col("words")).withColumnRenamed("key", "words")
    right = walk(phrases, F.reverse("words")).select(
        "lang", F.reverse("key").alias("words"), F.col("chain").alias("endings"),
        F.col("extension").alias("extension_left"))
    both = left.hint("merge").join(right, ["lang", "words"]).where(F.size("words") > 1)
    longer = F.greatest("extension", "extension_left")
    both = both.where(_wide(longer) * 100 < _wide(F.col("f")) * keep_share)
    both = both.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    both = both.withColumns({"l": F.get("chain", F.col("k") - 1),
                             "r": F.get("endings", F.size("words") - F.col("k") - 1)})
    both = both.withColumn("score", F.expr(
        "(cast(f as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + r)"))
    cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    text = F.array_join(F.transform("words", lambda w: w.cast("string")), " ")
    scored = both.groupBy("lang", "words", "f").agg(cut).select(
        "lang", text.alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    top = ranked(scored, F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase"))
    totals = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    starts = top.groupBy("lang").agg(F.min("rank").alias("_first")).join(totals, "lang")
    top = attach(top, starts, ["lang"], "inner", bounded=fits(starts))
    top = top.withColumn("rank", F.col("rank") - F.col("_first") + 1).where(F.col("rank") <= first)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
