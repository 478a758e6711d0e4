"""Removal of word sequences that an earlier document holds, with a count-min prefilter.

A window is ``width`` consecutive words of one document. Each block of documents makes a sparse
count-min sketch of its windows: a cell per window (a hash of as many bits as ``shards`` times
2**32), counted once per document. The sketches of all blocks are merged shard by shard; a cell's
count is at least that of each of its windows, so no repeated window is lost. Only windows in
cells counted twice or more go to the second pass, which groups them by a 128-bit key of their
words and finds the smallest ``doc_id`` of each. A window is removed from every document with a
larger id, and so is each word that it covers. Answers come back to the blocks as bits in the
order of the questions, so no window is ever a row.

Defined results: a null text is an empty one; a document without id keeps all words and removes
none; rows with the same id do not remove each other's words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from uqframe.llm.blocks import total_bytes, with_answers, write_blocks
from uqframe.llm.common import arrow_schema, mix
from uqframe.sources.session import cut_lineage

WIDTH = 13
#: Words of a shard, about: what the task that merges one holds.
SHARD_WORDS = 4_000_000
BYTES_PER_WORD = 5


class Digests(dict):
    """Word -> 128-bit hash, remembered up to ``most`` words (forgetting only costs time)."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_128_digest(word)
        return out


_DIGESTS = Digests()


class Windows:
    """The windows of a block. ``starts`` are the words that begin one; ``docs`` their
    documents' places in the block."""

    def __init__(self, doc_ids: list, texts: list[bytes], width: int):
        self.width = width
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        flat = b"".join([b"".join(map(_DIGESTS.__getitem__, w)) for w in self.words])
        self.hashes = np.frombuffer(flat, np.uint64).reshape(-1, 2)
        self.doc_of_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.ids = np.array([np.iinfo(np.int64).max if d is None else d for d in doc_ids], np.int64)
        known = np.array([d is not None for d in doc_ids], bool)
        n = len(self.hashes) - width + 1
        if n > 0:
            same = self.doc_of_word[:n] == self.doc_of_word[width - 1:]
            self.starts = np.flatnonzero(same & known[self.doc_of_word[:n]])
        else:
            self.starts = np.zeros(0, np.int64)
        self.docs = self.doc_of_word[self.starts]

    def key(self, lane: int, starts: np.ndarray) -> np.ndarray:
        """64-bit hash of the windows at ``starts``: one of two lanes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        h = self.hashes[:, lane]
        places = np.arange(1, self.width + 1, dtype=np.uint64) + np.uint64(lane << 32)
        factors = mix(places) | np.uint64(1)
        out = np.zeros(len(starts), np.uint64)
        for j in range(self.width):
            out += h[starts + j] * factors[j]
        return mix(out)

    def cells(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and cell of every window."""
        key = self.key(0, self.starts)
        cell = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return (key >> np.uint64(32)) % np.uint64(shards), cell


def _by_shard(order_keys: np.ndarray, shards: int) -> list[slice]:
    edges = np.searchsorted(order_keys, np.arange(shards + 1, dtype=order_keys.dtype))
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _distinct_cells(w: Windows, shards: int):
    """Combined shard and cell of the block's windows, sorted, each once."""
    shard, cell = w.cells(shards)
    code = (shard << np.uint64(32)) | cell.astype(np.uint64)
    distinct, place = np.unique(code, return_inverse=True)
    return distinct, place


def _sketch(w: Windows, shards: int):
    """(shard, cells, which of them two documents of the block share)."""
    distinct, place = _distinct_cells(w, shards)
    pairs = np.unique(place.astype(np.int64) * max(1, len(w.ids)) + w.docs)
    counts = np.bincount(pairs // max(1, len(w.ids)), minlength=len(distinct))
    shard = distinct >> np.uint64(32)
    for k, s in enumerate(_by_shard(shard, shards)):
        if s.stop > s.start:
            yield k, distinct[s].astype(np.uint32), counts[s] > 1


def _flagged(w: Windows, shards: int, answers: list[dict]) -> np.ndarray:
    """The starts of windows whose cells are counted twice or more."""
    distinct, place = _distinct_cells(w, shards)
    bits = _unpack(distinct >> np.uint64(32), shards, answers)
    return w.starts[bits[place]]


def _unpack(shard_of: np.ndarray, shards: int, answers: list[dict]) -> np.ndarray:
    out = np.zeros(len(shard_of), bool)
    parts = _by_shard(shard_of, shards)
    for a in answers or ():
        s = parts[a["shard"]]
        out[s] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=s.stop - s.start)
    return out


class Repeats:
    """The flagged windows of a block by their 128-bit keys, sorted by shard and key."""

    def __init__(self, w: Windows, starts: np.ndarray, shards: int):
        self.starts = starts
        a, b = w.key(0, starts), w.key(1, starts)
        ids = w.ids[w.doc_of_word[starts]]
        order = np.lexsort((ids, b, a, (a >> np.uint64(32)) % np.uint64(shards)))
        a, b, ids = a[order], b[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b, self.first = a[new], b[new], ids[new]
        self.shard = (self.a >> np.uint64(32)) % np.uint64(shards)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1


def _each_block(batches, columns):
    for batch in batches:
        for at in range(batch.num_rows):
            yield [batch[c][at].as_py() for c in columns]


ASK_CELLS = "shard long, block long, cells binary, twice binary"
ASK_KEYS = "shard long, block long, a binary, b binary, first binary"
ANSWER = "block long, shard long, bits binary"
ANSWER_ROWS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())])


def _merge_sketches(table: pa.Table) -> pa.Table:
    """Add the sketches of a shard and tell each block which of its cells count two or more."""
    cells = [np.frombuffer(c, np.uint32) for c in table["cells"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(c)).astype(bool)
             for t, c in zip(table["twice"].to_pylist(), cells)]
    every = np.sort(np.concatenate([*cells, *[c[t] for c, t in zip(cells, twice)]]))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for c in cells:
        at = np.minimum(np.searchsorted(repeated, c), max(0, len(repeated) - 1))
        hit = repeated[at] == c if len(repeated) else np.zeros(len(c), bool)
        bits.append(np.packbits(hit).tobytes())
    return pa.Table.from_pydict({"block": table["block"], "shard": table["shard"], "bits": bits},
                                schema=ANSWER_ROWS)


def _first_documents(table: pa.Table) -> pa.Table:
    """Group a shard's keys exactly; tell each block which of them an id below its own smallest
    holds."""
    parts = [[np.frombuffer(x, t) for x in table[c].to_pylist()]
             for c, t in (("a", np.uint64), ("b", np.uint64), ("first", np.int64))]
    a, b, first = (np.concatenate(p) for p in parts)
    order = np.lexsort((first, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.cumsum(new) - 1
    earlier = np.empty(len(order), bool)
    earlier[order] = first[order][new][group] < first[order]
    edges = np.cumsum([0, *map(len, parts[0])])
    bits = [np.packbits(earlier[x:y]).tobytes() for x, y in zip(edges[:-1], edges[1:])]
    return pa.Table.from_pydict({"block": table["block"], "shard": table["shard"], "bits": bits},
                                schema=ANSWER_ROWS)


def covered(w: Windows, shards: int, cells: list[dict], keys: list[dict]) -> np.ndarray:
    """Which words of the block are removed."""
    repeats = Repeats(w, _flagged(w, shards, cells), shards)
    earlier = _unpack(repeats.shard, shards, keys)[repeats.place]
    own = w.ids[w.doc_of_word[repeats.starts]]
    gone = repeats.starts[earlier | (own > repeats.first[repeats.place])]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + w.width, -1)
    return np.cumsum(edge[:-1]) > 0


def mark(docs: DataFrame, width: int = WIDTH, carry: list[str] = ()) -> tuple[DataFrame, int]:
    """Blocks with the answers of both passes (``cells`` and ``keys``), and the shard count."""
    blocks = write_blocks(docs, carry=carry)
    shards, n_bytes = 1, total_bytes(blocks)
    while shards * SHARD_WORDS * BYTES_PER_WORD < n_bytes:
        shards *= 2
    kinds = {c: arrow_schema(c) for c in (ASK_CELLS, ASK_KEYS)}

    def ask_cells(batches):
        for block, ids, texts in _each_block(batches, ("block", "doc_ids", "texts")):
            rows = [{"shard": k, "block": block, "cells": c.tobytes(),
                     "twice": np.packbits(t).tobytes()}
                    for k, c, t in _sketch(Windows(ids, texts, width), shards)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds[ASK_CELLS])

    def ask_keys(batches):
        for block, ids, texts, cells in _each_block(batches, ("block", "doc_ids", "texts", "cells")):
            w = Windows(ids, texts, width)
            r = Repeats(w, _flagged(w, shards, cells), shards)
            rows = [{"shard": k, "block": block, "a": r.a[s].tobytes(), "b": r.b[s].tobytes(),
                     "first": r.first[s].tobytes()}
                    for k, s in enumerate(_by_shard(r.shard, shards)) if s.stop > s.start]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds[ASK_KEYS])

    asked = blocks.select("block", "doc_ids", "texts").mapInArrow(ask_cells, ASK_CELLS)
    cells = asked.groupBy("shard").applyInArrow(_merge_sketches, ANSWER)
    blocks = with_answers(blocks, cut_lineage(cells, "cells"), "cells")
    asked = blocks.select("block", "doc_ids", "texts", "cells").mapInArrow(ask_keys, ASK_KEYS)
    keys = asked.groupBy("shard").applyInArrow(_first_documents, ANSWER)
    return with_answers(blocks, cut_lineage(keys, "keys"), "keys"), shards


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept_text, the words
    that stay joined by one space (null without ``with_text``)."""
    blocks, shards = mark(docs, width)
    kind = arrow_schema(KEPT)

    def finish(batches):
        for ids, texts, cells, keys in _each_block(batches, ("doc_ids", "texts", "cells", "keys")):
            w = Windows(ids, texts, width)
            gone = covered(w, shards, cells, keys)
            rows, at = [], 0
            for doc_id, ws in zip(ids, w.words):
                cut = gone[at:at + len(ws)]
                at += len(ws)
                removed = int(cut.sum())
                if removed:
                    ws = [x for x, c in zip(ws, cut.tolist()) if not c]
                kept = b" ".join(ws)
                rows.append({"doc_id": doc_id, "n_words": len(cut), "n_removed": removed,
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept if with_text else None})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    out = blocks.select("doc_ids", "texts", "cells", "keys").mapInArrow(finish, KEPT)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def cut_words(text: bytes, gone: list[bool]) -> bytes:
    """A text without some of its words and the blanks after them."""
    out, at = [], 0
    for m, g in zip(WORD.finditer(text), gone):
        if g:
            out.append(text[at:m.start()])
            at = m.end()
    return b"".join(out) + text[at:]


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents with all their columns, without the words that ``remove_repeats`` removes;
    ``n_chars`` follows the text. Texts that lose no word stay as they are; null texts stay null."""
    carry = [c for c in docs.columns if c != "text"]
    marked = docs.withColumn(IS_NULL, F.col("text").isNull())
    blocks, shards = mark(marked, width, [*carry, IS_NULL])
    schema = StructType.fromDDL("text binary").add("row", blocks.schema["rows"].dataType.elementType)
    kind = arrow_schema(schema)

    def finish(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, texts, cells, keys = (batch[c][at].as_py() for c in (
                    "doc_ids", "texts", "cells", "keys"))
                w = Windows(ids, texts, width)
                gone = covered(w, shards, cells, keys)
                out, k = [], 0
                for text, ws in zip(texts, w.words):
                    cut = gone[k:k + len(ws)]
                    k += len(ws)
                    out.append(cut_words(text, cut.tolist()) if cut.any() else text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out, pa.binary()), batch["rows"][at].values.cast(kind.field("row").type)],
                    schema=kind)

    done = blocks.select("doc_ids", "texts", "cells", "keys", "rows").mapInArrow(finish, schema)
    text = F.when(~F.col("row").getField(IS_NULL), F.col("text").cast("string"))
    done = done.withColumn("text", text)
    cols = {c: F.col("row").getField(c) for c in carry} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[cols[c].alias(c) for c in docs.columns])


IS_NULL = "_text_is_null"
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"
