"""Packing documents into training sequences by non-negative least squares over lengths.

Every document is its ids and one end id. It is cut into full windows, which are sequences of
their own, and a tail. Tails are counted in a histogram of lengths rounded up to ``GRID`` ids.
All combinations of up to three rounded lengths that fill a window are enumerated; non-negative
least squares gives how often each is repeated so that the histogram is met; rounding down never
takes more than there is. What is left is packed greedily, the longest first with the longest
that fit, and tails that no combination fills are laid one after the other and cut at the ends
of windows. The histogram and the plan have at most ``window / GRID`` lengths, whatever the
number of documents; each document finds its place from its rank among those of its length.

Defined results: a null text is an empty one (its end id alone); a null ``doc_id`` is kept;
repeated rows are packed each; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uqframe.llm.common import map_rows
from uqframe.sources.session import cut_lineage

GRID = 8
DEPTH = 3
#: Greedy combinations may leave this many steps of the grid empty.
SLACK = 3
MOST_WORDS, MOST_UNITS, LONGEST_KEPT = 300_000, 500_000, 40
#: Latin words and ASCII signs where what follows cannot belong to the same token; else words.
#: Of the letters at 0xC3, 0x97 and 0xB7 are the signs of multiplication and division.
UNITS = re.compile(rb"(?:[0-9a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff'])"
                   rb"|[!-&(-/:-@[-`{-~]++(?![\x00-\x08\x0e-\x1f\x7f-\xff'])|[^ \t-\r]+")


class Remembered(dict):
    """Takes short keys until it is full, and starts anew after many that found no room: common
    words come early and stay, and forgetting only costs time."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.turned_away = most, 0

    def keep(self, new: dict) -> None:
        if len(self) >= self.most:
            self.turned_away += len(new)
            if self.turned_away < 4 * self.most:
                return
            self.clear()
            self.turned_away = 0
        self.update((k, v) for k, v in new.items() if len(k) <= LONGEST_KEPT)


# fixed values: how a file must normalise and split for texts to be cut at blanks and into units
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_blanks(definition: dict) -> bool:
    """Whether tokens of a file never hold blanks and never join letters with signs."""
    normal, cuts = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    first = (cuts.get("pretokenizers") or [{}])[0]
    return (normal.get("normalizers") == NORMAL and first.get("type") == "Split"
            and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True
            and first.get("behavior") == "Removed"
            and all(c == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
                    for c in cuts["pretokenizers"][1:])
            and not definition.get("post_processor"))


class Tokens:
    """Ids of whole texts from a tokenizers file. Where its tokens never hold blanks and never join
    letters with signs, ids of words are remembered, and those of their units; other files get
    whole texts."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(definition)
        facts = json.loads(definition)
        self.by_words = splits_at_blanks(facts)
        special = [re.escape(t["content"].encode()) for t in facts["added_tokens"]]
        self.special = re.compile(b"|".join(special)) if special else None
        self.words, self.units = Remembered(MOST_WORDS), Remembered(MOST_UNITS)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tool.encode_batch_fast([t.decode("utf-8", "replace") for t in texts],
                                            add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (binary, null: empty). Texts are split and their different words
        found in Arrow; only these are looked up one by one."""
        if not self.by_words:
            return [np.frombuffer(i, "<u4") for i in self._ids([t or b"" for t in texts.to_pylist()])]
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
        flat = words.values.view(pa.binary()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        known = list(map(self.words.get, distinct))
        new = {w for w, i in zip(distinct, known) if i is None}
        if new:
            fresh = self._word_ids(new)
            known = [fresh[w] if i is None else i for w, i in zip(distinct, known)]
            self.words.keep(fresh)
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array([len(i) // 4 for i in known], np.int64)
        first = np.cumsum(sizes) - sizes
        place = flat.indices.to_numpy()
        size = sizes[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        every = ids[np.arange(total) + np.repeat(first[place] - (ends - size), size)]
        edges = np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]
        out = [every[a:b] for a, b in zip(edges[:-1], edges[1:])]
        if self.special:
            for k, text in enumerate(texts.to_pylist()):
                if text and self.special.search(text):
                    out[k] = np.frombuffer(self._ids([text])[0], "<u4")
        return out

    def _word_ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        units = {w: UNITS.findall(w) for w in words}
        seen = self.units
        new = list({u for us in units.values() for u in us if u not in seen})
        fresh = dict(zip(new, self._ids(new))) if new else {}
        out = {w: b"".join([fresh[u] if u in fresh else seen[u] for u in us])
               for w, us in units.items()}
        seen.keep(fresh)
        return out


_TOKENS: dict[int, Tokens] = {}


def tokens(definition: str) -> Tokens:
    key = zlib.crc32(definition.encode())
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(definition)
    return _TOKENS[key]


def combinations(size: int) -> np.ndarray:
    """All ways to fill ``size`` steps with one to three lengths: counts per length, one column
    per way."""
    columns = []
    for a in range(1, size + 1):
        if a == size:
            columns.append((a,))
        if 2 * a <= size:
            columns.append((a, size - a))
        columns += [(a, b, size - a - b) for b in range(a, (size - a) // 2 + 1)]
    out = np.zeros((size + 1, len(columns)))
    for k, lengths in enumerate(columns):
        np.add.at(out, (list(lengths), k), 1)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, most_steps: int = 2000) -> np.ndarray:
    """Active sets: let the column with the steepest descent in, solve, and step back to the
    first column that would turn negative until none does."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most_steps):
        slope = a.T @ (b - a[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active.append(best)
        while active:
            own = a[:, active]
            squares = own.T @ own
            squares[np.diag_indices_from(squares)] += 1e-12
            solved = np.linalg.solve(squares, own.T @ b)
            if (solved > 0).all():
                x[active] = solved
                break
            now, low = x[active], solved <= 0
            ratio = now[low] / np.maximum(now[low] - solved[low], 1e-300)
            x[active] = np.maximum(0, now + ratio.min() * (solved - now))
            out = [k for k, l in zip(active, low) if l and x[k] <= tolerance]
            x[out] = 0
            active = [k for k in active if k not in out]
            if best in out:  # it cannot get in
                return x
    return x


@dataclass(frozen=True)
class Plan:
    """Places by rank. ``rows`` has (length, first rank, end rank, first sequence, slot,
    stream position or -1), sorted by length and rank."""

    rows: np.ndarray
    sequences: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """Where tails of each rounded length go; ``histogram[k]`` counts those of ``k`` steps."""
    size = window // GRID
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple] = []
    sequence = 0

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal sequence
        for slot, k in enumerate(lengths):
            rows.append((k, used[k], used[k] + repeats, sequence, slot, -1))
            used[k] += repeats
            left[k] -= repeats
        sequence += repeats

    ways = combinations(size)
    ways = ways[:, (ways[left == 0] == 0).all(axis=0)]
    if ways.shape[1]:
        scale = float(left.max())
        repeats = nonnegative_least_squares(ways, left / scale) * scale
        for k in np.argsort(-repeats, kind="stable"):
            lengths = np.repeat(np.arange(size + 1), ways[:, k].astype(int)).tolist()
            most = min(left[j] // lengths.count(j) for j in lengths)
            if (n := int(min(most, np.floor(repeats[k] + 1e-6)))) > 0:
                place(lengths[::-1], n)
    streamed: list[int] = []
    while left.any():
        first = int(np.flatnonzero(left).max())
        lengths, gap, rest = [first], size - first, left.copy()
        rest[first] -= 1
        while gap > SLACK and (fit := np.flatnonzero(rest[:gap + 1])).size:
            k = int(fit.max())
            lengths.append(k)
            gap -= k
            rest[k] -= 1
        if gap > SLACK:
            streamed.append(first)
            left[first] = 0
        else:
            place(lengths, int(min(left[j] // lengths.count(j) for j in set(lengths))))
    at = 0
    for k in streamed:
        n = int(histogram[k] - used[k])
        rows.append((k, used[k], used[k] + n, sequence, 0, at))
        at += n * k * GRID
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return Plan(table, sequence + -(-at // window))


def places(plan: Plan, window: int, length: int, steps: int, rank: int) -> list[tuple]:
    """(ids before it in the tail, length, sequence, slot) of the one or two pieces of a tail."""
    r = plan.rows
    i = int(np.searchsorted(r[:, 0] * (1 << 48) + r[:, 1], steps * (1 << 48) + rank, "right")) - 1
    _, first, _, sequence, slot, at = (int(v) for v in r[i])
    if at < 0:
        return [(0, length, sequence + rank - first, slot)]
    begin = at + (rank - first) * steps * GRID
    room = window - begin % window
    head = (0, min(length, room), sequence + begin // window, begin % window)
    if length <= room:
        return [head]
    return [head, (room, length - room, sequence + begin // window + 1, 0)]


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the ids themselves. ``tokenizer`` is the path of a tokenizers file."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(part):
        task = TaskContext.get().partitionId()
        out: dict[str, list] = {c: [] for c in ("n", "blocks", "full", "ids", "steps", "rank")}
        ranks = _COUNTERS.setdefault(TaskContext.get().taskAttemptId(), {})
        if len(_COUNTERS) > 1:  # of tasks that are over
            for old in [k for k in _COUNTERS if _COUNTERS[k] is not ranks]:
                del _COUNTERS[old]
        for ids in tokens(definition).encode(part["text"]):
            ids = ids.tobytes() + end
            n = len(ids) // 4
            full = n // window
            out["n"].append(n)
            out["blocks"].append([zlib.crc32(ids[k * 4 * window:(k + 1) * 4 * window])
                                  for k in range(full)])
            out["full"].append(ranks.get(0, 0))
            ranks[0] = ranks.get(0, 0) + full
            steps = -(-(n % window) // GRID)
            out["steps"].append(steps)
            out["rank"].append(ranks.get(steps, 0) if steps else 0)
            if steps:
                ranks[steps] = ranks.get(steps, 0) + 1
            out["ids"].append(ids if with_ids else ids[full * 4 * window:])
        return out | {"doc_id": part["doc_id"], "part": [task] * part.num_rows}

    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    tails = cut_lineage(map_rows(
        read, tokenize, "doc_id long, part int, n long, blocks array<long>, full long, "
                        "ids binary, steps int, rank long", 1024), "tokens")
    counts = tails.groupBy("part", F.col("steps").alias("k")).agg(F.count("*").alias("n"))
    fulls = tails.groupBy("part").agg(F.sum(F.size("blocks")).alias("n"))
    counts = counts.where("k > 0").unionByName(fulls.withColumn("k", F.lit(0)))
    counts = cut_lineage(counts, "lengths")
    histogram = np.zeros(window // GRID + 1, np.int64)
    for r in counts.where("k > 0").groupBy("k").agg(F.sum("n").alias("n")).collect():
        histogram[r["k"]] = r["n"]  # bounded: a row per rounded length
    plan = make_plan(histogram, window)
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "before"))).alias("before"))
    placed = tails.join(cut_lineage(offsets, "offsets"), "part")
    placed = placed.withColumns({
        "full": F.col("full") + F.col("before")[F.lit(0)] + plan.sequences,
        "rank": F.col("rank") + F.coalesce(F.col("before")[F.col("steps")], F.lit(0))})

    def cut(part):
        out: dict[str, list] = {c: [] for c in PIECE}

        def add(doc_id, start, length, crc, n, sequence, slot, ids):
            for name, value in zip(PIECE, (doc_id, start, length, crc, n, sequence, slot, ids)):
                out[name].append(value)

        cells = (part[c].to_pylist() for c in ("doc_id", "n", "blocks", "full", "ids", "steps",
                                               "rank"))
        for doc_id, n, blocks, full, ids, steps, rank in zip(*cells):
            whole = len(blocks) * window
            base = 0 if with_ids else whole
            for k, crc in enumerate(blocks):
                own = ids[k * 4 * window:(k + 1) * 4 * window] if with_ids else None
                add(doc_id, k * window, window, crc, n, full + k, 0, own)
            if not steps:
                continue
            for at, length, sequence, slot in places(plan, window, n - whole, steps, rank):
                own = ids[4 * (whole + at - base):4 * (whole + at - base + length)]
                add(doc_id, whole + at, length, zlib.crc32(own), n, sequence, slot,
                    own if with_ids else None)
        return out

    pieces = map_rows(placed.select("doc_id", "n", "blocks", "full", "ids", "steps", "rank"), cut,
                      "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                      "sequence_id long, slot long, ids binary")
    order = Window.partitionBy("sequence_id").orderBy("slot")  # at most a window of rows
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    out = pieces.withColumn("offset", offset).drop("slot")
    return out if with_ids else out.drop("ids")


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", "ids")
_COUNTERS: dict[int, dict[int, int]] = {}
