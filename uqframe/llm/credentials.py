"""Secret scans with formats learned by grammar inference.

Fixed patterns find three kinds of credentials. Their values are labelled examples: for each
kind a prefix tree of character classes is built, and its states are merged where a Hoeffding
test finds their frequencies compatible, which leaves a probabilistic automaton of the kind's
format. All other long runs of credential characters are candidates. A candidate's score is its
log-likelihood per symbol under the best automaton less that under a model of ordinary runs
(pairs of classes); those that score at least like all but ``tail`` of the labelled examples,
and at least ``margin``, are added as spans of the kind ``learned``. Base spans always stay.

The automata are fitted on at most ``most_examples`` different values per kind and four times as
many candidates, those with the smallest hashes, none longer than ``longest_example``; all
candidates of all texts are scored whole.

Defined results: a null text is an empty one; repeated rows get a row each; without any example
nothing is added; extra columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from uqframe.llm.common import map_rows
from uqframe.sources.session import cut_lineage

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Candidates are at least as long as the shortest labelled values.
SHORTEST = min(LEAST.values())
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")


@dataclass(frozen=True)
class Settings:
    most_examples: int = 2000
    longest_example: int = 200
    alpha: float = 0.05
    tail: float = 0.05
    margin: float = 0.5
    floor: float = 1e-4  # probability of a symbol that a state never emitted


def symbol(c: str) -> str:
    """Class of a character: digits, hexadecimal and other letters of each case; signs stay."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "z"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "Z"
    return c


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, kind after kind. A run of at least 16
    hexadecimal digits is the same with or without the shorter runs."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text)
           if len(m[2]) >= LEAST["assign"]]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)
            if len(m[0]) >= LEAST["access"]]
    return out + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, str]]:
    """Runs of credential characters that touch no base span, without signs at their ends."""
    out = []
    taken = sorted((s, e) for _, s, e, _ in base)
    k = 0
    for m in CANDIDATE.finditer(text):
        run = m[0].rstrip(".=-/_+")
        value = run.lstrip(".=-/_+")
        start, end = m.start() + len(run) - len(value), m.start() + len(run)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        near = k
        while near < len(taken) and taken[near][0] < end and taken[near][1] <= start:
            near += 1
        free = near == len(taken) or taken[near][0] >= end
        if len(value) >= SHORTEST and free:
            out.append((start, end, value))
    return out


class Automaton:
    """A probabilistic automaton: how often each state was left by each symbol, or ended."""

    def __init__(self, examples: list[str], alpha: float):
        self.next: list[dict[str, int]] = [{}]
        self.uses: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for example in sorted(examples):
            state = 0
            for c in map(symbol, example):
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.uses.append(Counter())
                    self.ends.append(0)
                self.uses[state][c] += 1
                state = self.next[state][c]
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def total(self, state: int) -> int:
        return self.ends[state] + self.uses[state].total()

    def _compatible(self, red: int, blue: int) -> bool:
        """No frequency of the states, or of the states that both lead to, differs clearly."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in self.uses[a].keys() | self.uses[b].keys():
                if abs(self.uses[a][c] / n - self.uses[b][c] / m) > most:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red`` and what it leads to."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.uses[b].items():
                self.uses[a][c] += n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        reds = [0]
        while True:
            known = set(reds)
            blues = [(self.total(t), r, c, t) for r in reds for c, t in self.next[r].items()
                     if t not in known]
            if not blues:
                break
            _, parent, c, blue = max(blues, key=lambda x: (x[0], -x[1], x[2]))
            for red in reds:
                if self._compatible(red, blue):
                    self.next[parent][c] = red
                    self._fold(red, blue)
                    break
            else:
                reds.append(blue)
        self.reds = reds

    def score(self, text: str, floor: float) -> float:
        """Log-likelihood per symbol, the end counted as one. After a symbol that a state never
        emitted the automaton starts again."""
        state, out = 0, 0.0
        for c in map(symbol, text):
            n = self.uses[state][c] if c in self.next[state] else 0
            p = max(floor, n / max(1, self.total(state)))
            out += math.log(p)
            state = self.next[state][c] if n else 0
        out += math.log(max(floor, self.ends[state] / max(1, self.total(state))))
        return out / (len(text) + 1)


def class_pairs(runs: list[str]) -> Counter:
    """How often each class of character follows another one, ends included."""
    out: Counter = Counter()
    for text in runs:
        chain = ["^", *map(symbol, text), "$"]
        out.update(zip(chain, chain[1:]))
    return out


class Formats:
    """The automata of all kinds, the ordinary model from the pairs of classes of all runs, and
    the score that a span needs."""

    def __init__(self, examples: dict[str, list[str]], ordinary: Counter, s: Settings):
        self.s = s
        self.automata = {k: Automaton(v, s.alpha) for k, v in sorted(examples.items()) if v}
        self.pairs, self.firsts = ordinary, Counter()
        for (a, _), n in ordinary.items():
            self.firsts[a] += n
        own = sorted(self.score(v) for values in examples.values() for v in values)
        self.least = max(s.margin, own[int(s.tail * len(own))]) if own else math.inf
        self.seen: dict[str, bool] = {}

    def ordinary(self, text: str) -> float:
        chain = ["^", *map(symbol, text), "$"]
        logs = [math.log((self.pairs[a, b] + 0.5) / (self.firsts[a] + 0.5 * 16))
                for a, b in zip(chain, chain[1:])]
        return sum(logs) / len(logs)

    def score(self, text: str) -> float:
        if not self.automata:
            return -math.inf
        best = max(a.score(text, self.s.floor) for a in self.automata.values())
        return best - self.ordinary(text)

    def secret(self, text: str) -> bool:
        if text not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[text] = self.score(text) >= self.least
        return self.seen[text]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


FOUND = ("doc_id long, kinds array<string>, starts array<long>, ends array<long>, "
         "labelled array<string>, c_starts array<long>, c_ends array<long>, runs array<string>")


def _find(docs: DataFrame) -> DataFrame:
    def per_slice(part):
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        out["doc_id"] = part["doc_id"]
        for raw in part["text"].to_pylist():
            text = (raw or b"").decode("utf-8", "replace")
            base = base_spans(text)
            runs = candidates(text, base)
            for name, k in (("kinds", 0), ("starts", 1), ("ends", 2), ("labelled", 3)):
                out[name].append([b[k] for b in base])
            for name, k in (("c_starts", 0), ("c_ends", 1), ("runs", 2)):
                out[name].append([r[k] for r in runs])
        return out

    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(read, per_slice, FOUND)


def _smallest(values: DataFrame, n: int, s: Settings) -> list[str]:
    """At most ``n`` different values, those with the smallest hashes."""
    short = values.where(F.length("v") <= s.longest_example).distinct()
    return [r["v"] for r in short.orderBy(F.xxhash64("v"), "v").limit(n).collect()]


def learn(found: DataFrame, s: Settings) -> Formats:
    pairs = found.select(F.explode(F.arrays_zip("kinds", "labelled")).alias("p"))
    examples = {k: _smallest(pairs.where(F.col("p.kinds") == k).select(
        F.col("p.labelled").alias("v")), s.most_examples, s) for k in KINDS[:3]}
    def per_slice(part):
        n = class_pairs([v for runs in part["runs"].to_pylist() for v in runs])
        return {"a": [k[0] for k in n], "b": [k[1] for k in n], "n": list(n.values())}

    pairs = map_rows(found.select("runs"), per_slice, "a string, b string, n long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # pairs of a dozen classes
    return Formats(examples, Counter({(r["a"], r["b"]): r["n"] for r in pairs}), s)


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans (as
    text) and ``found``, the spans as an array of (kind, start, end)."""
    found = cut_lineage(_find(docs), "credentials")
    formats = learn(found, settings)

    def per_slice(part):
        out: dict[str, list] = {c.split()[0]: [] for c in SCAN}
        out["doc_id"] = part["doc_id"]
        for kinds, starts, ends, c_starts, c_ends, runs in zip(*(part[c].to_pylist() for c in (
                "kinds", "starts", "ends", "c_starts", "c_ends", "runs"))):
            base = list(zip(kinds, starts, ends))
            added = [("learned", a, b) for a, b, v in zip(c_starts, c_ends, runs)
                     if formats.secret(v)]
            for k in KINDS[:3]:
                out["n_" + k].append(kinds.count(k))
            out["n_learned"].append(len(added))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(base + added))
            out["found"].append([{"kind": k, "start": a, "end": b} for k, a, b in base + added])
        return out

    return map_rows(found, per_slice, ", ".join(SCAN))


SCAN = ("doc_id long", "n_assign long", "n_access long", "n_hex long", "n_learned long",
        "base_sha256 string", "spans string",
        "found array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, settings: Settings = Settings(), mark: str = "[SECRET]") -> DataFrame:
    """All documents with all their columns; each secret, and each stretch of overlapping ones,
    is replaced by ``mark``; ``n_chars`` follows the text. Null texts stay null."""
    found = cut_lineage(_find(docs), "credentials")
    formats = learn(found, settings)
    carry = [c for c in docs.columns if c != "text"]

    def per_slice(part):
        texts = []
        for raw in part["text"].to_pylist():
            if raw is None:
                texts.append(None)
                continue
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            spans = [(a, b) for _, a, b, _ in base]
            spans += [(a, b) for a, b, v in candidates(text, base) if formats.secret(v)]
            out, at = [], 0
            for a, b in sorted(spans):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            texts.append("".join(out) + text[at:])
        return {"text": texts, "row": part["row"]}

    row = F.struct(*carry)
    read = docs.select(F.col("text").cast("binary").alias("text"), row.alias("row"))
    schema = StructType.fromDDL("text string").add("row", read.schema["row"].dataType)
    done = map_rows(read, per_slice, schema)
    cols = {c: F.col("row").getField(c) for c in carry} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[cols[c].alias(c) for c in docs.columns])
