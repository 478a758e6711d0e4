"""Toxicity by two Kneser-Ney models over expressions, one of toxic and one of ordinary texts.

An expression is a word after the word before it (or after the start of the text). A class model
gives it the share of the class's texts with that first word that hold it, less a discount; what
is discounted goes to the word level: the share of different words that the word was seen after in
the class, less a discount, and from there to backoff counts that the classes share: after how many
different words it was seen at all. An expression counts once per text and equal texts of a class
are one, so copies add nothing; an expression that was seen once or twice says little about a class.
A text's evidence is the difference of its length-normalised toxic and ordinary log-likelihoods over
all expressions, over the most toxic one and the three most toxic ones, and the same three on the word
level. A logistic curve fitted on labelled texts that the models have not seen turns it into a score.

At most ``most_per_class`` labelled texts of each class are used, those with the smallest hashes
of their ids. The curve sees each half of them as models of the other half do (equal texts are in one
half); the scores come from models of both. The models keep every word and expression of these texts:
words that they do not hold have the backoff's share, expressions that of their last word times what
their first word leaves. All texts are scored whole. Words are runs of ASCII letters (in lower
case), digits and all other characters beyond ASCII; labels, language and source are no input.

Defined results: a null text is an empty one; a text without words gets the score of no evidence
at all; null labels teach nothing, and neither do those of an id that is labelled both ways; without labels of both classes every score is 0; repeated
rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import map_rows, slices
from uqframe.sources.session import cut_lineage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
DISCOUNT = 0.75


@dataclass(frozen=True)
class Settings:
    most_per_class: int = 10_000
    skip_modulus: int = 5  # labels of ids whose crc32 has no remainder here are never read


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def tokens(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


#: Models are fitted on the first half, the second and both.
HALVES = ("0", "1", "01")
CLASSES = ("toxic", "plain")
COUNTS = ("plain0", "plain1", "toxic0", "toxic1")
#: Expressions that a task counts together, about.
COUNTED = 1_000_000
#: Of an expression's key, what holds its last word.
LAST = 0xFFFFFFFF


def pair_counts(half: str, kind: str):
    """Texts of a class, in one or both halves, with an expression."""
    return sum((F.col(kind + h) for h in half[1:]), F.col(kind + half[0]))


class Vocabulary(dict):
    """Word -> row. Words hold no line breaks; pickled compressed, since every task gets a copy."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))

    def __reduce__(self):
        return unpacked_vocabulary, (zstandard.compress(b"\n".join(self)), len(self))


def unpacked_vocabulary(data: bytes, n: int) -> Vocabulary:
    return Vocabulary(zstandard.decompress(data).split(b"\n") if n else [])


def packed(x: np.ndarray) -> tuple:
    return zstandard.compress(np.ascontiguousarray(x.T).tobytes()), x.dtype, x.T.shape


def unpacked(data: bytes, kind: np.dtype, shape: tuple) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), kind).reshape(shape).T)


def expression_keys(place: dict[bytes, int], ws: list[bytes]) -> np.ndarray:
    """Rows of words and, above them, of the words before them. Words without a row have the next
    one, the start of a text the one after it."""
    other = len(place)
    w = np.fromiter(map(place.get, ws, repeat(other)), np.int64, len(ws))
    return (np.append(other + 1, w[:-1]) << 32) | w


class Expressions:
    """Expressions by key with the texts that hold them, in columns as in ``COUNTS``. ``parts`` are
    compressed stretches in the order of keys (steps from key to key, counts), which are unpacked
    where something is looked up."""

    def __init__(self, parts: list[tuple[tuple, tuple]]):
        self.parts = parts

    def __reduce__(self):
        return Expressions, (self.parts,)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        keys = [np.cumsum(unpacked(*part[0])) for part in self.parts]
        counts = [unpacked(*part[1]) for part in self.parts]
        # behind all a row for keys that are looked up there
        return (np.concatenate([*keys, np.array([2**63 - 1])]),
                np.concatenate([*counts, np.zeros((1, len(COUNTS)), np.uint8)]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and the counts of these."""
        known, counts = self.tables
        at = np.searchsorted(known, keys)
        held = np.flatnonzero(known[at] == keys)
        return held, counts[at[held]].astype(float)


class Model:
    """Log-likelihood ratios of words and expressions. ``words`` has a row per word with the number
    of different words before it in toxic, in ordinary and in all texts. ``firsts`` has per first
    word of expressions, the start being the last, the sums of their toxic and ordinary counts, and
    how many different ones there are of each. Words are known by their row in ``place``; models of
    one fit share it and the ``expressions``, of which ``half`` says what counts."""

    def __init__(self, place: Vocabulary, expressions: Expressions, half: str, words: tuple, firsts: tuple):
        self.place, self.expressions, self.half, self.words, self.firsts = place, expressions, half, words, firsts
        self.columns = [[COUNTS.index(kind + h) for h in half] for kind in CLASSES]

    def __reduce__(self):
        return Model, (self.place, self.expressions, self.half, self.words, self.firsts)

    @cached_property
    def tables(self) -> tuple[list, list, list]:
        """Per class: shares of words, the last being that of any other word; what a first word
        leaves to them; its sum."""
        words, firsts = unpacked(*self.words), unpacked(*self.firsts)
        n, totals = (words[:, 2] > 0).sum(), words.sum(axis=0, dtype=np.int64)
        shared = np.append(words[:, 2].astype(float), 0.0)
        shared = (shared + 1) / (totals[2] + n + 1)
        share, left, seen = [], [], []
        for c in (0, 1):
            kept = np.maximum(words[:, c] - DISCOUNT, 0) / max(1, totals[c])
            share.append(np.append(kept, 0.0) + (1 - kept.sum()) * shared)
            seen.append(np.maximum(1, firsts[:, c]))
            left.append(np.where(firsts[:, c] > 0, DISCOUNT * firsts[:, 2 + c] / seen[c], 1.0))
        return share, left, seen

    @cached_property
    def plain_ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of words alone, and of what first words leave."""
        share, left, _ = self.tables
        return np.log(share[0]) - np.log(share[1]), np.log(left[0]) - np.log(left[1])

    def ratios(self, ws: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        return self.key_ratios(expression_keys(self.place, ws))[1]

    def expression_ratios(self, ws: list[bytes]) -> np.ndarray:
        """The same of each word after the word before it."""
        return self.key_ratios(expression_keys(self.place, ws))[0]

    def key_ratios(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of expressions and of their last words."""
        v, w = key >> 32, key & LAST
        alone, without = self.plain_ratios
        words = alone[w]
        out = without[v] + words
        held, counts = self.expressions.find(key)
        v, w, logs = v[held], w[held], []
        for columns, share, left, seen in zip(self.columns, *self.tables):
            kept = np.maximum(counts[:, columns].sum(axis=1) - DISCOUNT, 0)
            logs.append(np.log(kept / seen[v] + left[v] * share[w]))
        out[held] = logs[0] - logs[1]
        return out, words


EVIDENCE = ("expressions", "expression", "three_expressions", "words", "word", "three_words")
#: Words that are looked up together, about.
LOOKED_UP = 100_000


def evidence(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Per text, of its expressions and of its words: the mean ratio, the largest, and the mean of
    the three largest."""
    out = np.zeros((len(texts), len(EVIDENCE)))

    def look_up(rows: list[int], keys: list[np.ndarray]) -> None:
        ends = np.cumsum([len(k) for k in keys])[:-1]
        for at, ratios in zip((0, 3), model.key_ratios(np.concatenate(keys))):
            for i, r in zip(rows, np.split(ratios, ends)):
                top = np.partition(r, len(r) - min(3, len(r)))[-3:]
                out[i, at:at + 3] = r.mean(), top.max(), top.mean()

    rows, keys, size = [], [], 0
    for i, text in enumerate(texts):
        if ws := tokens(text):
            rows.append(i)
            keys.append(expression_keys(model.place, ws))
            size += len(ws)
            if size > LOOKED_UP:
                look_up(rows, keys)
                rows, keys, size = [], [], 0
    if rows:
        look_up(rows, keys)
    return out


class Curve:
    """Logistic regression on standardised evidence, by Newton steps with a little ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._wide(x)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        self.beta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (weight * (y - p)) - self.beta
            bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(z.shape[1])
            self.beta += np.linalg.solve(bend, slope)
        # The threshold at which most of the fitted texts are told right becomes 0.5.
        raw = z @ self.beta
        cuts = np.unique(np.concatenate([[0.0], np.quantile(raw, np.linspace(0.01, 0.99, 197))]))
        right = [((raw >= c) == (y == 1)).mean() for c in cuts]
        self.beta[0] -= float(cuts[int(np.argmax(right))])

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._wide(x) @ self.beta, -500, 500)))


def _counts(rows: DataFrame) -> list[Model]:
    """Class models of the rows (text, toxic, half) of the first half, the second, and both."""
    def distinct(batches):
        found = set()
        for part in slices(batches):
            for text in part["text"].to_pylist():
                found.update(tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["w"])

    listed = rows.select("text").mapInArrow(distinct, "w binary").distinct().toArrow()  # of most_per_class texts
    place = Vocabulary(listed["w"].to_pylist())
    del listed
    n = len(place)

    def count(batches):
        def out(keys, slots):
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            slot = np.repeat(slots, [len(k) for k in keys])
            columns = np.bincount(at * 4 + slot, minlength=4 * len(found)).reshape(-1, 4).astype(np.int32).T
            return pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, columns)], names=["key", *COUNTS])

        keys, slots, size = [], [], 0
        for part in slices(batches):
            for text, toxic, half in zip(*(part[c].to_pylist() for c in ("text", "toxic", "half"))):
                if ws := tokens(text):
                    keys.append(np.unique(expression_keys(place, ws)))  # once per text
                    slots.append(2 * toxic + half)
                    size += len(keys[-1])
            if size > COUNTED:
                yield out(keys, slots)
                keys, slots, size = [], [], 0
        if keys:
            yield out(keys, slots)

    pairs = rows.mapInArrow(count, "key long, " + ", ".join(f"{c} int" for c in COUNTS))
    pairs = cut_lineage(pairs.groupBy("key").agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS]), "pairs")

    def summed(place_of, sums: list, rows: int) -> dict[str, tuple]:
        """Sums over the expressions of a word, per half: a row per word."""
        got = pairs.groupBy(place_of.cast("int").alias("at")).agg(
            *[f(h).cast("int").alias(f"{i}_{h}") for h in HALVES for i, f in enumerate(sums)]).toArrow()
        at, out = got["at"].to_numpy(), {}
        for h in HALVES:
            table = np.zeros((rows, len(sums)), np.int32)
            for i in range(len(sums)):
                table[at, i] = got[f"{i}_{h}"].to_numpy()
            out[h] = packed(table)
        return out

    toxic, plain = (lambda half, kind=kind: pair_counts(half, kind) for kind in CLASSES)
    words = summed(F.col("key").bitwiseAND(F.lit(LAST)),
                   [lambda h: F.count_if(toxic(h) > 0), lambda h: F.count_if(plain(h) > 0),
                    lambda h: F.count_if(toxic(h) + plain(h) > 0)], n)
    firsts = summed(F.shiftright("key", 32),
                    [lambda h: F.sum(toxic(h)), lambda h: F.sum(plain(h)),
                     lambda h: F.count_if(toxic(h) > 0), lambda h: F.count_if(plain(h) > 0)], n + 2)

    def pack(batches):
        for part in batches:
            if part.num_rows:
                keys, counts = part["key"].to_numpy(), np.column_stack([part[c].to_numpy() for c in COUNTS])
                counts = counts.astype(np.min_scalar_type(counts.max()))
                yield pa.RecordBatch.from_pydict({"key": keys[:1], "part": [
                    pickle.dumps((packed(np.diff(keys, prepend=0)), packed(counts)))]})

    parts = pairs.orderBy("key").mapInArrow(pack, "key long, part binary").collect()  # some 4 bytes an expression
    expressions = Expressions([pickle.loads(r["part"]) for r in sorted(parts, key=lambda r: r["key"])])
    return [Model(place, expressions, h, words[h], firsts[h]) for h in HALVES]


def fit(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[Model, Curve] | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                        & ~held_out(s.skip_modulus, 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.where(F.col("toxic") == F.col("_most")).drop("_most")
    mixed = F.xxhash64("doc_id")
    listed = [known.where(F.col("toxic") == c).orderBy(mixed, "doc_id").limit(s.most_per_class)
              for c in (0, 1)]
    listed = cut_lineage(listed[0].union(listed[1]), "labelled")  # bounded by the setting
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("binary").alias("text"))
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).cast("int")
    texts = texts.join(F.broadcast(listed), "doc_id").withColumn("half", half)
    texts = cut_lineage(texts.select("text", "toxic", "half").distinct(), "labelled_texts")
    first, second, both = _counts(texts)

    def per_slice(part):
        halves, texts = part["half"].to_numpy(), part["text"].to_pylist()
        x = np.zeros((len(texts), len(EVIDENCE)))
        for half, other in ((1, first), (0, second)):
            rows = np.flatnonzero(halves == half)
            x[rows] = evidence(other, [texts[i] for i in rows])
        return {**dict(zip(EVIDENCE, x.T)), "toxic": part["toxic"]}

    seen = map_rows(texts, per_slice, ", ".join(f"{c} double" for c in EVIDENCE) + ", toxic int")
    seen = seen.toArrow()  # bounded: seven numbers per labelled text
    y = seen["toxic"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    return both, Curve(np.column_stack([seen[c].to_numpy() for c in EVIDENCE]), y)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    s = settings
    fitted = fit(docs, labels, s)

    def per_slice(part):
        if fitted is None:
            values = np.zeros(part.num_rows)
        else:
            values = fitted[1](evidence(fitted[0], part["text"].to_pylist()))
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": values,
                "predicted": (values >= 0.5).astype(np.int32)}

    read = docs.select("doc_id", held_out(s.skip_modulus, 0).alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    return map_rows(read, per_slice, "doc_id long, held_out boolean, score double, predicted int")
