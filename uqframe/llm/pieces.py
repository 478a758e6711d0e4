"""Byte-pair encoding of sentence pieces by a table of prefixes.

Of every prefix of a segment exactly one token can come last: the token ``t`` that ends there
and is compatible with the last token of the prefix before it. Two tokens are compatible when
merging their characters together gives back just these two. An automaton over all pieces lists
the tokens that end at each position, the table keeps the one that fits, and the ids are read
from its end backwards.

Texts are cut into units (spaces with a word or with signs, line ends) and units into segments at pairs of characters that no piece holds side by side; tokens never
cross such a pair. Where a piece of the vocabulary crosses the ends of units, texts stay whole.
Units are remembered in a dictionary of bounded size.

Defined results: a null text is an empty one and has no tokens; characters that no piece holds
become one token per byte; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import map_rows

SPACE = "▁"
#: Spaces with a Latin word before an ASCII sign or blank; spaces with ASCII signs before an
#: ASCII character; all else up to a space or line end; line ends; spaces.
UNITS = re.compile(rb" *(?:[0-9A-Za-z]|\xc3[\x80-\xbf])++(?![\x80-\xff])"
                   rb"| *[!-/:-@[-`{-~]++(?![\x80-\xff\x00-\x1f\x7f])| *[^ \n]+|\n+| +")
WHOLE = re.compile(rb"(?s).+")
MOST_UNITS, MOST_PAIRS, LONGEST_KEPT = 600_000, 500_000, 40
START = -1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the ids of the 256 byte pieces and of the unknown piece."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown_id: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, by_byte, unknown = {}, {}, 0
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                by_byte[int(model.id_to_piece(i)[3:5], 16)] = i
            elif model.is_unknown(i):
                unknown = i
            elif not model.is_control(i) and not model.is_unused(i):
                pieces[model.id_to_piece(i)] = (i, model.get_score(i))
        return Vocabulary(pieces, tuple(by_byte[b] for b in range(256)), unknown)


class Encoder:
    """Encodes and decodes with a vocabulary; keeps what it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        self.byte_ids = vocabulary.byte_ids
        self.text_of = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.joined = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece, (i, _) in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.units = WHOLE if any(self._crosses(p) for p in self.joined) else UNITS
        self.pairs: dict[tuple[int, int], bool] = {}
        self.seen: dict[bytes, bytes] = {}
        self.changed: dict[bytes, bytes] = {}

    @staticmethod
    def _crosses(pair: str) -> bool:
        """Whether an end of a unit can lie inside a pair: one that some piece holds means that
        texts stay whole."""
        a, b = pair
        word = a.isascii() and a.isalnum() or "\u00c0" <= a <= "\u00ff"
        if b == SPACE or "\n" in pair:
            return a != b
        if a == SPACE or not b.isascii():
            return False
        return word and not b.isalnum() or "!" <= a <= "~" and not word and b.isalnum()

    def merge(self, text: str) -> list[str]:
        """Plain merging of neighbours, best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                found = self.pieces.get(parts[k] + parts[k + 1])
                if found and (best is None or found[1] > best[0]):
                    best = found[1], k
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` stays a token of its own after ``left`` (or at the start)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            want = [self.text_of[i] for i in (left, right) if i != START]
            known = self.pairs[left, right] = self.merge("".join(want)) == want
        return known

    def segment_ids(self, segment: str) -> list[int]:
        """The ids of a segment, from the table of its prefixes."""
        n = len(segment)
        last, length = [START] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, size) in self.automaton.iter(segment):
            end += 1
            if last[end] != START:
                continue
            left = last[end - size]
            if left == START and end != size:
                continue
            fits = pairs.get((left, token))
            if fits is None:
                fits = compatible(left, token)
            if fits:
                last[end], length[end] = token, size
        out, at = [], n
        while at:
            if last[at] == START:  # a character that is no piece stands alone in its segment
                return [self.byte_ids[b] for b in segment.encode()]
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> list[int]:
        joined, out, start = self.joined, [], 0
        for k, (a, b) in enumerate(zip(unit, unit[1:]), 1):
            if a + b not in joined:
                out += self.segment_ids(unit[start:k])
                start = k
        return out + self.segment_ids(unit[start:])

    def bytes_of(self, ids: list[int]) -> bytes:
        """Text of ids, with a space for each space sign."""
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of
                        else self.text_of[i].replace(SPACE, " ").encode() for i in ids)

    def unit(self, unit: bytes) -> bytes:
        """The ids of a unit in decimals joined by commas. Where decoding them does not give
        the unit back, ``changed`` has what it gives."""
        known = self.seen.get(unit)
        if known is None:
            ids = self.unit_ids(unit.decode("utf-8", "replace").replace(" ", SPACE))
            known = ",".join(map(str, ids)).encode()
            if (text := self.bytes_of(ids)) != unit:
                self.changed[unit] = text
            elif len(unit) <= LONGEST_KEPT:
                if len(self.seen) >= MOST_UNITS:
                    self.seen.clear()
                self.seen[unit] = known
        return known

    def decoded(self, units: list[bytes]) -> bytes:
        """The text of units that were encoded, without the space before it."""
        if self.changed:
            units = [self.changed.get(u, u) for u in units]
            self.changed.clear()
        return b"".join(units)[1:]

    def cut(self, text: bytes) -> list[bytes]:
        """Units of a text after the space that stands before every text."""
        return self.units.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else []

    def encode(self, text: str) -> list[int]:
        units = self.cut(text.encode("utf-8", "replace"))
        return [int(i) for u in units for i in self.unit(u).split(b",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space before it."""
        text = self.bytes_of(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    """One encoder per process and vocabulary; later tasks find its dictionaries filled."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, null without ``with_ids``), ids_text_sha256 and
    decoded_sha256 of every whole text. ``model`` is a sentencepiece file with byte pieces."""
    vocabulary = Vocabulary.load(model)

    def per_slice(part):
        tool = encoder(model, vocabulary)
        get, make = tool.seen.get, tool.unit
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "ids", "a", "b")}
        out["doc_id"] = part["doc_id"]
        for text in part["text"].to_pylist():
            units = tool.cut(text or b"")
            ids = b",".join([get(u) or make(u) for u in units])
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids"].append([int(i) for i in ids.split(b",") if i] if with_ids else None)
            out["a"].append(hashlib.sha256(ids).hexdigest())
            out["b"].append(hashlib.sha256(tool.decoded(units)).hexdigest())
        names = {"a": "ids_sha256", "b": "decoded_sha256"}
        return {names.get(c, c): v for c, v in out.items()}

    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(read, per_slice, "doc_id long, n_tokens long, ids array<int>, "
                                     "ids_sha256 string, decoded_sha256 string")
