"""Quality rules: lines that too many documents of a host share are removed, documents that
lose most of their words with them are rejected, and so are documents that fail base rules.

A line is normalised (trimmed, lower case, runs of blanks as one, digits as 0) and hashed to 64
bits. Its frequency on a host is the number of *different* texts there that hold it, so exact
copies of a page do not make its lines common. A line is above the limits when at least
``min_docs`` different texts of the host hold it and these are more than ``max_share`` of the
host's different texts. Such a line is removed everywhere but in the host's document with the
smallest id that holds it, so that one document of a family of near copies stays whole. A
document is depleted when more than ``max_lost`` of its words are removed.

Defined results: a null text is an empty one; null hosts form one host; a null ``doc_id`` is
never the document that keeps a line; repeated rows get a row each; lines without a word are
never counted or removed; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from uqframe.llm.common import hash64, map_rows, words
from uqframe.operators.skew import fits
from uqframe.sources.session import cut_lineage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
DIGITS = re.compile(rb"[0-9]")


@dataclass(frozen=True)
class Limits:
    min_docs: int = 20
    max_share: float = 0.05
    max_lost: float = 0.5
    min_words: int = 50
    max_repeated: int = 50  # percent of the words
    most_listed: int = 100_000  # lines above the limits that are broadcast; more are joined


def line_hashes(text: bytes) -> list[tuple[int, int]]:
    """(signed 64-bit hash, number of words) of each line; the hash of a line without words is
    never used."""
    out = []
    for line in text.lower().split(b"\n"):
        ws = line.split()
        h = hash64(DIGITS.sub(b"0", b" ".join(ws)))
        out.append((h - (1 << 64) if h >> 63 else h, len(ws)))
    return out


def common_lines(docs: DataFrame, limits: Limits, host: str) -> DataFrame:
    """Lines above the limits: (host, line, first_id)."""
    def per_slice(part):
        texts = [t or b"" for t in part["text"].to_pylist()]
        return {"host": part["host"], "doc_id": part["doc_id"],
                "text_key": np.array([hash64(t) for t in texts], np.uint64).view(np.int64),
                "lines": [list({h for h, n in line_hashes(t) if n}) for t in texts]}

    read = docs.select(F.col(host).cast("string").alias("host"), "doc_id",
                       F.col("text").cast("binary").alias("text"))
    lines = map_rows(read, per_slice, "host string, doc_id long, text_key long, lines array<long>")
    # Two steps, both summed before the shuffle: a line in a third of all rows stays cheap.
    by_text = (lines.select("host", "text_key", "doc_id", F.explode("lines").alias("line"))
               .groupBy("host", "line", "text_key").agg(F.min("doc_id").alias("first_id")))
    by_line = (by_text.groupBy("host", "line")
               .agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"))
               .where(F.col("n") >= limits.min_docs))
    totals = (read.select("host", F.xxhash64(F.coalesce("text", F.lit(b""))).alias("k")).distinct()
              .groupBy("host").agg(F.count("*").alias("texts")).withColumnRenamed("host", "_host"))
    found = by_line.join(totals, by_line["host"].eqNullSafe(totals["_host"]))
    above = found.where(F.col("n") > limits.max_share * F.col("texts"))
    return cut_lineage(above.select("host", "line", "first_id"), "lines")


def base_rules(text: bytes, limits: Limits) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether they fail."""
    ws = words(text)
    n = len(ws)
    plain = text.decode("utf-8", "replace")
    chars = len(plain) - sum(map(plain.count, BLANKS)) if n else 0
    symbols = sum(map(plain.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    triples = list(zip(ws, ws[1:], ws[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen: dict = {}
        hit = np.zeros(n + 3, bool)
        for i, t in enumerate(triples):
            first = seen.setdefault(t, i)
            if first != i:
                hit[first:first + 3] = True
                hit[i:i + 3] = True
        repeated = int(hit.sum())
    failed = n < limits.min_words or 100 * repeated > limits.max_repeated * n
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source",
          carry: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: the base figures, ``base_failed``, ``n_lost`` (words of removed
    lines), ``kept``, ``clean_text``, the text without the removed lines, and ``row``, a struct
    of the columns named by ``carry``."""
    common = common_lines(docs, limits, host)
    row = F.struct(*carry) if carry else F.struct(F.lit(True).alias("_"))
    read = docs.select(F.col(host).cast("string").alias("host"), "doc_id",
                       F.col("text").cast("binary").alias("text"), row.alias("row"))
    listed = None
    if fits(common, limits.most_listed):  # bounded: at most ``most_listed`` rows
        listed = {(r.host, r.line): r.first_id for r in common.collect()}
        read = read.withColumn("cut", F.lit(None).cast("array<long>"))
    else:
        read = _with_cuts(read, common)

    def per_slice(part):
        out: dict[str, list] = {c: [] for c in NAMES}
        cells = (part[c].to_pylist() for c in ("host", "doc_id", "text", "cut"))
        for source, doc_id, text, cut in zip(*cells):
            text = text or b""
            figures = base_rules(text, limits)
            hashed = line_hashes(text)
            if listed is None:
                drop = set(cut or ())
            else:
                drop = {h for h, k in hashed if k and (source, h) in listed
                        and listed[source, h] != doc_id}
            lost = sum(k for h, k in hashed if k and h in drop) if drop else 0
            if lost:
                kept_lines = zip(text.split(b"\n"), hashed)
                text = b"\n".join(x for x, (h, k) in kept_lines if not k or h not in drop)
            kept = not figures[-1] and lost <= limits.max_lost * figures[0]
            values = (doc_id, *figures, lost, kept, text.decode("utf-8", "replace"))
            for name, value in zip(NAMES, values):
                out[name].append(value)
        return out | {"row": part["row"]}

    schema = StructType.fromDDL(SCHEMA).add("row", read.schema["row"].dataType)
    return map_rows(read, per_slice, schema)


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, n_lost long, kept boolean, "
          "clean_text string")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _with_cuts(read: DataFrame, common: DataFrame) -> DataFrame:
    """The way for more common lines than fit a broadcast: lines are joined, and each text
    gets the hashes of its lines to remove."""
    keyed = read.withColumn("key", F.xxhash64("host", "doc_id", "text"))
    bare = keyed.select("host", "doc_id", "key", "text")

    def per_slice(part):
        texts = [t or b"" for t in part["text"].to_pylist()]
        return {"host": part["host"], "doc_id": part["doc_id"], "key": part["key"],
                "lines": [list({h for h, n in line_hashes(t) if n}) for t in texts]}

    lines = map_rows(bare, per_slice, "host string, doc_id long, key long, lines array<long>")
    lines = lines.select("host", "doc_id", "key", F.explode("lines").alias("line"))
    c = common.withColumnsRenamed({"host": "_host", "line": "_line"})
    hit = lines.join(c, lines["host"].eqNullSafe(c["_host"]) & (lines["line"] == c["_line"]))
    hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    cuts = hit.groupBy("key").agg(F.collect_set("line").alias("cut"))
    return keyed.join(cuts, "key", "left").drop("key")


def apply_rules(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The documents that stay, with all their columns, without the removed lines; ``n_chars``
    follows the text. A repeated row stays as often as it occurs."""
    carry = [c for c in docs.columns if c != "text"]
    stay = judge(docs, limits, host, carry).where("kept")
    cols = {c: F.col("row").getField(c) for c in carry}
    cols["text"] = F.col("clean_text")
    if "n_chars" in cols:
        cols["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return stay.select(*[cols[c].alias(c) for c in docs.columns])
