import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.data import documents, frame
from uqframe.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_every_id_once(spark):
    tool = Tokenizer.from_file(FILE)
    rows = [r for r in documents() if r[0] is not None][:-1]
    rows += [(900, "x <|endoftext|> Y it's <|ENDOFTEXT|>", None, None, None, None)]
    ids = {r[0]: np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    got = packing.pack(frame(spark, rows), FILE, window=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length and r.ids == own.tobytes() and r.ids_crc32 == zlib.crc32(own.tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, size in [(p, len(ids[k])) for k, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size else at <= 256
    assert by_doc.keys() == ids.keys()
    assert sum(map(len, ids.values())) / 256 / len(by_sequence) > 0.9


ODD = ["×", "÷", "×(", "3×,", "2×-3", "÷.", "×=", "\u00a0", "\u2003", "\u0085", "\u2028", "\x1c", "\x00", "\u0301", "\u0327",
       "e\u0301", "'s", "'", "it's", "ß", "İ", "Ω", "日本", "ａ", "½", "²", "🙂", "\t", "\n", "\r\n", "  ", "--", "()", "12", "a1"]


def test_random_strings_equal_the_library():
    """Signs, letters and marks from U+0020 to U+024F, blanks of all kinds."""
    tool = Tokenizer.from_file(FILE)
    r = random.Random(8)
    texts = list(ODD)
    for _ in range(10_000):
        size = r.randrange(1, 14)
        texts.append("".join(r.choice(ODD) if r.random() < 0.3 else chr(r.randrange(0x20, 0x250 if r.random() < 0.5 else 0x7f))
                             for _ in range(size)))
    texts += ["<|endoftext|>", "x<|startoftext|>y", "", " "]
    mine = packing.Tokens(open(FILE).read())
    assert mine.by_words
    data = pa.array([t.encode() for t in texts], pa.binary())
    want = [f.ids for f in tool.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [(t, w, list(g)) for t, w, g in zip(texts, want, mine.encode(data)) if list(g) != w]
    assert not wrong, wrong[:5]


def test_other_files_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, tool = packing.Tokens(open(path).read()), Tokenizer.from_file(path)
    assert not mine.by_words
    texts = ["Hello  World's", "", "a\n\n b×(c)", " x"]
    got = mine.encode(pa.array([t.encode() for t in texts] + [None], pa.binary()))
    assert [list(g) for g in got] == [tool.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), FILE).count() == 0


def test_least_squares_against_conditions():
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 30)), rng.random(12) * 5
    x = packing.nonnegative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6


def test_plan_places_every_tail_once():
    rng = np.random.default_rng(1)
    for most in (1, 40, 3000):
        histogram = np.zeros(257, np.int64)
        np.add.at(histogram, rng.integers(1, 257, 60), rng.integers(0, most + 1, 60))
        plan = packing.make_plan(histogram, 2048)
        fill = np.zeros(plan.sequences, np.int64)
        for k in np.flatnonzero(histogram):
            for rank in range(histogram[k]):
                for at, length, sequence, _ in packing.places(plan, 2048, int(k) * 8, int(k), rank):
                    fill[sequence] += length
        assert fill.sum() == (histogram * np.arange(257)).sum() * 8 and (fill <= 2048).all()
        assert (fill > 0).all()
    hot = np.zeros(257, np.int64)
    hot[150] = 1000  # two do not fit a window: they are cut
    assert packing.make_plan(hot, 2048).sequences <= 1000 * 150 // 256 + 1
