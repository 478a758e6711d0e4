import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tests.llm.data import documents, frame
from uqframe.llm import suffix_tree as t

S = t.Settings()


def parts(text):
    return [w.lower() for w in (text or "").encode().split()]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, s=S):
    train = [[*parts(r[1]), None] for r in rows if not held(r[0])]
    counts = Counter(w for ws in train for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    after = {}
    for ws in train:
        ws = [None] * s.depth + ws
        for i in range(s.depth, len(ws)):
            for k in range(1, s.depth + 1):
                after.setdefault(tuple(ws[i - k:i]), Counter())[ws[i]] += 1
    kept = set()

    def p(c, x):
        out = (counts[x] + 1) / (total + kinds + 1)
        for k in range(1, len(c) + 1):
            if (own := c[len(c) - k:]) in kept:
                n, d = sum(after[own].values()), len(after[own])
                out = after[own][x] / (n + d) + d / (n + d) * out
        return out

    for k in range(1, s.depth + 1):
        new = set()
        for c in [c for c in after if len(c) == k and sum(after[c].values()) >= s.least_count]:
            n, d = sum(after[c].values()), len(after[c])
            gain = 0.0
            for x, m in after[c].items():
                low = p(c[1:], x)
                gain += m * math.log((m / (n + d) + d / (n + d) * low) / low)
            if gain > s.least_gain * d:
                new.add(c)
        kept |= new
    out = []
    for i, text, *_ in rows:
        ws = [*parts(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        wide = [None] * s.depth + ws
        score = sum(math.log10(p(tuple(wide[j - s.depth:j]), wide[j])) for j in range(s.depth, len(wide)))
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5)


@pytest.mark.parametrize("rows", [documents(), []], ids=["documents", "empty"])
def test_equals_brute_force(spark, rows):
    same(t.score(frame(spark, rows)).collect(), brute(rows))


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_hot_words_over_many_shards(spark, monkeypatch, depth):
    """One word is a third of all words and follows itself; shards are small, blocks are many."""
    rows = documents()
    hot = [(100 + i, " ".join("the" if j % 3 == i % 2 or j % 7 < 2 else f"w{(i * j) % 23}" for j in range(300)),
            None, None, None, None) for i in range(12)]
    rows = rows + hot
    monkeypatch.setattr(t, "BLOCK_BYTES", 4000)
    found = []
    find = t.find_hot
    monkeypatch.setattr(t, "find_hot", lambda *a: found.append(find(*a)) or found[-1])
    s = replace(S, depth=depth, shard_records=75, least_gain=0.5)
    same(t.score(frame(spark, rows), s).collect(), brute(rows, s))
    assert found[0].shards > 20 and found[0].any() == (depth > 1)
    assert depth < 3 or len(found[0].levels[1][0])  # contexts of two words are hot, too


def test_copies_score_apart(spark):
    """A text that is learned from twice is likelier than one that is not."""
    rows = documents()
    got = {r.doc_id: r.score / r.n_tokens for r in t.score(frame(spark, rows)).collect()}
    assert got[0] > got[13] + 0.3 and got[0] == got[1]
