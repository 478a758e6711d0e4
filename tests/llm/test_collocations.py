import re
from collections import Counter

import pytest

from tests.llm.data import frame, prose
from uqframe.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, score string"


def brute(rows, least=30, share=80, first=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            counts.update((lang, *ws[i:i + m]) for m in (1, 2, 3, 4) for i in range(len(ws) - m + 1))
    kept = {k: v for k, v in counts.items() if v >= least and len(k) > 2}
    dropped = set()
    for (lang, *ws), f in kept.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                part = (lang, *ws[i:i + m])
                if 100 * f >= share * kept[part]:
                    dropped.add(part)
    out = {}
    for key, a in kept.items():
        if key in dropped:
            continue
        lang, *ws = key
        cuts = []
        for k in range(1, len(ws)):
            l, r = counts[(lang, *ws[:k])], counts[(lang, *ws[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:first]))


def texts():
    hot = "of the very common phrase, and then some more\tof the very common phrase! Of The"
    rows = [(i, f"{hot} word{i % 5} tail{i % 3} end. {prose(i % 7, 90)}", "en", 1, "x") for i in range(60)]
    rows += [(100 + i, "ein zwei drei vier; ein zwei " * (1 + i), None if i % 2 else "de", None, "x") for i in range(20)]
    rows += [(200, None, "en", 1, None), (201, "", "fr", 1, None), (202, " \t\r\n.,", "fr", 1, None),
             (203, "a\x01 b\x02\x00 é日本 " * 40, "en", 1, None), (None, "no id here " * 40, "", 1, None),
             (204, "lang word " * 30_000, "en", 1, None), (205, "x" * 100_000, "en", 1, None)]
    return rows + rows[:9]


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, shards and walks, a long text over several blocks
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(collocations, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(collocations, "WALK_ROWS", 7)
    rows = texts()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_first_and_least(spark):
    rows = texts()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=5, keep_share=50, first=6)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 50, 6)


def test_empty(spark):
    assert collocations.collocations(frame(spark).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None, None, None, None)])).count() == 0


def test_exact_beyond_64_bits():
    import numpy as np
    grams = np.array([[1, 0, 0, 0], [1, 2, 0, 0], [1, 2, 3, 0], [2, 0, 0, 0]], np.uint32)
    counts = np.array([1 << 60, 7, 1 << 40, 3])
    assert dict((tuple(k), v) for k, v in collocations.phrase_counts(grams, counts, 30)) == {
        (1,): (1 << 60) + 7 + (1 << 40), (2,): 3, (1, 2): 7 + (1 << 40), (1, 2, 3): 1 << 40}
