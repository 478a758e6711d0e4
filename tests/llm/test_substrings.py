import hashlib

from tests.llm.data import documents, frame, words
from uqframe.llm import substrings


def brute(rows, width=13):
    first = {}
    for i, t, *_ in rows:
        ws = words(t)
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k:k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        gone = {k + j for k in range(len(ws) - width + 1) for j in range(width)
                if i is not None and first[tuple(ws[k:k + width])] < i}
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    want = brute(documents())
    assert sum(r[2] > 0 for r in want) > 4
    for shard_words in (substrings.SHARD_WORDS, 500):  # one shard and many
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard_words)
        got = substrings.remove_repeats(frame(spark)).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_texts_keep_their_blanks(spark):
    df = frame(spark)
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    texts = {r[0]: r[1] for r in documents()}
    assert got[8].text is None and got[13].text == texts[13] and got[1].text == ""
    assert got[14].text == texts[14] and {r.kept for r in got.values()} <= {"clash", None}
    assert got[6].n_chars == len(got[6].text) < len(texts[6])
