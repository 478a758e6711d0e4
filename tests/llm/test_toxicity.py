import math
import pickle
import random
import zlib

import pytest

from tests.llm.data import SCHEMA, prose
from uqframe.llm import toxicity

BAD = ["grunk", "blarf", "zmeck"]


def rows(n):
    r = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        ws, bad = prose(1000 + i, r.randint(30, 150)).split(" "), i % 5 == 1 or i % 7 == 2
        for _ in range(2 * bad):
            ws.insert(r.randrange(len(ws)), r.choice(BAD))
        docs.append((i, " ".join(ws), "en", "s", 0, "c"))
        labels.append((i, 1, int(bad)))
    docs += [(n, "", None, None, None, None), (n + 1, None, None, None, None, None), docs[0]]
    return docs, [*labels, (n, 0, None), (None, 0, 1), labels[3]]


def test_held_out_accuracy(spark):
    docs, labels = rows(500)
    got = toxicity.score(spark.createDataFrame(docs, SCHEMA),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels if t is not None}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(docs) and len(right) > 60 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert not any(r.predicted for r in got if r.doc_id in (500, 501))


def test_models_keep_every_word_and_no_conflicting_label(spark):
    """Continuation counts against a plain count over the labelled texts; an id that is labelled
    both ways teaches nothing, in whatever order its rows come."""
    docs, labels = rows(120)
    docs = docs[:120] + [(7777, "onlyhere " * 3 + "twice", None, None, None, None)]
    labels = labels[:120] + [(7777, 0, 0), (7777, 0, 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    model, _ = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.Settings())
    pairs = {0: set(), 1: set()}
    for (i, text, *_), (_, _, toxic) in zip(docs, labels[:120]):
        if zlib.crc32(str(i).encode()) % 5:
            ws = toxicity.tokens(text.encode())
            pairs[toxic] |= set(zip([b"", *ws], ws))
    every = pairs[0] | pairs[1]
    known = {w for _, w in every}
    assert set(model.place) == known and b"onlyhere" not in known
    shared = {w: sum(p[1] == w for p in every) for w in known}

    def log(w, c):
        kept = {x: max(sum(p[1] == x for p in pairs[c]) - 0.75, 0) / len(pairs[c]) for x in known}
        backoff = (shared.get(w, 0) + 1) / (sum(shared.values()) + len(known) + 1)
        return math.log(kept.get(w, 0) + (1 - sum(kept.values())) * backoff)

    for w in [*sorted(known)[:5], b"grunk", b"neverseen"]:
        assert model.ratios([w])[0] == pytest.approx(log(w, 1) - log(w, 0))


def test_without_labels(spark):
    docs, labels = rows(20)
    none = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("toxic = 0")
    got = toxicity.score(spark.createDataFrame(docs, SCHEMA), none).collect()
    assert len(got) == len(docs) and not any(r.score for r in got)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_expressions_against_plain_counts(spark):
    """Kneser-Ney over expressions, each counted once per different text of a class; copies of a text
    change nothing, and neither does how often a text repeats an expression."""
    docs, labels = rows(120)
    docs, labels = docs[:120], labels[:120]
    docs[3] = (3, "so so so so it is it is", None, None, None, None)
    copies = [(1000 + i, text, *rest) for i, text, *rest in docs for _ in range(1 + i % 2)]
    more = [(i, 0, dict((j, t) for j, _, t in labels)[i - 1000]) for i, *_ in copies]
    schema = "doc_id long, quality int, toxic int"
    used = {i: t for i, _, t in [*labels, *more] if zlib.crc32(str(i).encode()) % 5}
    texts = {(used[i], text) for i, text, *_ in [*docs, *copies] if i in used}
    model, _ = toxicity.fit(spark.createDataFrame([*docs, *copies], SCHEMA),
                            spark.createDataFrame([*labels, *more], schema), toxicity.Settings())
    counts = {0: {}, 1: {}}
    for c, text in texts:
        ws = toxicity.tokens(text.encode())
        for pair in set(zip([b"", *ws], ws)):
            counts[c][pair] = counts[c].get(pair, 0) + 1
    every = set(counts[0]) | set(counts[1])
    known = {w for _, w in every}

    def word(w, c):
        kept = {x: max(sum(p[1] == x for p in counts[c]) - 0.75, 0) / len(counts[c]) for x in {w, *known}}
        backoff = (sum(p[1] == w for p in every) + 1) / (len(every) + len(known) + 1)
        return kept[w] + (1 - sum(kept.values())) * backoff

    def log(v, w, c):
        own = [n for p, n in counts[c].items() if p[0] == v]
        if not own:
            return math.log(word(w, c))
        kept = max(counts[c].get((v, w), 0) - 0.75, 0)
        return math.log((kept + 0.75 * len(own) * word(w, c)) / sum(own))

    for ws in ([b"so", b"so", b"it", b"is", b"neverseen", b"so"], [b"grunk", b"blarf"],
               toxicity.tokens(docs[1][1].encode())[:6]):
        want = [log(v, w, 1) - log(v, w, 0) for v, w in zip([b"", *ws], ws)]
        assert list(model.expression_ratios(ws)) == pytest.approx(want)
        assert list(pickle.loads(pickle.dumps(model)).expression_ratios(ws)) == pytest.approx(want)
        assert list(model.ratios(ws)) == pytest.approx([math.log(word(w, 1) / word(w, 0)) for w in ws])


def test_texts_without_words_teach_no_expression(spark):
    docs = [(i, None if i % 2 else "", None, None, None, None) for i in range(40)] + [(99, "a b", None, None, None, None)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.score(spark.createDataFrame(docs, SCHEMA), labels).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)
