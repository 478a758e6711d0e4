from collections import Counter

from tests.llm.data import documents, frame, prose, words
from uqframe.llm import quality
from uqframe.llm.quality import Limits


def brute(text):
    ws = words(text)
    triples = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {k + j for k, t in enumerate(zip(ws, ws[1:], ws[2:])) if triples[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return (len(ws), sum(len(w.decode()) for w in ws), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_base_figures_and_verdict(spark):
    limits = Limits(min_docs=10, max_share=0.2, max_lost=0.5)
    got = quality.judge(frame(spark), limits).collect()
    texts = {(r[0], brute(r[1])): r[1] for r in documents()}
    assert len(got) == len(documents())
    for r in got:
        figures = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (r.doc_id, figures) in texts
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    lost = {r.doc_id: r.n_lost for r in got}
    assert lost[20] == 0 and all(lost[k] == 7 for k in range(21, 60))  # the first keeps the line
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id in (0, 1, 2, 4, 5, 13, 25))


def test_both_ways_of_removal_agree(spark):
    few = Limits(min_docs=10, max_share=0.2)
    many = Limits(min_docs=10, max_share=0.2, most_listed=0)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)
    a, b = (sorted(quality.judge(frame(spark), x).drop("row").collect(), key=key) for x in (few, many))
    assert a == b


def test_depleted_documents_go(spark):
    lines = prose(50, 108)
    rows = [(k, lines + f"\nonly {k} here", "en", "h", 0, "c") for k in range(30)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[0].kept and not any(got[k].kept for k in range(1, 30))
    assert not got[5].base_failed


def test_apply_keeps_columns_and_copes_with_nothing(spark):
    df = frame(spark)
    out = quality.apply_rules(df, Limits(min_docs=10, max_share=0.2))
    assert out.columns == df.columns and {r.kept for r in out.collect()} <= {"clash", None}
    assert "Shared line" not in next(r.text for r in out.collect() if r.doc_id == 30)
    assert quality.apply_rules(frame(spark, [])).count() == 0
    assert quality.judge(frame(spark, [])).count() == 0
