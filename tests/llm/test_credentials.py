import hashlib
import random

from tests.llm.data import documents, frame
from uqframe.llm import credentials as c


def joined(spans):
    order = sorted(spans, key=lambda s: (s[1], c.KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def brute(text):
    import re

    out = []
    for kind, pattern, least, group in (
            ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
            ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return out


def test_base_spans(spark):
    got = c.scan(frame(spark)).collect()
    assert len(got) == len(documents())
    texts = {r[0]: r[1] or "" for r in documents()}
    for r in got:
        base = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == b[0] for b in base) for k in c.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(filter(None, r.spans.split(",")))
    assert c.scan(frame(spark, [])).count() == 0


def test_learned_format_is_found():
    r = random.Random(5)
    secret = lambda: "".join(r.choice("0123456789abcdefXYZ") for _ in range(24))
    ordinary = ["".join(r.choice("aeioulmnrst") for _ in range(20)) for _ in range(300)]
    formats = c.Formats({"assign": [secret() for _ in range(300)]}, c.class_pairs(ordinary), c.Settings())
    assert sum(formats.secret(secret()) for _ in range(200)) > 170
    assert sum(map(formats.secret, ordinary)) == 0
    assert not c.Formats({}, c.class_pairs(ordinary), c.Settings()).secret(secret())


def test_merged_automaton_is_small_and_a_distribution():
    r = random.Random(2)
    a = c.Automaton(["AB" + "".join(r.choice("012345") for _ in range(r.randint(2, 9))) for _ in range(500)], 0.05)
    assert len(a.reds) < 15
    for s in a.reds:
        assert a.total(s) == a.ends[s] + sum(a.uses[s].values())


def test_redaction(spark):
    df = frame(spark)
    out = {r.doc_id: r for r in c.redact(df).collect()}
    assert c.redact(df).columns == df.columns and out[8].text is None
    assert "8985f69a751217166f" not in out[17].text and "AKIA2" not in out[17].text
    assert out[4].text == documents()[4][1] and out[17].n_chars == len(out[17].text)


def test_all_runs_teach_the_ordinary_model(spark):
    """Counts of every run of every row, whatever its length, and candidates of 12 characters."""
    runs = [f"{'abcdefgh' * (i % 40 + 2)}{i:04d}" for i in range(9000)]
    rows = [(i, " ".join(runs[i * 90:i * 90 + 90]), None, None, None, None) for i in range(100)]
    found = c._find(frame(spark, rows))
    want = c.class_pairs(runs)
    assert c.learn(found, c.Settings()).pairs == want and sum(want.values()) > 9000 * 20
    short = c.candidates("pwd Xk29fLq8Zt3B and x12345678901", [])
    assert [v for _, _, v in short] == ["Xk29fLq8Zt3B", "x12345678901"]
