import random

from tests.llm.data import documents, frame, prose
from uqframe.llm import superminhash as m
from uqframe.llm.components import Forest, components


def brute(rows, size=2, percent=80):
    sets = {}
    for i, t, *_ in rows:
        ws = [w.lower() for w in (t or "").encode().split()]
        n = min(size, len(ws))
        sets[i] = {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)} if ws else set()
    forest, ids = Forest(), [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * either:
                forest.union(a, b)
    out = []
    for i, *_ in rows:
        root = None if i is None else forest.find(i)
        out.append((i, len(sets[i]), root, i is None or root == i))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    got = m.near_duplicates(frame(spark), size=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(documents())
    assert m.near_duplicates(frame(spark, [])).count() == 0


def chain_rows():
    """Links only between neighbours, and near copies that are linked to their origin alone,
    whose id is not the smallest."""
    ws = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(ws[k * 8:k * 8 + 200]), "e", "s", 0, "c") for k in range(12)]
    base = prose(77, 300).replace("\n", " ").split(" ")
    for k in range(90):
        r, own = random.Random(k), list(base)
        for j in r.sample(range(len(own)), 15 if k else 30):
            own[j] = f"q{k}z{j}"
        rows.append((100 + k, " ".join(own), "e", "s", 0, "c"))
    rows.append((500, " ".join(base), "e", "s", 0, "c"))
    return rows


def test_links_that_no_center_sees(spark):
    rows = chain_rows()
    got = m.near_duplicates(frame(spark, rows), size=2).collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[3] for r in want) < 20


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(4)
    a = np.unique(r.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([a[:400], r.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((m.signature(a) == m.signature(b)).mean() - true) < 0.2
    assert (m.signature(a) == m.signature(a[::-1])).all()


def test_keep_first(spark):
    df = frame(spark)
    out = m.keep_first(df)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and 0 in ids and not {1, 2, 3} & set(ids) and None in ids


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 105), (102, 105)], "a long, b long")
    got = {r.node: r.component for r in components(edges.repartition(8)).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in (100, 102, 105)} == {100}
    assert components(edges.where("false")).count() == 0


def test_tiles_of_sets_of_all_sizes(spark):
    """Every link between members of a band that are apart, sets beyond a tile's shingles included."""
    import numpy as np

    r = np.random.default_rng(3)
    sets = {}
    for k in range(160):
        n = int(5 * 1.06 ** k) if k < 157 else 1_200_000
        own = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        sets[2 * k] = own
        sets[2 * k + 1] = own[:max(1, (82 if k % 3 else 70) * len(own) // 100)]
    items = spark.createDataFrame([(i, len(v), bytearray(v.tobytes())) for i, v in sets.items()],
                                  "doc_id long, n long, items binary").repartition(4)
    buckets = spark.createDataFrame([(b, i, i) for b in (7, 9) for i in sets if b == 7 or i % 5],
                                    "bucket long, doc_id long, label long")
    got = {tuple(sorted(x)) for x in m.check_tiles(buckets, items, 80).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(160) if m.similar(sets[2 * k], sets[2 * k + 1], 80)}
    assert got == want and len(want) > 90


def test_size_classes_keep_similar_sizes_adjacent(spark):
    from pyspark.sql import functions as F

    for percent in (80, 50, 100):
        n = spark.range(1, 60_000).select(
            m.size_class(F.col("id"), percent).alias("a"),
            m.size_class(F.floor(F.col("id") * 100 / percent), percent).alias("b"))
        assert n.where("b - a not in (0, 1)").count() == 0


def test_thousands_of_near_copies(spark):
    base = prose(50, 120).split(" ")
    rows = []
    for k in range(5000):
        own = list(base)
        own[k % 100] = f"z{k}"
        rows.append((k, " ".join(own), "e", "s", 0, "c"))
    rows += [(9000, "q " + prose(51, 120), "e", "s", 0, "c")]
    got = m.near_duplicates(frame(spark, rows), size=2)
    assert [tuple(r) for r in got.groupBy("component_id").count().orderBy("component_id").collect()] == [
        (0, 5000), (9000, 1)]
