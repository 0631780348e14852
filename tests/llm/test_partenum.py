import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ostrakon.llm import partenum as p
from ostrakon.llm.common import WordHashes, mix64, table

SCHEME = p.Scheme()


def sets_of(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, num=85, den=100, words=4):
    sets = {i: sets_of(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@given(st.integers(1, 600), st.integers(0, 10**6), st.floats(0, 1))
@settings(max_examples=150, deadline=None)
def test_similar_sets_share_a_signature(n, seed, share):
    rng = np.random.default_rng(seed)
    most = int(15 * 2 * n / 170)
    lost, won = int(share * most) // 2, int((1 - share) * most) // 2
    base = np.unique(mix64(rng.integers(0, 2**63, n + won).astype(np.uint64)))
    a, b = base[: n], np.concatenate([base[: n - lost], base[n:]])
    if SCHEME.linked(len(np.intersect1d(a, b)), len(np.union1d(a, b))):
        assert set(p.signatures(np.sort(a), SCHEME)) & set(p.signatures(np.sort(b), SCHEME))
        common = np.sort(base[rng.random(len(base)) < share])
        assert set(p.signatures(np.sort(a), SCHEME, common)) & set(p.signatures(np.sort(b), SCHEME, common))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 33), (500, 560), (1000, 1100)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)]))
        assert p.differing(p.bitmap(a), p.bitmap(b)) <= len(np.setxor1d(a, b))


def test_shingles():
    known = WordHashes()
    assert len(p.shingles(b"", 4, known)) == 0 and len(p.shingles(b"a b", 4, known)) == 1
    assert (p.shingles(b"A b\x0bC d e", 4, known) == p.shingles(b"a  b c D E", 4, known)).all()
    assert p.shingles("É".encode(), 4, known)[0] != p.shingles("é".encode(), 4, known)[0]


def family(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("combined", [2, 128])
def test_components_equal_brute_force(spark, monkeypatch, combined):
    monkeypatch.setattr(p, "COMBINED", combined)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one two", "ONE  two", "one two three", "x" * 50_000, "same same same same same"]
    for size in (8, 20, 40, 60, 120, 240):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 1, 1, 2, 3):
            texts += family(rng, base, 6, edits)
    chain = [rng.choice(words) for _ in range(200)]
    for _ in range(25):  # neighbours are similar, ends are not
        texts.append(" ".join(chain))
        chain = chain[5:] + [rng.choice(words) for _ in range(5)]
    rows = list(enumerate(texts)) + [(3, "one two")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, n string")
    got = p.join(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_open_buckets_are_examined_to_the_end(spark, monkeypatch):
    """With signatures that all sets share, only the examination of open buckets can find the links."""
    monkeypatch.setattr(p, "TILE", 8)
    rng = random.Random(4)
    texts = []
    for k in range(5):
        base = [f"v{rng.randrange(300)}" for _ in range(60)]
        texts += family(rng, base, 7, 1)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    job = p.Join(docs, SCHEME)
    # Batches 0-9, 10-19 and so on; all share one signature with least id 0.
    stars = [(p.LOCAL, i, i // 10 * 10) for i in range(len(rows)) if i % 10] + [(p.GLOBAL, i, 0) for i in range(10, len(rows), 10)]
    stars = spark.createDataFrame(stars, "kind int, a long, b long")
    tested = stars.select(p.F.least("a", "b").alias("a"), p.F.greatest("a", "b").alias("b"))
    job.link(p.materialise(job.near(tested), "t"))
    job.link(p.materialise(job.unsettled(stars, tested), "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in job.result().collect()} == brute(rows)


def test_small_tables(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in p.join(docs).collect()} == brute(rows)
    kept = p.deduplicated(docs)
    assert kept.columns == docs.columns
    want = brute(rows, 80, 100, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert p.join(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in p.join(nulls).collect()) == [("1", 2, "1"), ("None", 0, "None"), ("None", 2, "None")]


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (3, 2), (3, 9), (9, 20), (7, 8)], {1: 1, 2: 1, 3: 1, 9: 1, 20: 1, 7: 7, 8: 7}), ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0))])
def test_components(spark, edges, want):
    got = {r.v: r.c for r in p.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_the_oracle_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(p.ORACLE_SQL)
    want = sorted(cursor.fetchall())
    got = p.join(table(spark, sf, "documents"))
    assert [d[0] for d in cursor.description] == got.columns and sorted(map(tuple, got.collect())) == want
