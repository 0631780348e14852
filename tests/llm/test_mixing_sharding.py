import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ostrakon.llm import mixing, sharding
from ostrakon.llm.common import table
from ostrakon.llm.queries import ORACLE


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
@settings(deadline=None)
def test_water_fill_is_the_reshared_fixed_point(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total = 1.5 * sum(sizes)
    got = mixing.water_fill(sizes, weights, total)
    want, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(2.0 * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        want = [2.0 * sizes[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and want[i] > 2.0 * sizes[i]}
        if not above or not w:
            break
        full |= above
        if len(full) == len(sizes):
            want = [2.0 * s for s in sizes]
            break
    assert np.allclose(got, want, atol=1e-6) and abs(sum(got) - total) < 1e-6 * max(1, total)


@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 17))
@settings(deadline=None)
def test_splitting_tree_is_exact(quotas, shards):
    tree = mixing.split_tree(quotas, shards, 7)
    assert (tree.sum(1) == quotas).all() and (tree >= 0).all()
    assert tree.sum(0).max() - tree.sum(0).min() <= 1
    assert (tree == mixing.split_tree(quotas, shards, 7)).all()


def test_mix_meets_its_targets_and_the_oracle(spark, sf):
    import duckdb

    docs = table(spark, sf, "documents")
    rows = mixing.taken(docs).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(ORACLE["op3_mixing"]).fetchall()}
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in rows} == want
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    got, target = Counter(), {}
    for r in rows:
        got[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(got[s] == int(target[s] + 0.5) for s in target)


def test_draws_are_disjoint_and_fill_their_shards(spark, sf):
    plan = mixing.plan_of(table(spark, sf, "documents"), block_words=64)
    drawn = mixing.draws(plan, shards=7).collect()
    assert len({(d.doc_id, d.copy, d.block, d["pass"]) for d in drawn}) == len(drawn)
    per = Counter(d.shard for d in drawn)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd ", "en", "s1", 9), (2, None, "en", None, 0), (3, "", "de", "s2", 0), (4, "x y z " * 300, "de", "s2", 1800), (4, "x y z " * 300, "de", "s2", 1800)], "doc_id long, text string, lang string, source string, n_chars long")
    want = defaultdict(int)
    for r in mixing.taken(docs, block_words=100).collect():
        want[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs, block_words=100)
    assert mixed.schema == docs.schema
    got = defaultdict(int)
    for r in mixed.collect():
        assert len(r.text) == r.n_chars
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.taken(docs, block_words=100).count() == 5 and mixing.taken(docs.limit(0)).count() == 0
    assert mixing.cut_text("  a b  c\nd ", [(0, 2), (1, 2)], 2) == "  a b  c\nd "


def test_shards_are_near_equal_and_gapless(spark, sf):
    docs = table(spark, sf, "documents").unionByName(table(spark, sf, "documents").limit(3))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "x", "y", 0), (10**6 + 1, "", "x", "y", 0)], docs.schema))
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    loads = [sum(x["size"] for x in v) for v in by.values()]
    assert len(loads) == 5 and max(loads) < 1.02 * min(loads)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in shard_of.values())


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    counts = Counter(r.shard for r in sharding.shard_documents(docs, shards=10).collect())
    assert max(counts.values()) < 1.1 * min(counts.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0
