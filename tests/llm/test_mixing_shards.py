from collections import Counter

import numpy as np

from ostrakon.llm import mixing as m


def test_shards_meet_their_quotas_beside_documents_without_words(spark):
    """Documents without words hold ranks in full passes, but are not drawn in the last."""
    rows = [(i, None if i % 3 == 0 else "word " * (1 + i % 40), "ab"[i % 2]) for i in range(600)]
    plan = m.plan_of(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8).cache()
    drawn = m.draws(plan, shards=40).collect()
    got = Counter((r.source, r.shard) for r in drawn)
    stats = {}
    for r in plan.collect():
        n, passes, last = stats.get(r.source, (0, 0, 0))
        stats[r.source] = n + 1, r.passes, last + (r.part > 0)
    assert any(last for _, _, last in stats.values())
    quotas = m.split_tree([n * passes + last for n, passes, last in (stats[s] for s in "ab")], 40)
    assert np.array_equal([[got[s, k] for k in range(40)] for s in "ab"], quotas) and sum(got.values()) == quotas.sum()


def test_large_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    # A population that both ways can draw from: the sums stand beside numpy's sampler.
    good, bad, draws = 600_000_000, 399_999_999, 2_000
    small = np.array([m.hypergeometric(rng, good, bad, draws) for _ in range(3000)])
    large = np.array([m.hypergeometric(rng, good, bad + 1, draws) for _ in range(3000)])
    assert abs(small.mean() - large.mean()) < 2.5 and abs(small.std() / large.std() - 1) < 0.08
    n, g, d = 30_000_000_000, 18_750_000_000, 15_000_000_000
    sd = (d * (g / n) * (1 - g / n) * (n - d) / (n - 1)) ** 0.5
    z = np.array([(m.hypergeometric(rng, g, n - g, d) - d * g / n) / sd for _ in range(40)])
    assert abs(z.mean()) < 0.7 and 0.5 < z.std() < 1.6
    assert m.hypergeometric(rng, 10**9, 0, 10**8) == 10**8 and m.hypergeometric(rng, 0, 10**9, 5) == 0
    assert m.hypergeometric(rng, 10**9, 10**9, 2 * 10**9) == 10**9


def test_the_tree_meets_its_quotas_at_any_size():
    quotas = [3 * 10**10, 7, 0, 10**10 + 1]
    tree = m.split_tree(quotas, 8, 1)
    assert (tree.sum(1) == quotas).all() and (tree >= 0).all() and tree.sum(0).max() - tree.sum(0).min() <= 1


def test_shards_are_written_as_the_tree_deals_them(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + 7 * i % 60)), "ab"[i % 3 == 0], i, "x", "y", "z") for i in range(200)]
    rows += [(500, None, "a", 0, "x", "y", "z"), (501, "", None, 0, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, __size string, __parts string, __copy string")
    plan = m.plan_of(docs, block_words=8).cache()
    drawn = m.draws(plan, shards=5).collect()
    got = m.mixed_shards(docs, shards=5, block_words=8).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "__size", "__parts", "__copy", "shard", "order"}
    assert [(r.shard, r.order) for r in got] == sorted((r.shard, r.order) for r in got)
    texts = {i: (t or "").split() for i, t, *_ in rows}
    want = {}
    for r in sorted(drawn, key=lambda r: r.block):
        words = texts[r.doc_id][r.block * 8 : r.block * 8 + r.n_words]
        key = (r.doc_id, r.shard, r["pass"])
        old = want.get(key, ([], "z"))
        want[key] = old[0] + words, min(old[1], r.order)
    assert sorted((r.doc_id, r.shard, r.order, (r.text or "").split()) for r in got) == sorted((d, k, o, w) for (d, k, _), (w, o) in want.items())
    assert len({r.shard for r in got}) == 5
    other = m.mixed_shards(docs, shards=5, block_words=8, seed=1).collect()
    assert [r.doc_id for r in other] != [r.doc_id for r in got]


def test_mixed_documents_keep_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 2, "x"), (2, "d e", "s", 3, 4, "y")], "doc_id long, text string, source string, __size int, __c int, copy string")
    got = m.mixed_documents(docs).collect()
    assert {(r.doc_id, r["__size"], r["__c"], r.copy) for r in got} == {(1, 1, 2, "x"), (2, 3, 4, "y")}
