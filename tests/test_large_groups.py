"""Operators on pairs and graphs whose groups are larger than one task or one product should hold."""

import math
import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ostrakon.operators import graph as G
from ostrakon.operators import similarity as M
from ostrakon.operators import survival as V
from ostrakon.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cosine_pairs_of_large_groups_are_products_of_matrices(spark, sf):
    rng = random.Random(3)
    data = [(i, i % 2, [float(rng.randrange(-4, 5)) for _ in range(3)]) for i in range(40)]
    data += [(40, 0, [0.0, 0.0, 0.0]), (41, 0, None), (42, 0, [1.0, None, 2.0]), (43, 0, [1.0, 2.0]), (44, None, [1.0, 2.0, 3.0]), (45, 0, []), (46, 0, [2.0, 1.0])]
    df = spark.createDataFrame(data, "id long, g int, v array<float>")
    pair = df.alias("x").join(df.alias("y"), F.expr("x.g = y.g AND x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(M.cosine(F.col("x.v"), F.col("y.v")), 5).alias("c"))
    want = {(r.a, r.b): None if r.c is None else r.c + 0.0 for r in pair.collect()}
    for tile in (7, 1000):
        got = [tuple(r) for r in M.cosine_pairs(df, "id", "v", ["g"], 5, tile).collect()]
        assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want
    assert "FlatMapGroupsInArrow" in plan(QUERIES["e2_cosine"](spark, sf))


def dense_sets(n=70, copies=25):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(9), rng.randrange(5, 9))) for _ in range(n)]
    sets += [sets[0]] * copies
    return [(e, i, e % 2) for e, s in enumerate(sets) for i in s]


def plain_pairs(data, threshold):
    sets = {}
    for e, i, g in data:
        sets.setdefault((g, e), set()).add(i)
    out = [(g, a, b, len(x & y), len(x & y) / len(x | y)) for ((g, a), x), ((h, b), y) in combinations(sorted(sets.items()), 2) if g == h]
    return sorted(r for r in out if r[4] >= threshold)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_jaccard_of_frequent_items_forms_no_join_of_pairs(spark, kind):
    data = dense_sets()
    df = spark.createDataFrame([(f"{e:03}" if kind == "string" else e, i, g) for e, i, g in data], f"e {kind}, x int, g int")
    got = M.jaccard_join(df, "e", "x", 0.8, ["g"])
    assert "FlatMapGroupsInArrow" in plan(got)
    got = sorted((r.g, int(r.a), int(r.b), r.shared, r.jaccard) for r in got.collect())
    assert got == plain_pairs(data, 0.8) and len(got) > 100
    whole = df.groupBy("g", "e").agg(F.collect_set("x").alias("items"))
    small = M._jaccard_tiles(whole, "e", 0.8, ["g"], 1, None, tile=9)
    assert sorted((r.g, int(r.a), int(r.b), r.shared, r.jaccard) for r in small.collect()) == got


@pytest.mark.parametrize("k", [2, 20])
def test_best_partners_without_all_pairs(spark, k):
    data = dense_sets()
    df = spark.createDataFrame(data, "e long, x int, g int")
    pairs = spark.createDataFrame(plain_pairs(data, 0.7), "g int, a long, b long, shared int, jaccard double")
    want = M.top_neighbours(pairs, k, group=["g"]).select("g", "a", "b", "shared", "jaccard").collect()
    got = M.jaccard_best(df, "e", "x", 0.7, k, ["g"])
    assert "FlatMapGroupsInArrow" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    sparse = spark.createDataFrame([(e, 100 * e + i, 0) for e in range(30) for i in range(5)] + [(40, i, 0) for i in range(5)], "e long, x int, g int")
    assert [tuple(r) for r in M.jaccard_best(sparse, "e", "x", 0.7, k, ["g"]).collect()] == [(0, 0, 40, 5, 1.0)]


def test_overlaps_by_rows_and_items():
    rng = random.Random(2)
    left, right = ([rng.sample(range(60), rng.randrange(0, 20)) for _ in range(n)] for n in (23, 31))
    want = [[len(set(x) & set(y)) for y in right] for x in left]
    for rows, step in ((5, 7), (100, 4096)):
        got = np.concatenate([m for _, m in M.overlaps(pa.array(left), pa.array(right), rows, step)])
        assert got.tolist() == want


def test_bridges_shuffle_no_pairs(spark):
    rng = random.Random(6)
    domains = {p: rng.sample("abcde", rng.randrange(0, 6)) for p in range(50)}
    domains[50] = None
    uses = [(c, p) for c in range(3) for p in range(51) if rng.random() < 0.6] + [(0, 50), (0, 1), (0, 1), (None, 2)]
    df, ds = spark.createDataFrame(uses, "c int, p long"), spark.createDataFrame(list(domains.items()), "p long, ds array<string>")
    got = G.bridges(df, ds, "c", "p", 0.3)
    assert plan(got).split("FlatMapGroupsInArrow")[0].count("Exchange") == 0
    want = set()
    for c, a in uses:
        for e, b in uses:
            x, y = set(domains[a] or []), set(domains[b] or [])
            gap = 1 - (len(x & y) / len(x | y) if x and y else 0.0)
            if c is not None and c == e and a < b and gap > 0.3:
                want.add((c, a, b, gap))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want


def test_lin_of_frequent_terms_by_tiles(spark):
    rng = random.Random(7)
    data = [(e, t) for e in range(60) for t in rng.sample(range(12), rng.randrange(1, 8))] + [(60, 11), (61, 12)]
    df = spark.createDataFrame(data, "e long, t string")
    ic = spark.createDataFrame([(str(t), (t % 5) / 4) for t in range(13)], "t string, ic double")
    got = M.lin_similarity(df, "e", "t", ic)
    assert "FlatMapGroupsInArrow" in plan(got)
    sets, want = {}, []
    for e, t in data:
        sets.setdefault(e, {})[t] = (t % 5) / 4
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        if x.keys() & y.keys():
            total = max(x.values()) + max(y.values())
            want.append((a, b, 2 * max(x[t] for t in x.keys() & y.keys()) / total if total > 0 else 0.0))
    assert sorted(map(tuple, got.collect())) == want
    told = df.join(ic, "t")
    assert sorted(map(tuple, M._lin_tiles(told, "e", "t", tile=7).collect())) == want


@pytest.mark.parametrize("directed", [False, True])
def test_search_carries_sources_as_bits(spark, directed, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(330)) for _ in range(700)]
    near = {}
    for a, b in edges:
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            near.setdefault(x, set()).add(y)
    want = set()
    for s in list(range(320)) + [1000]:
        at, front = {s: 0}, [s]
        for hop in range(1, 5):
            front = [y for y in {y for x in front for y in near.get(x, ())} if y not in at]
            at.update(dict.fromkeys(front, hop))
        want |= {(s, y, d) for y, d in at.items()}
    wide, whole = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: wide.append(whole(df, name)) or wide[-1])
    df = spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r) for r in G.bfs(df, spark.createDataFrame([(i,) for i in [*range(320), 1000, 5]], "source long"), 4, directed).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(w.count() for w in wide) < len(want) / 8


def test_concordance_by_entity_counts_without_pairs(spark):
    rng = random.Random(9)
    data = [(i, i % 3 if i < 140 else None, rng.randrange(12) if rng.random() < 0.95 else None, rng.choice([0, 1, 1, None]), rng.choice([0.5, 1.5, 2.5, -3.0, None, math.nan])) for i in range(150)]
    df = spark.createDataFrame(data, "id int, g int, t int, e int, h double")
    got = V.concordance_by_entity(df, "id", "g", "t", "e", "h")
    assert "Join" not in plan(got)
    high = lambda h: (h != h, 0.0 if h != h else h)
    pairs, score = {}, {}
    for i, g, t, e, h in data:
        for j, g2, t2, _, h2 in data:
            if g is not None and g == g2 and e == 1 and t is not None and t2 is not None and t < t2:
                s = 0.0 if h is None or h2 is None else 1.0 if high(h) > high(h2) else 0.5 if high(h) == high(h2) else 0.0
                for k in (i, j):
                    pairs[g, k], score[g, k] = pairs.get((g, k), 0) + 1, score.get((g, k), 0.0) + s
    assert sorted(map(tuple, got.collect())) == sorted((*k, n, score[k] / n) for k, n in pairs.items())


def test_communities_of_a_large_group(spark):
    n = 6000
    edges = [(5 * c + i, 5 * c + j, 0) for c in range(n // 5) for i in range(5) for j in range(i)]
    start = time.monotonic()
    got = G.communities(spark.createDataFrame(edges, "src long, dst long, grp int")).collect()
    assert time.monotonic() - start < 60 and len(got) == n
    one = {r.id: r.community for r in got}
    assert sum(len({one[5 * c + i] for i in range(5)}) == 1 for c in range(n // 5)) == n / 5


def test_common_neighbours_are_listed_from_the_end_with_fewer(spark):
    rng = random.Random(11)
    edges = sorted({(0, i) for i in range(1, 200)} | {(1, i) for i in range(50, 250)} | {tuple(sorted(rng.sample(range(250), 2))) for _ in range(300)})
    held, kept = edges[::5], [e for k, e in enumerate(edges) if k % 5]
    absent = [(a, b) for a, b in ((rng.randrange(250), rng.randrange(260)) for _ in range(80)) if a != b and (a, b) not in edges]
    near = {}
    for a, b in kept:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = lambda p: len(near.get(p[0], set()) & near.get(p[1], set()))
    absent = sorted(set(absent))
    want = sum((score(x) > score(y)) + (score(x) == score(y)) / 2 for x in held for y in absent) / len(held) / len(absent)
    frame = lambda d: spark.createDataFrame(d, "src long, dst long")
    got = G.link_prediction(frame(kept), frame(held), frame(absent))
    assert "lean" in plan(got) and got.first().auc == pytest.approx(want) and {got.first().n1, got.first().n2} == {len(held), len(absent)}


def test_chains_stop_at_a_full_report(spark, monkeypatch):
    rng = random.Random(12)
    edges = sorted({tuple(rng.sample(range(120), 2)) for _ in range(500)})
    cats = {i: rng.sample("abcdef", rng.randrange(1, 4)) for i in range(100)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    paths, now = [], [(a,) for a in near]
    for _ in range(3):
        now = [(*p, x) for p in now for x in near[p[-1]] if x not in p]
        paths += now
    every = sorted((-len(set(cats[p[0]]) ^ set(cats[p[-1]])), p) for p in paths if p[0] < p[-1] and p[0] in cats and p[-1] in cats)
    every = [(list(p), -g) for g, p in every if g <= -3]
    df, cs = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(list(cats.items()), "id long, cats array<string>")
    sizes, whole = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: sizes.append((name, whole(df, name))) or sizes[-1][1])
    for most in (40, 700, 10**6):
        sizes.clear()
        assert [(r.path, r.gap) for r in G.chains(df, cs, 3, 3, most).collect()] == every[:most]
        assert {n for n, _ in sizes} <= {"edges", "ends", "starts", "best"}
    assert G.chains(df, cs.limit(0), 3, 3).count() == 0


def test_coherence_without_a_square_matrix(spark):
    rng = random.Random(13)
    edges = sorted({(rng.randrange(40), rng.randrange(40, 400), 0) for _ in range(2500)} | {(i, (i + 1) % 90, 1) for i in range(90)} | {(1, 2, 2), (3, 4, 2), (5, 5, 2), (2, 1, 2)})
    edges += [(i, j, 3) for i in range(12) for j in range(12)] + [(1, 2, 4)]
    df = spark.createDataFrame(edges, "src long, dst long, grp int")
    want = {r.grp: (r.n, r.coherence) for r in G.coherence(df).collect()}
    got = {r.grp: (r.n, r.coherence) for r in G.coherence(df, most_dense=2).collect()}
    assert want.keys() == got.keys() == {0, 1, 2, 3, 4}
    for g, (n, c) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(c, abs=1e-7)
    src, dst = (np.array([e[k] for e in edges if e[2] == 0]) for k in (0, 1))
    assert G._ends_of_laplacian(400, src, dst, most_bytes=1) == pytest.approx(G._ends_of_laplacian(400, src, dst), abs=1e-5)
