"""Searches from all nodes of a graph run in memory and give what plain searches give."""

import random
from collections import deque

import pytest

from ostrakon.operators import compact
from ostrakon.operators import graph as G


def adjacency(rows):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()), near.setdefault(b, set())
        if a != b:
            near[a].add(b), near[b].add(a)
    return near


def search(near, s, without=None):
    dist, count, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        v = queue.popleft()
        for w in near[v] - {without}:
            if w not in dist:
                dist[w], count[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                count[w] += count[v]
    return dist, count


def parts(near, without=None):
    left, k = set(near) - {without}, 0
    while left:
        left -= set(search(near, next(iter(left)), without)[0])
        k += 1
    return k


def graph(seed, kind):
    rng = random.Random(seed)
    rows = [(rng.randrange(8), rng.randrange(90)) for _ in range(150)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200), (201, 202), (300, 301), (301, 302), (302, 300)]
    return [(f"{a:03}", f"{b:03}") if kind == "string" else (a, b) for a, b in rows]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_pairs_are_searched_without_a_shuffle(spark, kind):
    rows = graph(1, kind)
    near = adjacency(rows)
    df = spark.createDataFrame(rows, f"src {kind}, dst {kind}")
    for hops in (1, 3, 20):
        want = sorted((a, b, d) for a in near for b, d in search(near, a)[0].items() if a < b and d <= hops)
        got = G.shortest_paths(df, hops)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, G.shortest_paths(df, 3, 5).collect())) == sorted(map(tuple, G.shortest_paths(df, 3).collect()))
    assert G.shortest_paths(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_topology_beside_plain_searches(spark, kind):
    data = [(g, a, b) for g in (0, 1, None) for a, b in graph(g or 7, kind)]
    df = spark.createDataFrame(data, f"grp int, src {kind}, dst {kind}")
    got = {(r.grp, r.id): r for r in G.topology(df, batch=7).collect()}
    alone = {(r.grp, r.id): r for r in G.topology(df, most_edges=0).collect()}
    assert got.keys() == alone.keys()
    for g in (0, 1, None):
        near = adjacency([(a, b) for h, a, b in data if h == g])
        n, whole, told = len(near), parts(near), {s: search(near, s) for s in near}
        assert {i for h, i in got if h == g} == set(near)
        for v in near:
            between = sum(told[s][1][v] * told[v][1][t] / told[s][1][t] for s in near if s != v for t, d in told[s][0].items() if t not in (s, v) and v in told[s][0] and t in told[v][0] and told[s][0][v] + told[v][0][t] == d)
            total, reach, d = sum(told[v][0].values()), len(told[v][0]) - 1, len(near[v])
            links = sum(len(near[j] & near[v]) for j in near[v]) / 2
            extra = parts(near, v) - whole
            want = (d / (n - 1), between / ((n - 1) * (n - 2)), reach / total * reach / (n - 1) if total else 0, extra > 0, 2 * links / (d * (d - 1)) if d > 1 else 0, total / reach if reach else 0, extra)
            for r in (got[g, v], alone[g, v]):
                assert tuple(r)[2:] == pytest.approx(want, abs=1e-12)


def test_topology_of_a_large_group_takes_seconds(spark):
    rng = random.Random(3)
    rows = [(0, rng.randrange(50), rng.randrange(50, 4000)) for _ in range(20_000)]
    got = G.topology(spark.createDataFrame(rows, "grp int, src long, dst long"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 3900
    assert compact.MOST_EDGES > 600_000


def test_foundations_search_only_nodes_that_pass_on(spark):
    rng = random.Random(4)
    rows = [(i, j) for i in range(300) for j in rng.sample(range(300, 900), 2)] + [(i, rng.randrange(900, 1500)) for i in range(300, 600)] + [(0, 2000), (0, 2000), (2000, 2001)]
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b), near.setdefault(b, set())
    roots = set(near) - {b for _, b in rows}
    want = {r: len(search({k: v for k, v in near.items()}, r)[0]) - 1 for r in roots}
    got = G.shared_foundations(spark.createDataFrame(rows, "src long, dst long"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert len(roots) > 256 and {r.foundation: r.n for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_closure_is_searched_without_a_shuffle(spark, kind):
    rows = graph(5, kind) + graph(6, kind)[:40] + ([("zz", "zz")] if kind == "string" else [(999, 999)])
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b), out.setdefault(b, set())
    df = spark.createDataFrame(rows, f"src {kind}, dst {kind}")
    for depth in (1, 4, 30):
        got = G.closure(df, depth)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted((a, b, d) for a in out for b, d in search(out, a)[0].items() if 0 < d <= depth)
    assert sorted(map(tuple, G.closure(df, 2, 5).collect())) == sorted(map(tuple, G.closure(df, 2).collect()))
    assert G.closure(df.limit(0), 3).count() == 0


def test_edges_come_in_ranges(spark):
    rows = sorted({(a, b) for a, b in graph(7, "long") if a != b})
    df = spark.createDataFrame(rows, "src long, dst long")
    for both in (False, True):
        whole, parts = compact.gathered(df, both), compact.gathered(df, both, 7)
        assert all((x == y).all() for x, y in zip(whole, parts))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_common_neighbours_are_counted_without_a_join(spark, kind):
    rows = graph(8, kind)
    near = adjacency(rows)
    rng = random.Random(9)
    names = sorted(near) + [("zz" if kind == "string" else 999), None]
    pairs = sorted({(rng.choice(names[:8] + names[-2:]), rng.choice(names)) for _ in range(300)}, key=str)
    held, absent = pairs[::3], [p for k, p in enumerate(pairs) if k % 3]
    score = lambda p: len(near.get(p[0], set()) & near.get(p[1], set()))
    edges, *sides = (spark.createDataFrame(x, f"src {kind}, dst {kind}") for x in (rows, held, absent))
    told = compact.common_neighbours(G.cut(edges.where("src < dst").union(edges.where("src > dst").select("dst", "src")).distinct()), sides[0])
    assert sorted(((r[0], r[1], r[2]) for r in told.collect()), key=str) == sorted(((*p, float(score(p))) for p in held), key=str)
    want = sum((score(x) > score(y)) + (score(x) == score(y)) / 2 for x in held for y in absent) / len(held) / len(absent)
    for most in (10**6, 5):
        got = G.link_prediction(edges, *sides, most)
        assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == (most == 5)
        assert got.collect() == [(len(held), len(absent), pytest.approx(want))]
    assert G.link_prediction(edges.limit(0), *sides).collect() == [(len(held), len(absent), 0.5)]


def test_low_end_of_a_spectrum_with_hubs_is_quick():
    import time

    import numpy as np

    rng = np.random.default_rng(14)
    n, k = 60_000, 300
    src, dst = rng.integers(0, k, 8 * n), rng.integers(k, n, 8 * n)
    src, dst = np.append(src, np.arange(n - 1)), np.append(dst, np.arange(1, n))
    start = time.monotonic()
    low, high = G._ends_of_laplacian(n, src, dst, most_bytes=1)
    assert time.monotonic() - start < 20 and 0 < low < high
    # Paths have known ends, and so does a graph in two parts.
    path = G._ends_of_laplacian(50, np.arange(49), np.arange(1, 50))
    assert path == pytest.approx((2 - 2 * np.cos(np.pi / 50), 2 + 2 * np.cos(np.pi / 50)), abs=1e-7)
    assert G._ends_of_laplacian(5, np.array([0, 2, 3]), np.array([1, 3, 4])) == pytest.approx((0, 3), abs=1e-7)


def test_groups_are_taken_from_sorted_batches():
    import numpy as np
    import pyarrow as pa

    rows = sorted(((g, a, b) for g in range(4) for a, b in graph(g, "long")[: 50 + g]), key=lambda r: r[0])
    rows = [(None, 5, 6)] + rows
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 37])], names=["grp", "src", "dst"]) for i in range(0, len(rows), 37)]
    for block in (1, 1000):
        got = [(k, sorted(zip(n[a].tolist(), n[b].tolist()))) for k, n, a, b in compact.grouped(iter(batches), block)]
        assert got == [(g, sorted(r[1:] for r in rows if r[0] == g)) for g in (None, 0, 1, 2, 3)]
    starts, near = compact.neighbours(4, np.array([0, 1, 2, 1], np.int32), np.array([1, 0, 2, 3], np.int32))
    assert starts.tolist() == [0, 1, 3, 3, 4] and near.tolist() == [1, 0, 3, 1]
    assert [x.tolist() for x in compact.neighbours(0, *(np.zeros(0, np.int32),) * 2)] == [[0], []]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lin_of_few_terms_shuffles_no_pair(spark, kind):
    from ostrakon.operators import similarity as M

    rng = random.Random(15)
    rows = sorted({(f"{rng.randrange(60):02}" if kind == "string" else rng.randrange(60), rng.randrange(12)) for _ in range(500)})
    ic = {t: (12 - t) % 5 / 2 for t in range(12)}
    has = {}
    for e, t in rows:
        has.setdefault(e, set()).add(t)
    most = {e: max(ic[t] for t in ts) for e, ts in has.items()}
    want = {(a, b): 2 * max(ic[t] for t in has[a] & has[b]) / (most[a] + most[b]) if most[a] + most[b] > 0 else 0.0 for a in has for b in has if a < b and has[a] & has[b]}
    got = M.lin_similarity(spark.createDataFrame(rows, f"entity {kind}, item long"), "entity", "item", spark.createDataFrame(list(ic.items()), "item long, ic double"), tile=20)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): pytest.approx(r.lin) for r in got.collect()} == want and got.count() == len(want)
