"""Small hand-made cases and brute force for what SQL cannot express."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostrakon.functions import scalars as S
from ostrakon.operators import aggregates as A
from ostrakon.operators import graph as G
from ostrakon.operators import relational as R
from ostrakon.operators import similarity as M
from ostrakon.operators import stats as T
from ostrakon.operators import survival as V
from ostrakon.operators import walk as K
from ostrakon.plans import documents as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_kaplan_meier_fixture(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "t long, e int")
    assert [(r.t, round(r.survival, 9)) for r in V.kaplan_meier(df, "t", "e").orderBy("t").collect()] == [(1, 0.75), (3, 0.375), (4, 0.0)]
    assert V.median_survival(V.kaplan_meier(df, "t", "e"), "t").first()[0] == 3


@pytest.mark.parametrize("h,want", [((3, 2, 1), 1.0), ((1, 2, 3), 0.0), ((2, 2, 2), 0.5)])
def test_c_index_fixture(spark, h, want):
    df = spark.createDataFrame([(i + 1.0, 1, float(x)) for i, x in enumerate(h)], "t double, e int, h double")
    assert V.c_index(df, "t", "e", "h").first().c_index == want


def test_c_index_brute_force(spark):
    rng = random.Random(1)
    data = [(float(rng.randrange(40)), rng.randrange(2), float(rng.randrange(15))) for _ in range(300)]
    good = tie = n = 0
    for a in data:
        for b in data:
            if a[1] and a[0] < b[0]:
                n, good, tie = n + 1, good + (a[2] > b[2]), tie + (a[2] == b[2])
    got = V.c_index(spark.createDataFrame(data, "t double, e int, h double"), "t", "e", "h", 5).first()
    assert (got.concordant, got.tied, got.comparable) == (good, tie, n)


def breslow(data, k, penalty=0.0):
    x = np.array([d[2:] for d in data], float)
    x = x - x.mean(0)
    t, e = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    b = np.zeros(k)
    for _ in range(50):
        g, h = np.zeros(k), np.zeros((k, k))
        r = np.exp(x @ b)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            p = r[at] / r[at].sum()
            m = p @ x[at]
            g += x[i] - m
            h += (x[at] * p[:, None]).T @ x[at] - np.outer(m, m)
        b = b + np.linalg.solve(h + penalty * len(t) * np.eye(k), g - penalty * len(t) * b)
    return b, np.sqrt(np.diag(np.linalg.inv(h + penalty * len(t) * np.eye(k))))


def test_cox_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(float(rng.integers(1, 30)), int(rng.random() < 0.7), float(rng.normal()), float(rng.integers(0, 2))) for _ in range(120)]
    df = spark.createDataFrame(data, "t double, e int, a double, b double")
    for penalty in (0.0, 0.01):
        want, se = breslow(data, 2, penalty)
        got = V.cox(df, ["a", "b"], "t", "e", penalty).collect()
        assert np.allclose([r.coefficient for r in got], want, atol=1e-6) and np.allclose([r.se for r in got], se, atol=1e-5)


def test_cox_atlas_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    out = [(i, 0, float(rng.integers(1, 25)), int(rng.random() < 0.8)) for i in range(90)]
    held = [(0, i, k) for i in range(90) for k in ("x", "y") if rng.random() < 0.4]
    df = spark.createDataFrame(held, "g int, entity int, item string")
    outcomes = spark.createDataFrame(out, "entity int, g int, time double, event int")
    got = {r.item: r for r in V.cox_atlas(df, "g", "entity", ["item"], "time", "event", outcomes).collect()}
    for k in ("x", "y"):
        who = {i for _, i, j in held if j == k}
        b, se = breslow([(t, e, float(i in who)) for i, _, t, e in out], 1)
        assert abs(got[k].coefficient - b[0]) < 1e-6 and abs(got[k].se - se[0]) < 1e-5 and got[k].n_with == len(who)


def test_tails_against_series():
    assert abs(T.gamma_upper(0.5, 3.841458820694124 / 2) - 0.05) < 1e-9 and abs(T.gamma_upper(5, 18.307038053275146 / 2) - 0.05) < 1e-9
    assert abs(T.beta_regularised(5, 0.5, 10 / (10 + 2.2281388519649385**2)) - 0.05) < 1e-9
    for a, b, c, d in ((1, 9, 11, 3), (0, 5, 5, 0), (8, 2, 1, 5)):
        n, r, s = a + b + c + d, a + b, a + c
        p = {k: math.comb(r, k) * math.comb(n - r, s - k) / math.comb(n, s) for k in range(max(0, s - n + r), min(r, s) + 1)}
        assert abs(T.fisher_p(a, b, c, d) - sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))) < 1e-9
        assert abs(T.fisher_p(a, b, c, d, "less") - sum(v for k, v in p.items() if k <= a)) < 1e-9


def test_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2))
    y = x @ [1.5, -2] + 3 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c), int(c > 3)) for (a, b), c in zip(x, y)], "a double, b double, y double, z int")
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert np.allclose([r.estimate for r in T.least_squares(df, ["a", "b"], "y").collect()], want)
    est = {r.term: r.estimate for r in T.logistic(df.withColumn("n", F.col("a") + F.rand(1) * 4), ["n"], "z").collect()}
    assert est["n"] != 0


def test_entropy_and_set_fixtures(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b"), ("g", "c")], "g string, v string")
    assert A.entropy(df, ["g"], "v").first().entropy == 1.5
    one = spark.createDataFrame([([1, 2, 3], [2, 3, 4], [])], "a array<int>, b array<int>, c array<int>")
    r = one.select(M.jaccard(F.col("a"), F.col("b")), M.jaccard(F.col("a"), F.col("a")), M.jaccard(F.col("c"), F.col("c")), M.jaccard(F.col("c"), F.col("c"), None)).first()
    assert tuple(r) == (0.5, 1.0, 0.0, None)


def test_jaccard_join_loses_nothing(spark):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for i in range(60)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "e int, x int")
    for th in (0.3, 0.5, 0.75, 1.0):
        want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= th * len(sets[a] | sets[b]) - 1e-12}
        assert {(r.a, r.b) for r in M.jaccard_join(df, "e", "x", th).collect()} == want


def test_range_join_fixture(spark):
    points = spark.createDataFrame([(15, 35), (35, 15), (9, 35)], "x int, y int")
    boxes = spark.createDataFrame([(10, 20, 30, 40)], "x1 int, x2 int, y1 int, y2 int")
    assert {(r.x, r.y): r.hit for r in R.in_boxes(points, boxes, bin_size=7.0).collect()} == {(15, 35): True, (35, 15): True, (9, 35): False}


def test_tiered_lookup_fixture(spark):
    df = spark.createDataFrame([("a", "b"), ("z", "z")], "p string, q string")
    lv = lambda rows_: spark.createDataFrame(rows_, "q string, v double")
    got = R.tiered_lookup(df, [(spark.createDataFrame([], "p string, v double"), ["p"], "v"), (lv([("b", 0.4)]), ["q"], "v"), (lv([("b", 0.9)]), ["q"], "v")], "out")
    assert {r.p: (r.out, r.tier) for r in got.collect()} == {"a": (0.4, 2), "z": (0.0, 0)}


def test_graph_fixtures(spark):
    star = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src long, dst long")
    assert {r.id: r.paths for r in G.two_paths(star).collect()}[2] == 3
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {(r.a, r.b): r.distance for r in G.shortest_paths(path).collect()}[1, 4] == 3
    two = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (1, 3, 0), (3, 4, 0), (4, 5, 0), (5, 6, 0), (4, 6, 0)], "src long, dst long, grp int")
    by = {}
    for r in G.communities(two).collect():
        by.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [[1, 2, 3], [4, 5, 6]]
    t = {r.id: r for r in G.topology(two).collect()}
    assert t[3].articulation and not t[1].articulation and abs(t[3].betweenness - 2 * 6 / 20) < 1e-9 and t[3].extra_components == 1
    assert abs(t[1].closeness - 5 / (1 + 1 + 2 + 3 + 3)) < 1e-9
    with pytest.raises(ValueError):
        G.levels(spark.createDataFrame([(1, 2), (2, 1), (0, 1)], "src long, dst long"), 5)


def test_units_chain_and_modes(spark):
    df = spark.createDataFrame([(30.0, "minute", "hour"), (3.0, "foot", "inch"), (1.0, "hour", "inch")], "v double, a string, b string")
    assert [round(x, 9) if x is not None else None for (x,) in S.convert(df, "v", "a", "b").select("converted").collect()] == [0.5, 36.0, None]
    steps = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(v).alias("value")) for o, v in (("subtract", 3.0), ("subtract", 4.0), ("multiply", 2.0))))
    assert spark.range(1).select(S.fold_chain(F.lit(16), steps)).first()[0] == 18
    mode = spark.range(1).select(K.combined_shift(F.lit("redundant"), F.lit(-0.5), F.lit(0.2)), K.combined_shift(F.lit("independent"), F.lit(1.0), F.lit(2.0))).first()
    assert tuple(mode) == (-0.5, 3.0)


def test_chunks_hold_the_text():
    text = "\n\n".join("abcdefghij" * k for k in (3, 1, 30, 2, 9))
    parts = D.pack_paragraphs(text, 100, 0)
    assert all(len(p) <= 100 for p in parts) and "".join(p.replace("\n\n", "") for p in parts) == text.replace("\n\n", "")
    lap = D.pack_paragraphs(text, 100, 10)
    assert all(len(p) <= 100 for p in lap) and all(b.startswith(a[-10:]) for a, b in zip(lap, lap[1:]))
    assert D.pack_paragraphs("", 100, 10) == []


def test_sections_pop_deeper_levels(spark):
    lines = ["# A", "x", "## B", "y", r"\section{C}", "z", "## D", "w"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "d int, pos int, line string")
    got = {r.pos: list(r.section_path) for r in D.sections(df, "d", "pos", "line").collect()}
    assert got[1] == ["A"] and got[3] == ["A", "B"] and got[5] == ["C"] and got[7] == ["C", "D"]


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 3, 9, 3)], "v double")
    assert sorted((r.v, r.r) for r in A.average_rank(df, "v", "r").collect()) == [(1, 1), (3, 3), (3, 3), (3, 3), (5, 5), (9, 6)]
    big = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)).cast("double"))
    ranked = A.global_rank(big, ["v", "id"], "r").collect()
    assert [r.r for r in sorted(ranked, key=lambda r: (r.v, r.id))] == list(range(1, 1001))


def test_shards_of_turned_pairs(spark):
    from ostrakon.operators import relational as R

    rows = [("x", 2, "y", 1, "n"), ("y", 1, "x", 2, "m"), ("p", 3, "q", 3, "n"), ("q", 3, "p", 3, "n"), (None, 1, "z", 2, "n"), ("u", None, "z", 2, "n"), ("v", 5, "w", 4, None)]
    df = spark.createDataFrame(rows, "g_a string, c_a int, g_b string, c_b int, note string")
    got = lambda done=None: sorted(map(tuple, R.oriented_shards(df, "c", "g", done).collect()), key=str)
    assert got() == [("p", 3, "q", 3, "n"), ("q", 3, "p", 3, "n"), ("w", 4, "v", 5, None), ("y", 1, "x", 2, "m")]
    assert got(spark.createDataFrame([(1, 2), (3, 3)], "c_a int, c_b int")) == [("w", 4, "v", 5, None)]
    assert R.oriented_shards(df.limit(0), "c", "g").isEmpty()


def test_verified_transposes_score_shared_methods_and_refs(spark):
    from ostrakon.operators import similarity as M

    pairs = spark.createDataFrame([("s", 1, 2, 3), ("s", 1, 3, 2), ("s", 2, 9, 4)], "sig string, a int, b int, gap int")
    users = spark.createDataFrame([(1, ["m", "n"], ["r"]), (2, ["n", "m", "k"], ["r", "q"]), (3, None, [])], "u int, m array<string>, r array<string>")
    got = sorted(map(tuple, M.verified_transposes(pairs, users, "u", "m", "r").collect()))
    assert got == [("s", 1, 2, 3, 2, 1, 8), ("s", 1, 3, 2, 0, 0, 2), ("s", 2, 9, 4, 0, 0, 4)]


def test_pairs_of_a_large_group_are_joined_by_tiles(spark):
    from ostrakon.operators import relational as R

    rows = [("hub", i, i % 3) for i in range(40)] + [("hub", 7, 1), ("small", 1, 0), ("small", 2, 0), ("one", 5, 0), (None, 1, 0), (None, 2, 0), ("small", None, 0)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = [tuple(r) for r in R.pairs_within(df, ["g"], "i", ["v"], tile=6).select("g", "a", "b", "v_a", "v_b").collect()]
    assert sorted(got) == sorted([("hub", a, b, a % 3, b % 3) for a in range(40) for b in range(a + 1, 40)] + [("small", 1, 2, 0, 0)])
    assert sorted(got) == sorted(tuple(r) for r in R.pairs_within(df, ["g"], "i", ["v"]).select("g", "a", "b", "v_a", "v_b").collect())
    assert R.pairs_within(df.limit(0), ["g"], "i").columns == ["g", "a", "b"]
