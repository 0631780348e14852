"""Property-graph operators on edge tables (src, dst, ...).

Iterations are joins; each step is written to the shared folder, so plans stay
short and a lost executor costs a reread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import compact
from .relational import small

# --- shape ----------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def typed_nodes(label: str, df: DataFrame, key: str) -> DataFrame:
    """id, label, props (strings), num_props (numbers) from a flat table."""
    numbers = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    texts = [c for c, t in df.dtypes if c != key and t == "string"]
    pairs = lambda cs, t: F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(c).cast(t)) for c in cs))) if cs else F.lit(None).cast(f"map<string,{t}>")
    return df.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), pairs(texts, "string").alias("props"), pairs(numbers, "double").alias("num_props"))


def typed_edges(kind: str, df: DataFrame, src: str, dst: str, value: str | None = None, source: str = "load") -> DataFrame:
    """src, dst, etype, value, source, deprecated."""
    return df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(kind).alias("etype"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"), F.lit(source).alias("source"), F.lit(False).alias("deprecated"))


def schema_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, property (numbers only), n: what the graph holds."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.explode_outer(F.map_keys("num_props")).alias("property")).groupBy("kind", "name", "property").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(F.lit("edge").alias("kind"), F.col("etype").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("kind", "name", F.lit("value").alias("property"), "n")
    return n.unionByName(e)


def edge_features(edges: DataFrame, kinds: Sequence[str], scale: float = 1000.0) -> DataFrame:
    """a, b (a < b), for each kind: exists flag and value (log1p / 10 above 1, held below 1)."""
    v = F.max(F.col("value"))
    shaped = lambda k: F.least(F.when(F.max(F.when(F.col("etype") == k, F.col("value"))) > 1, F.log1p(F.max(F.when(F.col("etype") == k, F.col("value")))) / 10).otherwise(F.max(F.when(F.col("etype") == k, F.col("value")))), F.lit(1.0))
    del v
    features = [x for k in kinds for x in (F.max((F.col("etype") == k).cast("double")), F.coalesce(shaped(k), F.lit(0.0)))]
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "etype", "value").groupBy("a", "b").agg(F.array(*features).alias("features"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: distinct neighbours, undirected."""
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def group_degrees(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """id, degree, same, groups_reached: neighbours, those of the own group, and groups among them; ``groups`` has id, grp."""
    e = undirected(edges).join(groups.select(F.col("id").alias("src"), F.col("grp").alias("g1")), "src", "left").join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("g2")), "dst", "left")
    return e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("g1") == F.col("g2")).alias("same"), F.countDistinct("g2").alias("groups_reached"))


def two_paths(edges: DataFrame) -> DataFrame:
    """id, paths, relative: shortest detours a - id - b (a < b), d (d - 1) / 2 of them, over the maximum.

    The count follows from the degree, so no path is formed.
    """
    d = degrees(edges).select("id", (F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("paths"))
    return d.crossJoin(F.broadcast(d.agg(F.max("paths").alias("m")))).select("id", "paths", F.when(F.col("m") > 0, F.col("paths") / F.col("m")).otherwise(0.0).alias("relative"))


def channel_profile(edges: DataFrame, groups: DataFrame, classes: int) -> DataFrame:
    """id, grp, share of neighbours in it, entropy weight 1 + (Hmax - H) / Hmax of the profile."""
    e = undirected(edges).join(groups.select(F.col("id").alias("dst"), "grp"), "dst").groupBy(F.col("src").alias("id"), "grp").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id")
    s = e.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("h", F.sum(-F.col("share") * F.log2("share")).over(w))
    most = float(np.log2(classes))
    return s.select("id", "grp", "share", (1 + (most - F.col("h")) / most).alias("weight"))


def hubs(edges: DataFrame, groups: DataFrame, k: int = 3) -> DataFrame:
    """The k nodes of a group with most neighbours inside it (ties by id)."""
    inside = group_degrees(edges, groups).join(groups, "id")
    w = Window.partitionBy("grp").orderBy(F.desc("same"), "id")
    return inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("grp", "id", "same", "rank")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: counts of nodes by label and edges by type."""
    return nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "name", "n").unionByName(edges.groupBy(F.col("etype").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "name", "n"))


def profile(node: str, edges: DataFrame) -> DataFrame:
    """Everything about one node: direction, edge type, neighbour, value."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), "etype", F.col("dst").alias("other"), "value")
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), "etype", F.col("src").alias("other"), "value"))


# --- reachability -----------------------------------------------------------------


#: Sources that travel in one row of a search, as bits of so many longs.
_WORDS = 4


def _layers(e: DataFrame, sources: DataFrame, hops: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The nodes that each hop over ``e`` reaches anew (id, block, distance, words of bits), the numbered sources (source, block, p), and the words' names."""
    keys = cut(sources.where("source IS NOT NULL").select("source").distinct().sort("source").withColumn("k", F.monotonically_increasing_id()), "sources")
    keys = keys.select("source", F.expr(f"k div {64 * _WORDS}").alias("block"), (F.col("k") % (64 * _WORDS)).cast("int").alias("p"))
    words = [f"w{i}" for i in range(_WORDS)]
    bit = F.expr("shiftleft(1L, p % 64)")
    seen = front = cut(keys.select(F.col("source").alias("id"), "block", *(F.when(F.expr(f"p div 64 = {i}"), bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words))), "front")
    layers = front.withColumn("distance", F.lit(0))
    for hop in range(1, hops + 1):
        nxt = front.join(e, front["id"] == e["src"]).groupBy(F.col("dst").alias("id"), "block").agg(*(F.bit_or(w).alias(w) for w in words))
        old = seen.select("id", "block", *(F.col(w).alias(f"s{w}") for w in words))
        new = nxt.join(old, ["id", "block"], "left").select("id", "block", *(F.expr(f"{w} & ~coalesce(s{w}, 0L)").alias(w) for w in words))
        front = cut(new.where(" OR ".join(f"{w} <> 0" for w in words)), "front")
        if front.isEmpty():
            break
        layers = layers.unionByName(front.withColumn("distance", F.lit(hop)))
        if hop < hops:
            seen = cut(seen.unionByName(front).groupBy("id", "block").agg(*(F.bit_or(w).alias(w) for w in words)), "seen")
    return layers, keys, words


def bfs(edges: DataFrame, sources: DataFrame, hops: int = 6, directed: bool = False) -> DataFrame:
    """source, id, distance: shortest distances up to ``hops``; ``sources`` has a column source.

    Sources are numbered in their order and travel as bits, 256 a row: a step
    joins, merges and stores one row for a node and all of its block's sources.
    """
    e = cut(edges.select("src", "dst").distinct() if directed else undirected(edges), "edges")
    layers, keys, words = _layers(e, sources, hops)
    names = small(keys.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "source"))), lambda x: x["source"]).alias("names")), 10_000)
    word = F.expr("CASE p div 64 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(words)) + " END")
    told = layers.join(names, "block").select("id", "distance", *words, F.posexplode("names").alias("p", "source"))
    return told.withColumn("w", word).where("(shiftrightunsigned(w, p % 64) & 1L) = 1").select("source", "id", "distance")


def shortest_paths(edges: DataFrame, hops: int = 6, most_edges: int = compact.MOST_REACHED) -> DataFrame:
    """a, b (a < b), distance for all pairs within ``hops``, undirected.

    Up to ``most_edges`` edges are sent to the tasks, which search in memory and tell the pairs; more are joined.
    """
    e = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "pairs")
    if e.count() <= most_edges:
        return compact.reached(e, hops, both=True)
    nodes = undirected(e).select(F.col("src").alias("source")).distinct()
    return bfs(e, nodes, hops).where("source < id").select(F.col("source").alias("a"), F.col("id").alias("b"), "distance")


def neighbourhood(edges: DataFrame, node, hops: int = 1) -> DataFrame:
    """The edges among nodes within ``hops`` of one node."""
    spark = edges.sparkSession
    near = bfs(edges, spark.range(1).select(F.lit(node).cast(edges.schema["src"].dataType).alias("source")), hops).select("id")
    return edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def closure(edges: DataFrame, depth: int = 10, most_edges: int = compact.MOST_REACHED) -> DataFrame:
    """id, ancestor, distance along directed edges up to ``depth``.

    Up to ``most_edges`` edges are sent to the tasks, which search in memory and tell the pairs; more (or ends that are null) are joined.
    """
    e = cut(edges.where("src IS NOT NULL").select("src", "dst").distinct(), "pairs")
    if e.count() <= most_edges and e.where("dst IS NULL").isEmpty():
        return compact.reached(e, depth, both=False).select(F.col("a").alias("id"), F.col("b").alias("ancestor"), "distance")
    sources = e.select(F.col("src").alias("source")).distinct()
    return bfs(e, sources, depth, directed=True).where("distance > 0").select(F.col("source").alias("id"), F.col("id").alias("ancestor"), "distance")


def dependency_edges(edges: DataFrame, node, depth: int = 10) -> DataFrame:
    """node, etype, target: every out-edge of each node reached, cyclic ones too."""
    spark = edges.sparkSession
    reached = bfs(edges, spark.range(1).select(F.lit(node).cast(edges.schema["src"].dataType).alias("source")), depth - 1, directed=True).select(F.col("id").alias("src"))
    return edges.join(reached, "src", "left_semi").select(F.col("src").alias("node"), "etype", F.col("dst").alias("target"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the least id): alternating large and small stars, so rounds grow with the logarithm of the size."""
    now = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).collect()[0])
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def chains(edges: DataFrame, category: DataFrame, hops: int = 3, least_gap: int = 3, most: int = 5000) -> DataFrame:
    """Simple paths of up to ``hops`` edges whose ends' category sets differ by at least ``least_gap``: path, gap.

    ``category`` has id, cats (array).  The cap is part of the report; the
    order that it follows is gap (falling), then path.  Starts are taken in
    their order, batch by batch, until no later path can enter the report.
    """
    e = cut(undirected(edges), "edges")
    sets = category.select(F.array_sort(F.array_distinct("cats")).alias("c")).distinct()
    gap_of = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    if sets.limit(1001).count() <= 1000:
        bound = sets.crossJoin(sets.select(F.col("c").alias("d"))).agg(F.max(gap_of("c", "d"))).first()[0]
    else:
        bound = 2 * sets.agg(F.max(F.size("c"))).first()[0]
    told = category.select(F.col("id").alias("end"), F.col("cats").alias("cb"))
    last = cut(e.join(told, e["dst"] == told["end"]).select("src", "end", "cb"), "ends")
    starts = cut(category.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi"), "starts")
    best, worst, done, batch = None, least_gap - 1, None, 8
    while bound is not None and worst < bound:
        left = starts if done is None else starts.where(F.col("id") > done)
        until = left.select("id").distinct().orderBy("id").limit(batch).agg(F.max("id")).first()[0]
        if until is None:
            break
        now = left.where(F.col("id") <= until).select(F.array("id").alias("path"), F.col("id").alias("at"), F.col("cats").alias("ca"))
        found = None
        for hop in range(hops):
            ends = now.join(last, now["at"] == last["src"]).where((F.element_at("path", 1) < F.col("end")) & ~F.array_contains("path", F.col("end")))
            ends = ends.select(F.concat("path", F.array("end")).alias("path"), gap_of("ca", "cb").alias("gap")).where(F.col("gap") > worst)
            found = ends if found is None else found.unionByName(ends)
            if hop + 1 < hops:
                now = now.join(e, now["at"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), "ca")
        best = cut((found if best is None else found.unionByName(best)).orderBy(F.desc("gap"), "path").limit(most), "best")
        n, low = best.agg(F.count(F.lit(1)), F.min("gap")).first()
        # Paths of later starts come after: once the report is full, only a wider gap gets in.
        worst, done, batch = low if n == most else worst, until, 4 * batch
    if best is None:
        return e.select(F.array("src").alias("path"), F.lit(0).alias("gap")).limit(0)
    return best.orderBy(F.desc("gap"), "path").limit(most)


def levels(edges: DataFrame, most: int = 1000) -> DataFrame:
    """id, level of a DAG: the longest path from a node without incoming edges."""
    e = cut(edges.select("src", "dst").distinct(), "dag")
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    now = cut(nodes.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(0)), "level")
    done = now
    for level in range(1, most):
        now = cut(now.join(e, now["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().withColumn("level", F.lit(level)), "level")
        if now.isEmpty():
            return done.groupBy("id").agg(F.max("level").alias("level"))
        done = cut(done.unionByName(now).groupBy("id").agg(F.max("level").alias("level")), "levels")
    raise ValueError("the graph has a cycle or is deeper than allowed")


def proof_chain(edges: DataFrame, target) -> DataFrame:
    """id, level of all ancestors of a target and itself, in a topological order; foundations have level 0."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spark = edges.sparkSession
    above = bfs(back, spark.range(1).select(F.lit(target).cast(edges.schema["src"].dataType).alias("source")), 1000, directed=True).select("id")
    inner = edges.join(above.select(F.col("id").alias("src")), "src", "left_semi").join(above.select(F.col("id").alias("dst")), "dst", "left_semi")
    return above.join(levels(inner), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def shared_foundations(edges: DataFrame) -> DataFrame:
    """foundation, n: how many nodes rest on each node that rests on nothing (edges point from the foundation).

    Nodes without out-edges pass nothing on, so the search runs on the edges
    among the others; the rest are joined once, at the end, and their bits counted.
    """
    import pyarrow as pa

    e = cut(edges.select("src", "dst").distinct(), "edges")
    starts = cut(e.select(F.col("src").alias("source")).distinct(), "starts")
    inner = cut(e.join(small(starts.select(F.col("source").alias("dst"))), "dst", "left_semi").select("src", "dst"), "inner")
    roots = starts.join(inner.select(F.col("dst").alias("source")).distinct(), "source", "left_anti")
    layers, keys, words = _layers(inner, roots, 1000)
    reach = cut(layers.groupBy("id", "block").agg(*(F.bit_or(w).alias(w) for w in words)), "reach")
    rest = e.join(small(reach), F.col("src") == F.col("id")).groupBy("dst", "block").agg(*(F.bit_or(w).alias(w) for w in words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            block = batch.column(0).to_numpy()
            bits = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for b in np.unique(block):
                own = np.ascontiguousarray(bits[block == b]).view(np.uint8)
                sums[int(b)] = sums.get(int(b), 0) + np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64)
        for b, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["block", "p", "n"])

    counts = rest.select("block", *words).mapInArrow(run, "block long, p int, n long").groupBy("block", "p").agg(F.sum("n").alias("n"))
    return keys.join(counts, ["block", "p"]).select(F.col("source").alias("foundation"), "n")


# --- structure -----------------------------------------------------------------------


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c with a < b < c.  Edges point from the smaller degree, so no hub is squared."""
    e = undirected(edges)
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    out = cut(both.where("d < d2 OR (d = d2 AND src < dst)").select("src", "dst"), "oriented")
    wedge = out.alias("x").join(out.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("u"), F.col("x.dst").alias("v"), F.col("y.dst").alias("w"))
    closed = wedge.join(out.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w")), ["v", "w"])
    s = F.array_sort(F.array("u", "v", "w"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    out = degrees(edges).join(t, "id", "left").fillna(0, ["triangles"])
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def mixed_triangles(edges: DataFrame, least_kinds: int = 2) -> DataFrame:
    """a, b, n: triangles over an edge whose three sides have at least so many types."""
    kinds = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "etype").where("a <> b").groupBy("a", "b").agg(F.collect_set("etype").alias("k"))
    t = triangles(edges)
    for x, y, name in (("a", "b", "k1"), ("a", "c", "k2"), ("b", "c", "k3")):
        t = t.join(kinds.select(F.col("a").alias(x), F.col("b").alias(y), F.col("k").alias(name)), [x, y])
    good = t.where(F.size(F.array_union(F.array_union("k1", "k2"), "k3")) >= least_kinds)
    sides = good.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("a"), F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("s"))
    return sides.groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("n"))


def diversity(edges: DataFrame) -> DataFrame:
    """types, pairs: how many pairs have so many types of edges."""
    per = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "etype").groupBy("a", "b").agg(F.countDistinct("etype").alias("types"))
    return per.groupBy("types").agg(F.count(F.lit(1)).alias("pairs"))


def propagate(edges: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 5) -> DataFrame:
    """id, value after x <- (1 - d) x0 + d A'x, A row-normalised by weight; ``start`` has id, value; edges src, dst, weight."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("__t"))
    e = cut(edges.join(out, "src").where("__t > 0").select("src", "dst", (F.col("weight") / F.col("__t")).alias("w")), "walk")
    nodes = start.select("id").unionByName(e.select(F.col("src").alias("id"))).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    base = cut(nodes.join(start, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("v0")), "start")
    now = base.select("id", F.col("v0").alias("value"))
    for _ in range(rounds):
        got = e.join(now, e["src"] == now["id"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("value")).alias("g"))
        now = cut(base.join(got, base["id"] == got["dst"], "left").select("id", ((1 - damping) * F.col("v0") + damping * F.coalesce("g", F.lit(0.0))).alias("value")), "rank")
    return now


def _adjacency(pdf: pd.DataFrame) -> tuple[list, list[set]]:
    names = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {n: i for i, n in enumerate(names)}
    near: list[set] = [set() for _ in names]
    for s, d in zip(pdf["src"], pdf["dst"]):
        if s != d:
            near[at[s]].add(at[d])
            near[at[d]].add(at[s])
    return names, near


def communities(edges: DataFrame, most_size: int = 25) -> DataFrame:
    """grp, id, community: greedy modularity within each group (edges need a column grp).

    Communities above ``most_size`` split into their components or, if
    connected, into halves by degree.  Groups are subgraphs of channels, small
    by nature; each is one task.  Merges come from a heap, the smaller side moves.
    """
    kind = edges.schema["src"].dataType.simpleString()
    grp = edges.schema["grp"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf)
        m2 = sum(map(len, near)) or 1
        # A community is known by the place of its larger part and named by its least member.
        member = {i: {i} for i in range(len(names))}
        weight = {i: dict.fromkeys(near[i], 1.0) for i in member}
        degree = [float(len(x)) for x in near]
        least = list(member)

        def gain(i: int, j: int) -> tuple:
            a, b = sorted((least[i], least[j]))
            return -(2 * (weight[i][j] / m2 - degree[i] * degree[j] / m2**2)), a, b, i, j

        heap = [gain(i, j) for i in weight for j in weight[i] if i < j]
        heapq.heapify(heap)
        while heap:
            # Gains fall as communities grow, unless edges join them: an entry is a bound, looked at anew when it comes up.
            top = heapq.heappop(heap)
            i, j = top[3:]
            if i not in weight or j not in weight[i]:
                continue
            now = gain(i, j)
            if now != top:
                if now > top:
                    heapq.heappush(heap, now)
                continue
            if -top[0] <= 1e-12:
                break
            if len(weight[i]) < len(weight[j]):
                i, j = j, i
            member[i] |= member.pop(j)
            degree[i] += degree[j]
            least[i] = min(least[i], least[j])
            for k, w in weight.pop(j).items():
                weight[k].pop(j, None)
                if k != i:
                    weight[i][k] = weight[i].get(k, 0.0) + w
                    weight[k][i] = weight[i][k]
                    heapq.heappush(heap, gain(i, k))
        final: list[list[int]] = []
        for c in member.values():
            parts = [sorted(c)]
            if len(c) > most_size:
                parts, left = [], set(c)
                while left:
                    stack = [next(iter(left))]
                    part = set(stack)
                    left -= part
                    while stack:
                        new = near[stack.pop()] & left
                        left -= new
                        part |= new
                        stack.extend(new)
                    parts.append(sorted(part))
                parts.sort()
                if len(parts) == 1:
                    order = sorted(c, key=lambda i: (-len(near[i]), i))
                    parts = [order[: len(order) // 2], order[len(order) // 2 :]]
            final += parts
        rows = [(key[0], names[i], k) for k, p in enumerate(sorted(final, key=min)) for i in p]
        return pd.DataFrame(rows, columns=["grp", "id", "community"])

    return edges.groupBy("grp").applyInPandas(run, f"grp {grp}, id {kind}, community int")


def topology(edges: DataFrame, most_edges: int = compact.MOST_EDGES, batch: int = 64) -> DataFrame:
    """grp, id, degree and betweenness and closeness centrality, articulation flag, clustering, mean path, extra components on removal.

    Exact, by group (a column grp): subgraphs of channels.  Up to ``most_edges``
    edges in all are sent to the tasks, which share the sources of a group, ``batch``
    at a time; beyond that a group is one task.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, grp = (edges.schema[c].dataType.simpleString() for c in ("src", "grp"))

    def searched(n: int, starts: np.ndarray, near: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, ...]:
        between, reach, total = compact.central(starts, near, sources)
        return between / ((n - 1) * (n - 2) if n > 2 else 1), np.where(total > 0, reach / np.maximum(total, 1) * reach / max(1, n - 1), 0.0), np.where(total > 0, total / np.maximum(reach, 1), 0.0)

    def shape(n: int, starts: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
        d, extra = np.diff(starts), compact.extra_components(starts, near)
        return d / max(1, n - 1), extra > 0, np.where(d > 1, 2 * compact.links(starts, near) / np.maximum(d * (d - 1), 1), 0.0), extra

    e = cut(edges.select("grp", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "groups")
    if e.count() > most_edges:

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            names, a, b = compact.numbered(*(pa.chunked_array([pa.array(pdf[c])]) for c in ("src", "dst")))
            n = len(names)
            starts, near = compact.neighbours(n, a, b)
            between, close, mean = np.zeros(n), np.zeros(n), np.zeros(n)
            for i in range(0, n, batch):
                share, close[i : i + batch], mean[i : i + batch] = searched(n, starts, near, np.arange(i, min(n, i + batch)))
                between += share
            degree, cuts, clustering, extra = shape(n, starts, near)
            return pd.DataFrame({"grp": [key[0]] * n, "id": names, "degree": degree, "betweenness": between, "closeness": close, "articulation": cuts, "clustering": clustering, "mean_path": mean, "extra_components": extra})

        return e.groupBy("grp").applyInPandas(run, f"grp {grp}, id {kind}, degree double, betweenness double, closeness double, articulation boolean, clustering double, mean_path double, extra_components int")
    spark, found = edges.sparkSession, e.toArrow()
    names, of = found.schema.field("src").type, found.schema.field("grp").type
    graphs, work = [], []
    for key in found.column("grp").unique():
        one = found.filter(pc.equal(found["grp"], key) if key.is_valid else pc.is_null(found["grp"]))
        nodes, a, b = compact.numbered(one["src"], one["dst"])
        work += [(len(graphs), i) for i in range(-1, -(-len(nodes) // batch))]
        graphs.append((key.as_py(), nodes, *compact.neighbours(len(nodes), a, b)))
    shared = spark.sparkContext.broadcast((graphs, work))
    del found, graphs

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, work = shared.value
        columns = ["g", "at", "grp", "id", "degree", "betweenness", "closeness", "articulation", "clustering", "mean_path", "extra_components"]
        kinds = [pa.int32(), pa.int32(), of, names, pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.int32()]

        def told(rows: int, **given) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(rows, k) for c, k in zip(columns, kinds)], names=columns)

        sums: dict[int, np.ndarray] = {}
        for g, i in (work[k] for b in batches for k in b.column(0).to_pylist()):
            key, nodes, starts, near = graphs[g]
            n = len(nodes)
            if i < 0:
                degree, cuts, clustering, extra = shape(n, starts, near)
                yield told(n, g=np.full(n, g), at=np.arange(n), grp=[key] * n, id=nodes, degree=degree, articulation=cuts, clustering=clustering, extra_components=extra)
                continue
            sources = np.arange(i * batch, min(n, (i + 1) * batch))
            share, close, mean = searched(n, starts, near, sources)
            sums[g] = sums.get(g, 0.0) + share
            yield told(len(sources), g=np.full(len(sources), g), at=sources, closeness=close, mean_path=mean)
        for g, share in sums.items():
            yield told(len(share), g=np.full(len(share), g), at=np.arange(len(share)), betweenness=share)

    rows = compact.turns(spark, len(work)).mapInArrow(turn, f"g int, at int, grp {grp}, id {kind}, degree double, betweenness double, closeness double, articulation boolean, clustering double, mean_path double, extra_components int")
    whole = {c: (F.sum if c == "betweenness" else F.max)(c).alias(c) for c in rows.columns[2:]}
    return rows.groupBy("g", "at").agg(*whole.values()).drop("g", "at")


def _ends_of_laplacian(n: int, src: np.ndarray, dst: np.ndarray, most_bytes: int = 1 << 28) -> tuple[float, float]:
    """lambda2 and lambdamax of a graph's Laplacian: each from a growing subspace beside the constant vector, restarted at ``most_bytes``.

    The low end takes its new directions over the degrees, so hubs don't slow it.
    """
    starts, near = compact.neighbours(n, src, dst)
    degree, some = np.diff(starts).astype(float), np.flatnonzero(np.diff(starts))
    first = starts[some]
    parts = np.unique(np.append(np.searchsorted(first, np.arange(0, starts[-1], 1 << 18)), len(some)))

    def times(x: np.ndarray) -> np.ndarray:
        out = degree * x
        for i, j in zip(parts, parts[1:]):
            end = first[j] if j < len(some) else starts[-1]
            out[some[i:j]] -= np.add.reduceat(x[near[first[i] : end]], first[i:j] - first[i])
        return out

    m = int(min(n - 1, max(12, most_bytes // (8 * n)), 60))
    keep, rng = max(1, min(6, m // 3)), np.random.default_rng(42)

    def end(low: bool, most: float) -> float:
        basis, product, k = np.empty((m, n)), np.zeros((m, m)), 0
        scale = np.maximum(degree, 1) if low else np.ones(n)
        new = rng.standard_normal(n) / np.sqrt(scale)
        for _ in range(20_000):
            for _ in range(2):
                new -= new.mean()
                new -= basis[:k].T @ (basis[:k] @ new)
                new /= np.linalg.norm(new)
            basis[k] = new
            product[k, : k + 1] = product[: k + 1, k] = basis[: k + 1] @ times(new)
            k += 1
            values, vectors = np.linalg.eigh(product[:k, :k])
            at = 0 if low else k - 1
            now = vectors[:, at] @ basis[:k]
            off = times(now)
            off -= values[at] * now
            if np.linalg.norm(off) <= 1e-8 * (most or values[at]) or m == k == n - 1:
                return float(values[at])
            if k == m:
                best = slice(0, keep) if low else slice(k - keep, k)
                for i in range(0, n, 1 << 16):
                    basis[:keep, i : i + (1 << 16)] = vectors[:, best].T @ basis[:, i : i + (1 << 16)]
                product[:], k = 0.0, keep
                product[range(k), range(k)] = values[best]
            new = off / scale
        raise ValueError("the spectrum of a group did not converge")

    high = end(False, 0.0)
    return end(True, high), high


def coherence(edges: DataFrame, most_dense: int = 1500) -> DataFrame:
    """grp, n, coherence: 1 - lambda2 / lambdamax of the Laplacian of each group's subgraph (0 below three nodes).

    Groups of more than ``most_dense`` nodes keep their edges alone, not a square matrix; each group is one task.
    """
    import pyarrow as pa

    grp, of = edges.schema["grp"].dataType.simpleString(), edges.select("grp").limit(0).toArrow().schema.field("grp").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, names, src, dst in compact.grouped(batches):
            n, low, high = len(names), 0.0, 0.0
            if n > most_dense and (src != dst).any():
                low, high = _ends_of_laplacian(n, src, dst)
            elif n > 2:
                lap = np.zeros((n, n))
                lap[src, dst] = lap[dst, src] = -1
                np.fill_diagonal(lap, 0)
                values = np.linalg.eigvalsh(lap - np.diag(lap.sum(1)))
                low, high = values[1], values[-1]
            told = pa.array([n], pa.int32()), pa.array([float(1 - low / high) if high > 0 else 0.0])
            yield pa.RecordBatch.from_arrays([pa.array([key], of), *told], names=["grp", "n", "coherence"])

    rows = edges.select("grp", "src", "dst").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(run, f"grp {grp}, n int, coherence double")


#: Weights of the composite confidence; fixed values.
CONFIDENCE = {"spectral": 0.20, "bootstrap": 0.15, "triangle": 0.15, "provenance": 0.15, "link": 0.25, "coherence": 0.10}


def provenance_share(mean_types: Column) -> Column:
    """The provenance part of the composite confidence: the mean number of evidence types of an edge, full at three."""
    return F.least(mean_types / 3, F.lit(1.0))


def composite_confidence(df: DataFrame) -> DataFrame:
    """Adds ``confidence``: the weighted sum of six columns in 0 to 1; missing ones count 0."""
    return df.withColumn("confidence", sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in CONFIDENCE.items()), F.lit(0.0)))


def link_prediction(edges: DataFrame, held_out: DataFrame, absent: DataFrame, most_edges: int = compact.MOST_REACHED) -> DataFrame:
    """n1, n2, auc of common neighbours as a score for held-out edges against absent pairs (src, dst each).

    Neighbours are listed from the end that has fewer, and looked up among the other's.
    Up to ``most_edges`` edges are sent to the tasks, where no pair is shuffled; more are joined.
    """

    def auc(scored: DataFrame) -> DataFrame:
        # Scores are counts up to the largest degree: few, so rows are counted by score first.
        counts = scored.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n2"))
        below = F.sum("n2").over(Window.orderBy("score")) - F.col("n2") / 2
        n1, n2 = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2"))
        return counts.withColumn("below", below).agg(n1.alias("n1"), n2.alias("n2"), F.try_divide(F.sum(F.col("n1") * F.col("below")), n1.cast("double") * n2).alias("auc"))

    wanted = held_out.select("src", "dst", F.lit(1).alias("y")).unionByName(absent.select("src", "dst", F.lit(0).alias("y")))
    once = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    if once.count() <= most_edges:
        told = compact.common_neighbours(once, wanted.select(F.col("src").alias("lean"), F.col("dst").alias("far"), "y"))
        return auc(told)
    e = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    d = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ends = wanted.select("src", "dst").distinct()
    for end in ("src", "dst"):
        ends = ends.join(d.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end)
    few = F.col("d_src") <= F.col("d_dst")
    ends = ends.select("src", "dst", F.when(few, F.col("src")).otherwise(F.col("dst")).alias("lean"), F.when(few, F.col("dst")).otherwise(F.col("src")).alias("far"))
    left = ends.join(e.select(F.col("src").alias("lean"), F.col("dst").alias("m")), "lean")
    common = left.join(e.select(F.col("src").alias("far"), F.col("dst").alias("m")), ["far", "m"]).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return auc(wanted.join(common, ["src", "dst"], "left").fillna(0.0, ["score"]))


def bridges(uses: DataFrame, domains: DataFrame, concept: str, proof: str, least_gap: float = 0.3) -> DataFrame:
    """concept, a, b, gap: proofs that use one concept from different domains; ``domains`` has the proof and an array ds.

    Domains travel with the uses, so that only pairs with the gap are formed, in the last stage.
    """
    import pyarrow as pa

    from .relational import tile_pairs
    from .similarity import overlaps

    of = {c: t for c, t in uses.dtypes}
    rows = uses.select(concept, proof).distinct().join(domains.select(proof, F.coalesce(F.array_distinct("ds"), F.array()).alias("ds")), proof).select(concept, proof, "ds")

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = (t[proof].to_numpy() for t in (left, right))
        da, db = (t["ds"].combine_chunks() for t in (left, right))
        sa, sb = (d.value_lengths().to_numpy() for d in (da, db))
        chunks = [(a[:0], b[:0], np.zeros(0))]
        for start, common in overlaps(da, db):
            union = np.maximum(sa[start : start + len(common), None] + sb[None, :] - common, 1)
            gap = 1 - common / union
            i, j = np.nonzero(gap > least_gap)
            x, y = a[i + start], b[j]
            keep = (x < y) if same else (x != y)
            chunks.append((x[keep], y[keep], gap[i, j][keep]))
        x, y, gap = (np.concatenate(c) for c in zip(*chunks))
        swap, kind = x > y, left.schema.field(proof).type
        return pa.table({concept: pa.repeat(left[concept][0], len(x)), "a": pa.array(np.where(swap, y, x), kind), "b": pa.array(np.where(swap, x, y), kind), "gap": gap})

    return tile_pairs(rows, [concept], proof, run, f"`{concept}` {of[concept]}, a {of[proof]}, b {of[proof]}, gap double", 2000)
