"""Graph-walk features of entities (who hold items, which lie in groups) and scorers on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ladder, pairs_within


def entity_walk(holdings: DataFrame, entity: str, item: str, group: str, value: str, hub: str, direction: str, groups: Sequence[str]) -> DataFrame:
    """A row for each entity: sum of values, gains and losses, share of hubs, a flag for each group, pairs within and across groups.

    Pair counts follow from counts: n (n - 1) / 2 in all less those within each
    group; no pair is formed.
    """
    one = holdings.select(entity, item, group, value, hub, direction).distinct()
    per = one.groupBy(entity, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"), F.sum(F.col(hub).cast("int")).alias("h"),
        F.sum((F.col(direction) == "GOF").cast("int")).alias("g"), F.sum((F.col(direction) == "LOF").cast("int")).alias("l"),
    )
    within = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    n = F.sum("n")
    flags = [F.max((F.col(group) == g).cast("int")).alias(f"in_{g}") for g in groups]
    return per.groupBy(entity).agg(
        n.alias("n_items"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("value_sum"), F.sum("g").alias("n_gof"), F.sum("l").alias("n_lof"), (F.sum("h") / n).alias("hub_ratio"),
        F.count(F.lit(1)).alias("n_groups"), within.cast("long").alias("pairs_within"), (n * (n - 1) / 2 - within).cast("long").alias("pairs_across"), *flags,
    )


def with_defaults(entities: DataFrame, features: DataFrame, entity: str) -> DataFrame:
    """Every entity, zero where it has no features."""
    numbers = [c for c, t in features.dtypes if t in ("int", "bigint", "double", "float")]
    return entities.join(features, entity, "left").fillna(0, numbers)


def by_equal_sets(df: DataFrame, entity: str, item: str, features) -> DataFrame:
    """Features computed once for each distinct item set, joined back to the entities.

    ``features`` maps a table (key, item) to one with a row for each key.
    """
    from .aggregates import set_keys

    keyed = set_keys(df, entity, item)
    sets = keyed.select("key", "items").distinct().select("key", F.explode("items").alias(item))
    return keyed.select(entity, "key").join(features(sets), "key")


def attention(holdings: DataFrame, entity: str, item: str, group: str, edges: DataFrame, drivers: DataFrame) -> DataFrame:
    """Per entity, over directed attention edges (src, dst, weight) among its items: total, mean, cross-group total, maximum, asymmetry, density, share of drivers.

    Asymmetry is the largest out / in of an item whose inflow exceeds 0.01.
    """
    one = holdings.select(entity, item, group).distinct()
    size = one.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    a, b = one.select(entity, F.col(item).alias("src"), F.col(group).alias("ga")), one.select(entity, F.col(item).alias("dst"), F.col(group).alias("gb"))
    flow = edges.select("src", "dst", "weight").join(a, "src").join(b, [entity, "dst"]).where("src <> dst")
    total = flow.groupBy(entity).agg(F.sum("weight").alias("flow"), F.avg("weight").alias("mean_flow"), F.sum(F.when(F.col("ga") != F.col("gb"), F.col("weight")).otherwise(0.0)).alias("cross_flow"), F.max("weight").alias("max_flow"), F.count(F.lit(1)).alias("m"))
    sides = flow.select(entity, F.col("src").alias("i"), F.col("weight").alias("o"), F.lit(0.0).alias("r")).unionByName(flow.select(entity, F.col("dst").alias("i"), F.lit(0.0).alias("o"), F.col("weight").alias("r")))
    lean = sides.groupBy(entity, "i").agg(F.sum("o").alias("o"), F.sum("r").alias("r")).where("r > 0.01").groupBy(entity).agg(F.max(F.col("o") / F.col("r")).alias("asymmetry"))
    share = one.join(drivers.select(F.col(item)), item, "left_semi").groupBy(entity).agg(F.count(F.lit(1)).alias("d"))
    out = size.join(total, entity, "left").join(lean, entity, "left").join(share, entity, "left").fillna(0)
    return out.withColumn("density", F.col("m") / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))).withColumn("driver_ratio", F.col("d") / F.greatest("n", F.lit(1))).drop("m", "d")


def unified_affinity(within: DataFrame, sets: DataFrame, entity: str, group: str, shift: Mapping[str, float] | None = None, k: int = 20) -> DataFrame:
    """Undirected affinity edges: the k best partners within a group (``within``: group, a, b, shared, jaccard), and across groups those of equal sets.

    Equal sets across groups are linked in a star to their least entity, with
    the difference of the groups' shifts; so a set that many hold adds a row a
    holder.  ``sets`` has entity, group and key.
    """
    from .similarity import top_neighbours

    near = top_neighbours(within, k, group=[group]).select("a", "b", F.col("jaccard").alias("weight"), F.lit("within").alias("kind"), F.lit(0.0).alias("delta"))
    delta = F.create_map(*(F.lit(x) for kv in (shift or {"": 0.0}).items() for x in kv))
    lead = sets.groupBy("key").agg(F.min(F.struct(entity, group)).alias("lead"))
    cross = sets.join(lead, "key").where(F.col(group) != F.col(f"lead.{group}"))
    exact = cross.select(F.col(f"lead.{entity}").alias("a"), F.col(entity).alias("b"), F.lit(1.0).alias("weight"), F.lit("exact").alias("kind"), (F.coalesce(delta[F.col(f"lead.{group}")], F.lit(0.0)) - F.coalesce(delta[F.col(group)], F.lit(0.0))).alias("delta"))
    return near.unionByName(exact.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "kind", "delta"))


def graph_score(holdings: DataFrame, entity: str, item: str, values: DataFrame, edges: DataFrame, weights: Mapping[str, float], node_weights: Mapping[str, float] | None = None) -> DataFrame:
    """entity, score: values of items, weighted edges among them, weighted node properties; ``values`` has item, value and the properties."""
    one = holdings.select(entity, item).distinct()
    props = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in (node_weights or {}).items()), F.lit(0.0))
    own = one.join(values, item).groupBy(entity).agg(F.sum(F.coalesce("value", F.lit(0.0)) + props).alias("s"))
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    a, b = one.select(entity, F.col(item).alias("src")), one.select(entity, F.col(item).alias("dst"))
    pair = edges.select("src", "dst", (F.coalesce(table[F.col("etype")], F.lit(0.0)) * F.col("value")).alias("w")).join(a, "src").join(b, [entity, "dst"]).groupBy(entity).agg(F.sum("w").alias("p"))
    return one.select(entity).distinct().join(own, entity, "left").join(pair, entity, "left").select(entity, (F.coalesce("s", F.lit(0.0)) + F.coalesce("p", F.lit(0.0))).alias("score"))


def hierarchical_score(holdings: DataFrame, entity: str, item: str, block: str, channel: str, value: str, gates: Sequence[float] = (1.0, 1.0, 0.0, 0.6)) -> DataFrame:
    """entity, score: items sum in blocks (over the square of their number), blocks in channels (over the root), channels and their pairs in entities.

    ``gates`` weigh the levels item, block, pair of channels, channel.  Pairs of
    channels come as (square of the sum less sum of squares) / 2.
    """
    blocks = holdings.groupBy(entity, channel, block).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")).withColumn("b", F.col("s") / (F.col("n") * F.col("n")))
    channels = blocks.groupBy(entity, channel).agg(F.sum("s").alias("s"), (F.sum("b") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("c"), F.sum("b").alias("b"))
    g = [F.lit(x) for x in gates]
    n = F.count(F.lit(1)).cast("double")
    pairs = (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2
    return channels.groupBy(entity).agg((g[0] * F.sum("s") / F.greatest(n, F.lit(1.0)) + g[1] * F.sum("b") + g[2] * pairs + g[3] * F.sum("c") / F.sqrt(n)).alias("score"))


def pair_mode(distance: Column, same_channel: Column) -> Column:
    """How two hits combine, by distance in the graph and whether they share a channel."""
    return ladder([(distance.isNull(), "independent"), (same_channel & (distance <= 1), "redundant"), (same_channel, "multiplicative"), (distance <= 2, "rescue")], "independent")


def combined_shift(mode: Column, a: Column, b: Column) -> Column:
    """The joint effect of two shifts under a mode: the larger in size, their sum, or what is left after rescue."""
    larger = F.when(F.abs(a) >= F.abs(b), a).otherwise(b)
    return ladder([(mode == "redundant", larger), (mode == "multiplicative", a + b + a * b), (mode == "rescue", (a + b) / 2)], a + b)


def shifts(df: DataFrame, group: str, item: str, value: str, least: int = 5) -> DataFrame:
    """Mean value of an item by group; the item's overall mean where the group has too few rows."""
    by_group = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    overall = df.groupBy(item).agg(F.avg(value).alias("m_all"))
    return by_group.join(overall, item).select(group, item, "n", F.when(F.col("n") >= least, F.col("m")).otherwise(F.col("m_all")).alias("shift"), (F.col("n") < least).alias("fallback"))


def modifiers(edges: DataFrame, marked: DataFrame, near: float = 1.5, far: float = 1.25, decay: float = 0.5) -> DataFrame:
    """id, factor of nodes at one and two hops from marked ones (id), as a product over them; and edge decay among the touched (column ``edge_decay``)."""
    from .graph import bfs

    found = bfs(edges, marked.select(F.col("id").alias("source")), 2).where("distance > 0")
    factor = F.exp(F.sum(F.when(F.col("distance") == 1, F.log(F.lit(near))).otherwise(F.log(F.lit(far)))))
    return found.groupBy("id").agg(factor.alias("factor"), F.lit(decay).alias("edge_decay"))


def impute(pairs: DataFrame, signals: Sequence[tuple[DataFrame, Sequence[str], str, float]], shrink: float = 0.5) -> DataFrame:
    """``pairs`` with ``hr`` and ``confidence``: the weighted mean of the signals that exist, on the log scale, shrunk towards 1.

    Signals are (table, keys, column of hazard ratios, weight).
    """
    out, total = pairs, sum(w for *_, w in signals)
    for i, (side, keys, column, _) in enumerate(signals):
        out = out.join(side.select(*keys, F.log(F.col(column)).alias(f"__s{i}")), list(keys), "left")
    w = [F.when(F.col(f"__s{i}").isNotNull(), F.lit(s[3])).otherwise(0.0) for i, s in enumerate(signals)]
    weight = sum(w, F.lit(0.0))
    mean = sum((a * F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i, a in enumerate(w)), F.lit(0.0)) / F.when(weight > 0, weight)
    return out.withColumn("hr", F.exp((1 - shrink) * mean)).withColumn("confidence", weight / total).drop(*(f"__s{i}" for i in range(len(signals))))


def biallelic(role: Column, cna: Column, damaging: Column, missense: Column, mutations: Column) -> Column:
    """Status and mechanism of a gene's hits as ``status:mechanism``, first rule wins; null without any hit."""
    none = (mutations == 0) & (cna == 0)
    suppressor, oncogene = role == "suppressor", role == "oncogene"
    any_ = mutations > 0
    rules = [
        (none, None),
        (suppressor & (cna == -2), "biallelic:homodel"), (suppressor & (cna == -1) & (damaging >= 1), "biallelic:loh+mutation"),
        (suppressor & (cna == -1) & (missense >= 1), "biallelic:loh+missense"), (suppressor & (damaging >= 2), "biallelic:compound_het"),
        (suppressor & cna.isin(-1, -2), "monoallelic:loh_only"), (suppressor & any_, "monoallelic:mutation_only"),
        (oncogene & (cna == 2) & any_, "biallelic:amp+mutation"), (oncogene & (cna == 2), "monoallelic:amp_only"),
        (oncogene & (cna == 1) & any_, "biallelic:gain+mutation"), (oncogene & any_, "monoallelic:mutation_only"),
        (cna == -2, "biallelic:homodel"), ((cna <= -1) & (damaging >= 1), "biallelic:loh+mutation"), ((cna >= 2) & any_, "biallelic:amp+mutation"),
    ]
    return ladder(rules, "monoallelic:single_hit")


def mutation_vector(df: DataFrame, kinds: Sequence[str], channels: Sequence[str], kind: str, channel: str, position: str, vaf: str, scale: float = 2500.0) -> DataFrame:
    """Adds ``features``: kinds and channels one-hot, position over scale, variant share (null: 0), known-position flag."""
    parts = [(F.col(kind) == k).cast("float") for k in kinds] + [(F.col(channel) == c).cast("float") for c in channels]
    parts += [F.coalesce(F.least(F.col(position) / scale, F.lit(1.0)), F.lit(0.0)).cast("float"), F.coalesce(F.col(vaf), F.lit(0.0)).cast("float"), F.col(position).isNotNull().cast("float")]
    return df.withColumn("features", F.array(*(F.coalesce(p, F.lit(0.0).cast("float")) for p in parts)))


def channel_matrix(df: DataFrame, entity: str, channel: str, item: str, hub: str, kind: str, direction: str, alt: str, ref: str, truncating: Sequence[str], missense: Sequence[str]) -> DataFrame:
    """entity, channel: hit flag, log1p count, items, hub and leaf flags, shares of kinds, mean and largest variant share, gains and losses.

    Channels without a hit have no row; they are all zero by definition.
    """
    vaf = F.when(F.col(alt) + F.col(ref) > 0, F.col(alt) / (F.col(alt) + F.col(ref))).otherwise(0.0)
    share = lambda ks: F.avg(F.col(kind).isin(*ks).cast("double"))
    return df.groupBy(entity, channel).agg(
        F.lit(1).alias("severed"), F.log1p(F.count(F.lit(1)).cast("double")).alias("log_n"), F.countDistinct(item).alias("n_items"),
        F.max(F.col(hub).cast("int")).alias("has_hub"), F.max((~F.col(hub)).cast("int")).alias("has_leaf"), share(truncating).alias("truncating"), share(missense).alias("missense"),
        F.avg(vaf).alias("mean_vaf"), F.max(vaf).alias("max_vaf"), F.sum((F.col(direction) == "GOF").cast("int")).alias("gof"), F.sum((F.col(direction) == "LOF").cast("int")).alias("lof"),
    )


def hotspots(df: DataFrame, node: str, spot: str, entity: str, least: int = 50) -> DataFrame:
    """node, spot, n, rank of spots that enough entities share."""
    n = df.groupBy(node, spot).agg(F.countDistinct(entity).alias("n")).where(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(node).orderBy(F.desc("n"), spot)))


def held_out_ranks(holdings: DataFrame, entity: str, item: str) -> DataFrame:
    """entity, held, rank: one item of each entity, chosen by a hash, is predicted from its others.

    The affinity of two items is the number of entities that hold both, counted
    without the held-out items, so none of them tells on itself.  Rank is one
    more than the number of items with a higher sum of affinities.
    """
    from .relational import pairs_within

    one = holdings.select(entity, item).distinct()
    w = Window.partitionBy(entity).orderBy(F.md5(F.concat_ws(":", F.col(entity).cast("string"), F.col(item).cast("string"))), item)
    marked = one.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    held = marked.where("__r = 1 AND __n > 1").select(entity, F.col(item).alias("held"))
    rest = marked.where("__r > 1 OR __n = 1").select(entity, F.col(item).alias("a"), "__n")
    affinity = pairs_within(rest, [entity], "a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    both = affinity.unionByName(affinity.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    scores = rest.where("__n > 1").join(both, "a").groupBy(entity, "b").agg(F.sum("weight").alias("s"))
    seen = held.join(scores, entity, "left")
    mine = F.coalesce(F.max(F.when(F.col("b") == F.col("held"), F.col("s"))).over(Window.partitionBy(entity)), F.lit(0))
    return seen.withColumn("mine", mine).groupBy(entity, "held").agg((F.count_if(F.col("s") > F.col("mine")) + 1).alias("rank"))


def rank_quality(ranks: DataFrame) -> DataFrame:
    """n, mrr, hits10, hits50, median_rank."""
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 10).cast("int")).alias("hits10"), F.avg((F.col("rank") <= 50).cast("int")).alias("hits50"), F.median("rank").alias("median_rank"))


def directed_pairs(df: DataFrame, entity: str, item: str, value: DataFrame) -> DataFrame:
    """primary, secondary, n, gap: co-held pairs, the commoner item first (ties by name); gap is the primary's value less the other's (item, value)."""
    n = df.select(entity, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("c"))
    p = pairs_within(df, [entity], item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    for end in ("a", "b"):
        p = p.join(n.select(F.col(item).alias(end), F.col("c").alias(f"c{end}")), end).join(value.select(F.col(item).alias(end), F.col("value").alias(f"v{end}")), end, "left")
    first = F.col("ca") >= F.col("cb")
    return p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("primary"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("secondary"), "n", F.when(first, F.col("va") - F.col("vb")).otherwise(F.col("vb") - F.col("va")).alias("gap"))


def calibrate(evaluate, names: Sequence[str], low: float, high: float, trials: int, seed: int = 42) -> tuple[dict[str, float], float]:
    """Random search on the driver for the weights with the highest ``evaluate(weights)``; the first of equals wins."""
    import random

    rng = random.Random(seed)
    best: tuple[dict[str, float], float] | None = None
    for _ in range(trials):
        weights = {n: rng.uniform(low, high) for n in names}
        value = float(evaluate(weights))
        if best is None or value > best[1]:
            best = weights, value
    if best is None:
        raise ValueError("no trials")
    return best
