"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, group: Sequence[str], value: str, normalised_by: int | None = None) -> DataFrame:
    """Shannon entropy (bits) of a value within groups; optionally over log2 of a number of classes.

    Two aggregations and no window: sum(c log c) gives the entropy of shares.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    bits = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    if normalised_by:
        bits = bits / F.log2(F.lit(float(normalised_by)))
    return counts.groupBy(*group).agg(F.greatest(bits, F.lit(0.0)).alias("entropy"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("n"))


def top_share(df: DataFrame, group: Sequence[str], value: str, k: int = 3) -> DataFrame:
    """Share of a group's rows that its k commonest values hold, and the commonest (least among equals)."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group).orderBy(F.desc("c"), value)
    ranked = counts.withColumn("r", F.row_number().over(w))
    return ranked.groupBy(*group).agg((F.sum(F.when(F.col("r") <= k, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"), F.max(F.when(F.col("r") == 1, F.col(value))).alias("top"))


def stereotypy(df: DataFrame, group: Sequence[str], entity: str, feature: str) -> DataFrame:
    """Mean cosine of all pairs of entities' binary feature vectors within a group, in closed form.

    (|sum of units|^2 - n) / (n (n - 1)): no pair is formed.
    """
    one = df.select(*group, entity, feature).distinct()
    w = Window.partitionBy(*group, entity)
    unit = one.withColumn("u", 1 / F.sqrt(F.count(F.lit(1)).over(w)))
    by_feature = unit.groupBy(*group, feature).agg(F.sum("u").alias("s"))
    n = one.groupBy(*group).agg(F.countDistinct(entity).alias("n"))
    return by_feature.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(n, list(group)).where("n > 1").select(*group, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def pooled_ratio(df: DataFrame, group: Sequence[str], log_ratio: str, variance: str) -> DataFrame:
    """Inverse-variance pooled log-ratio, its ratio and standard error."""
    w = 1 / F.col(variance)
    return df.where(F.col(variance) > 0).groupBy(*group).agg(weighted_mean(log_ratio, w).alias("log_ratio"), F.sqrt(1 / F.sum(w)).alias("se"), F.count(F.lit(1)).alias("k")).withColumn("ratio", F.exp("log_ratio"))


def clipped_mean(df: DataFrame, group: Sequence[str], time: str) -> DataFrame:
    """Mean of times clipped at min(2 median, 0.9 quantile) of all rows."""
    limit = df.agg(F.least(2 * F.median(time), F.percentile(time, F.lit(0.9))).alias("__limit"))
    return df.crossJoin(F.broadcast(limit)).groupBy(*group).agg(F.avg(F.least(F.col(time), F.col("__limit"))).alias("mean_time"), F.count(F.lit(1)).alias("n"))


def specificity(owners: DataFrame, key: str, owner: str) -> DataFrame:
    """pair of owners (a < b), keys shared and their specificity: the sum of 1 / owners of each key."""
    n = owners.select(key, owner).distinct().groupBy(key).agg(F.countDistinct(owner).alias("n"))
    one = owners.select(key, owner).distinct().join(n, key)
    left, right = one.select(key, "n", F.col(owner).alias("a")), one.select(key, F.col(owner).alias("b"))
    return left.join(right, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(1 / F.col("n")).alias("specificity"))


def hub_scores(df: DataFrame, key: str, member: str, spread: str) -> DataFrame:
    """hub log2(n) * spread and bridge spread / max(log2 n, 0.1) of each key."""
    out = df.groupBy(key).agg(F.countDistinct(member).alias("n"), F.countDistinct(spread).alias("spread"))
    return out.withColumn("hub", F.log2("n") * F.col("spread")).withColumn("bridge", F.col("spread") / F.greatest(F.log2("n"), F.lit(0.1)))


def information_content(df: DataFrame, term: str, entity: str) -> DataFrame:
    """-ln(share of entities that have a term)."""
    total = df.agg(F.countDistinct(entity).alias("__all"))
    return df.groupBy(term).agg(F.countDistinct(entity).alias("n")).crossJoin(F.broadcast(total)).select(term, "n", (-F.log(F.col("n") / F.col("__all"))).alias("ic"))


def edge_matrix(edges: DataFrame, a: str, b: str, kind: str, value: str) -> DataFrame:
    """Count, mean and positive mass of edges by (a, b, kind), and the count over its maximum of the kind."""
    out = edges.groupBy(a, b, kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.when(F.col(value) > 0, F.col(value)).otherwise(0.0)).alias("positive"))
    most = out.groupBy(kind).agg(F.max("n").alias("__most"))
    return out.join(F.broadcast(most), kind).withColumn("relative", F.col("n") / F.col("__most")).drop("__most")


def pair_scores(edges: DataFrame, weights: dict[str, float], multipliers: dict[str, float], kind: str = "etype", value: str = "value", group: str | None = None) -> DataFrame:
    """a, b: sum of weighted edge values, product of multipliers, and counts by group as a map."""
    w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col(kind)], F.lit(0.0))
    m = F.coalesce(F.create_map(*(F.lit(x) for kv in multipliers.items() for x in kv))[F.col(kind)], F.lit(1.0)) if multipliers else F.lit(1.0)
    base = edges.groupBy("a", "b").agg(F.sum(w * F.col(value)).alias("additive"), F.exp(F.sum(F.log(m))).alias("multiplier"))
    if group is None:
        return base
    by = edges.groupBy("a", "b", group).agg(F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "n")))).alias("by_group"))
    return base.join(by, ["a", "b"])


def cooccurrence(df: DataFrame, group: Sequence[str], entity: str, item: str, least: int = 10) -> DataFrame:
    """group, a, b, n: entities that have both items, at least so many."""
    from .relational import pairs_within

    return pairs_within(df, [*group, entity], item).groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def half_steps(column: Column | str) -> Column:
    """A number rounded to halves."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c * 2) / 2


def quantile_bins(df: DataFrame, value: str, bins: int, to: str) -> DataFrame:
    """Bins between exact quantiles, right edges included; equal values share a bin and equal edges are one."""
    edges = df.agg(F.array_sort(F.array_distinct(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))))).alias("__edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(to, F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")


def calibration(df: DataFrame, predicted: str, observed: str, bins: int = 10) -> DataFrame:
    """Equal bins in the order of the prediction (the last takes the remainder): bin, n, mean prediction, mean observed.

    Ranks come from a range partitioning by the prediction, so no task orders
    the whole table.
    """
    ranked = global_rank(df, [predicted], "__r")
    n = df.count()
    size = max(1, n // bins)
    b = F.least(F.floor((F.col("__r") - 1) / size), F.lit(bins - 1)).cast("int")
    return ranked.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("predicted"), F.avg(observed).alias("observed"))


def global_rank(df: DataFrame, order: Sequence[str], to: str) -> DataFrame:
    """1-based rank over the whole table: rows are bucketed by quantiles of the first column, ranked within buckets, and bucket totals are added.

    Ties are broken by the remaining columns.
    """
    first = order[0]
    cuts = df.agg(F.percentile_approx(first, [i / 64 for i in range(1, 64)], 1000).alias("__cuts"))
    keyed = df.crossJoin(F.broadcast(cuts)).withColumn("__bucket", F.size(F.filter("__cuts", lambda e: e < F.col(first)))).drop("__cuts")
    totals = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = totals.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    w = Window.partitionBy("__bucket").orderBy(*order)
    return keyed.join(F.broadcast(starts), "__bucket").withColumn(to, F.col("__start") + F.row_number().over(w)).drop("__bucket", "__start")


def average_rank(df: DataFrame, value: str, to: str) -> DataFrame:
    """Ranks of values, ties sharing their mean; computed on distinct values, so ties never meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = global_running(counts, value, "__c", "__upto")
    return df.join(ranked.select(F.col(value).alias("__v"), (F.col("__upto") - (F.col("__c") - 1) / 2).alias(to)), F.col(value) == F.col("__v"), "left").drop("__v")


def global_running(df: DataFrame, order: str, value: str, to: str, descending: bool = False) -> DataFrame:
    """Running sum over the whole table along a unique column, in two levels."""
    cuts = df.agg(F.percentile_approx(order, [i / 64 for i in range(1, 64)], 1000).alias("__cuts"))
    keyed = df.crossJoin(F.broadcast(cuts)).withColumn("__bucket", F.size(F.filter("__cuts", lambda e: e < F.col(order)))).drop("__cuts")
    totals = keyed.groupBy("__bucket").agg(F.sum(value).alias("__n"))
    along = Window.orderBy(F.desc("__bucket") if descending else F.asc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__bucket", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__start"))
    w = Window.partitionBy("__bucket").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(F.broadcast(starts), "__bucket").withColumn(to, F.col("__start") + F.sum(value).over(w)).drop("__bucket", "__start")


def by_signature(df: DataFrame, signature: str, member: str, categories: str) -> DataFrame:
    """Signatures whose members together span at least two categories; ``categories`` is an array column."""
    out = df.groupBy(signature).agg(F.countDistinct(member).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(categories)))).alias("categories"))
    return out.where((F.col("members") > 1) & (F.size("categories") > 1))


def equivalence_groups(df: DataFrame, entity: str, item: str, outcomes: DataFrame, time: str, event: str) -> DataFrame:
    """Entities with equal item sets as one row: key, items, n, events, median of positive times (0 without any)."""
    keyed = set_keys(df, entity, item)
    joined = outcomes.join(keyed, entity, "left").withColumn("key", F.coalesce("key", F.lit("WILDTYPE"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return joined.groupBy("key", "items").agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("events"), F.coalesce(F.median(F.when(F.col(time) > 0, F.col(time))), F.lit(0.0)).alias("median_time"))


def set_keys(df: DataFrame, entity: str, item: str) -> DataFrame:
    """entity, items (sorted), key: 16 hex digits of the digest of the set."""
    sets = df.groupBy(entity).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))
    return sets.withColumn("key", F.substring(F.sha2(F.array_join("items", "|"), 256), 1, 16))
