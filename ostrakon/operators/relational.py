"""Projections, predicates and joins that the plain DataFrame API has no single word for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides up to this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count, which is looked up, stays within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- projections and predicates ----------------------------------------------


def map_values(df: DataFrame, column: str, mapping: Mapping, to: str) -> DataFrame:
    """A new column by dictionary; values that the dictionary lacks give null."""
    if not mapping:
        return df.withColumn(to, F.lit(None).cast("string"))
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(to, F.create_map(*pairs)[F.col(column)])


def safe_number(column: Column | str) -> Column:
    """The number a string spells; null where it spells none, and for NaN."""
    c = F.col(column) if isinstance(column, str) else column
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def ladder(rungs: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    first, *rest = rungs
    return reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(*first)).otherwise(otherwise)


def event_flag(column: Column | str, form: str = "canonical") -> Column:
    """1 if a status string reports the event; three readings are in use, canonical unites them."""
    c = F.upper(F.col(column) if isinstance(column, str) else column)
    readings = {"canonical": c.rlike("^1") | c.contains("DECEASED"), "digit": c.contains("1") | c.contains("DECEASED"), "prefix": c.contains("1:") | c.contains("DECEASED"), "word": c.contains("DECEASED")}
    return F.coalesce(readings[form], F.lit(False)).cast("int")


def canonical_pairs(df: DataFrame, a: str, b: str, paired: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows with the smaller end first; paired columns swap along."""
    swap = F.col(a) > F.col(b)
    sides = [(a, b), *paired]
    new = {c: F.when(swap, F.col(o)).otherwise(F.col(c)) for x, y in sides for c, o in ((x, y), (y, x))}
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def recurrent(df: DataFrame, keys: Sequence[str], entity: str, least: int) -> DataFrame:
    """Keys that at least so many different entities have, with that count as ``n``."""
    return df.groupBy(*keys).agg(F.countDistinct(entity).alias("n")).where(F.col("n") >= least)


def tiers(df: DataFrame, kind: str, silent: Sequence[str], truncating: Sequence[str], gene: str, position: str, entity: str, least: int = 5) -> DataFrame:
    """Rows with ``tier1`` (not silent), ``tier2`` (truncating or at a hotspot) and ``tier3`` (at a hotspot).

    A hotspot is a (gene, position) that at least so many entities share.
    """
    loud = ~F.col(kind).isin(*silent)
    spots = recurrent(df.where(loud & F.col(position).isNotNull()), [gene, position], entity, least).select(gene, position, F.lit(True).alias("__spot"))
    flagged = df.join(spots, [gene, position], "left").withColumn("__spot", F.coalesce("__spot", F.lit(False)) & loud)
    return flagged.withColumn("tier1", loud).withColumn("tier2", loud & (F.col(kind).isin(*truncating) | F.col("__spot"))).withColumn("tier3", F.col("__spot")).drop("__spot")


def active(edges: DataFrame) -> DataFrame:
    """Edges that are not soft-deleted."""
    return edges.where(~F.coalesce(F.col("deprecated"), F.lit(False)))


def keyword_search(df: DataFrame, columns: Sequence[str], word: str) -> DataFrame:
    """Rows that contain the word in one of the columns, in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(word.lower())))


def fuzzy_lookup(df: DataFrame, column: str, name: str) -> DataFrame:
    """The least row whose name contains the given one or is contained in it."""
    c = F.lower(F.col(column))
    return df.where(c.contains(name.lower()) | F.lit(name.lower()).contains(c)).orderBy(column).limit(1)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores (sample deviation); constant columns become 0.  One pass for the moments, one row is broadcast."""
    moments = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = df.crossJoin(F.broadcast(moments))
    z = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}
    return joined.select(*(z[c].alias(c) if c in z else F.col(c) for c in df.columns))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """0/1 columns for listed values."""
    return df.withColumns({f"{prefix}{v}": (F.col(column) == v).cast("int") for v in values})


def flags(df: DataFrame, entity: str, conditions: Mapping[str, Column]) -> DataFrame:
    """A row for each entity: 1 where some row of it meets a condition."""
    return df.groupBy(entity).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in conditions.items()))


def coverage(df: DataFrame) -> DataFrame:
    """column, share of its values that are not null."""
    shares = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in df.columns))
    return shares.unpivot([], list(df.columns), "column", "share")


# --- joins -------------------------------------------------------------------


def chain_left(base: DataFrame, on: str, sides: Sequence[DataFrame], fill: object = 0) -> DataFrame:
    """Left joins one after another; what is missing becomes ``fill``."""
    out = reduce(lambda l, r: l.join(r, on, "left"), sides, base)
    return out.fillna(fill, [c for c in out.columns if c not in base.columns])


def join_twice(pairs: DataFrame, ends: tuple[str, str], dimension: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Attributes of both ends of a pair from one dimension."""
    out = pairs
    for end, suffix in zip(ends, suffixes):
        side = dimension.select(F.col(key).alias(f"__k{suffix}"), *(F.col(c).alias(f"{c}{suffix}") for c in dimension.columns if c != key))
        out = out.join(side, F.col(end) == F.col(f"__k{suffix}"), "left").drop(f"__k{suffix}")
    return out


def merge_new_columns(base: DataFrame, sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins that only bring columns the base lacks."""
    out = base
    for s in sides:
        out = out.join(s.select(*keys, *(c for c in s.columns if c not in out.columns)), list(keys), "left")
    return out


def tiered_lookup(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str], str]], to: str, default: float = 0.0) -> DataFrame:
    """The value of the first level that knows the row's key, and ``tier`` (0: none).

    Levels are (table with one row a key, key columns, value column).
    """
    out = df
    for i, (side, keys, value) in enumerate(levels):
        out = out.join(side.select(*keys, F.col(value).alias(f"__v{i}")), list(keys), "left")
    found = [F.col(f"__v{i}") for i in range(len(levels))]
    tier = ladder([(v.isNotNull(), i + 1) for i, v in enumerate(found)], 0)
    return out.withColumn(to, F.coalesce(*found, F.lit(default))).withColumn("tier", tier).drop(*(f"__v{i}" for i in range(len(levels))))


def in_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str] = (), x: str = "x", y: str = "y", bin_size: float = 100.0) -> DataFrame:
    """``points`` with ``hit``: whether some box (x1, x2, y1, y2) holds the point in either orientation.

    Boxes are cut into bins of x, so the join is an equi-join on the bin; no
    pair of a far point and box is ever formed.
    """
    both = boxes.select(*on, "x1", "x2", "y1", "y2").unionByName(boxes.select(*on, F.col("y1").alias("x1"), F.col("y2").alias("x2"), F.col("x1").alias("y1"), F.col("x2").alias("y2")))
    binned = both.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("x1") / bin_size), F.floor(F.col("x2") / bin_size))))
    keyed = points.withColumn("__bin", F.floor(F.col(x) / bin_size))
    condition = keyed["__bin"] == binned["__bin"]
    for c in on:
        condition &= keyed[c] == binned[c]
    condition &= keyed[x].between(binned["x1"], binned["x2"]) & keyed[y].between(binned["y1"], binned["y2"])
    inside = keyed.join(binned, condition, "left_semi").withColumn("hit", F.lit(True))
    outside = keyed.join(binned, condition, "left_anti").withColumn("hit", F.lit(False))
    return inside.unionByName(outside).drop("__bin")


def oriented_shards(pairs: DataFrame, shard: str, key: str, done: DataFrame | None = None) -> DataFrame:
    """Pairs turned so that ``{shard}_a`` <= ``{shard}_b``, one row for each pair of keys then, without shards in ``done``.

    Columns that end in _a and _b describe the two sides and are swapped
    together; others stay.  Pairs within one shard are not turned.  Of rows with
    equal keys the least in order of all columns stays.  Rows without a shard
    or key go.  ``done`` holds the shards ({shard}_a, {shard}_b) that an earlier
    run has written, so that a run can be taken up again.
    """
    sides = [c[:-2] for c in pairs.columns if c.endswith("_a") and f"{c[:-2]}_b" in pairs.columns]
    swap = F.col(f"{shard}_a") > F.col(f"{shard}_b")
    turned = {f"{s}_{x}": F.when(swap, F.col(f"{s}_{y}")).otherwise(F.col(f"{s}_{x}")) for s in sides for x, y in (("a", "b"), ("b", "a"))}
    whole = pairs.where(" AND ".join(f"{c}_{x} IS NOT NULL" for c in (shard, key) for x in "ab"))
    out = whole.select(*(turned.get(c, F.col(c)).alias(c) for c in pairs.columns))
    if done is not None:
        out = out.join(done.select(f"{shard}_a", f"{shard}_b").distinct(), [f"{shard}_a", f"{shard}_b"], "left_anti")
    one = [f"{shard}_a", f"{shard}_b", f"{key}_a", f"{key}_b"]
    rest = [c for c in pairs.columns if c not in one]
    if not rest:
        return out.select(*pairs.columns).distinct()
    return out.groupBy(*one).agg(F.min(F.struct(*rest)).alias("rest")).select(*one, "rest.*").select(*pairs.columns)


def interpolate(df: DataFrame, at: str, anchors: DataFrame, x: str, y: str, to: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Linear interpolation between anchor points; beyond them the outer segments go on; then clamped.

    Anchors (a few bin edges) form segments, and rows join theirs by range.
    """
    w = Window.orderBy(x)
    seg = anchors.select(F.col(x).alias("__x0"), F.col(y).alias("__y0"), F.lead(x).over(w).alias("__x1"), F.lead(y).over(w).alias("__y1"), F.row_number().over(w).alias("__i")).where("__x1 IS NOT NULL")
    last = F.max("__i").over(Window.partitionBy())
    seg = seg.withColumn("__last", F.col("__i") == last)
    inside = ((F.col(at) >= F.col("__x0")) | (F.col("__i") == 1)) & ((F.col(at) < F.col("__x1")) | F.col("__last"))
    value = F.col("__y0") + (F.col(at) - F.col("__x0")) * (F.col("__y1") - F.col("__y0")) / (F.col("__x1") - F.col("__x0"))
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return df.join(F.broadcast(seg), inside).withColumn(to, value).drop("__x0", "__y0", "__x1", "__y1", "__i", "__last")


def pairs_within(df: DataFrame, group: Sequence[str], item: str, keep: Sequence[str] = (), tile: int = 2000) -> DataFrame:
    """Unordered pairs of different items that share a group: a, b with a < b.

    A group of more than ``tile`` items is cut into tiles by the items' hashes,
    and each pair of tiles is joined by itself; so one large group, whose
    pairs grow with its square, is spread over many tasks.  Rows without a group
    make no pairs.
    """
    one = df.select(*group, item, *keep).distinct()
    large = one.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("__k")).where("__k > 1")
    tiled = one.join(large, list(group), "left").withColumn("__k", F.coalesce("__k", F.lit(1))).withColumn("__own", F.pmod(F.xxhash64(item), F.col("__k")))
    tiled = tiled.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    left = tiled.select(*group, F.col("__own").alias("__s"), F.col("__other").alias("__t"), F.col(item).alias("a"), *(F.col(c).alias(f"{c}_a") for c in keep))
    right = tiled.select(*group, F.col("__other").alias("__s"), F.col("__own").alias("__t"), F.col(item).alias("b"), *(F.col(c).alias(f"{c}_b") for c in keep))
    return left.join(right, [*group, "__s", "__t"]).where("a < b").drop("__s", "__t")


def tile_pairs(df: DataFrame, group: Sequence[str], item: str, run: Callable, schema: str, tile: int = 1000) -> DataFrame:
    """``run(left, right, same)`` on each pair of tiles of a group: two Arrow tables of rows, ``same`` if both are one tile.

    A group is cut into tiles by the items' hashes.  Only rows are shuffled, each
    to as many places as its group has tiles; what ``run`` returns (an Arrow
    table of ``schema``) is not, so pairs take no room but in the result.
    Partitions are fixed in number: they are small to read and large to write.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*group, item)))
    count = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("__k"))
    tiled = rows.join(count, list(group)) if group else rows.crossJoin(F.broadcast(count))
    tiled = tiled.withColumn("__own", F.pmod(F.xxhash64(item), F.col("__k"))).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    tiled = tiled.select(*df.columns, "__own", F.least("__own", "__other").alias("__s"), F.greatest("__own", "__other").alias("__t"))
    keys = [*group, "__s", "__t"]

    def both(table: pa.Table) -> pa.Table:
        s, t = table["__s"][0].as_py(), table["__t"][0].as_py()
        plain = table.drop_columns(["__own", "__s", "__t"])
        if s == t:
            return run(plain, plain, True)
        return run(plain.filter(pc.equal(table["__own"], s)), plain.filter(pc.equal(table["__own"], t)), False)

    return tiled.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys).applyInArrow(both, schema)


def shared_neighbours(edges: DataFrame, left: str, via: str, kind: str | None = None) -> DataFrame:
    """Bipartite projection: a, b, what they share (sorted) and how many, weight min(n / 5, 1)."""
    group = [via, *([kind] if kind else [])]
    found = pairs_within(edges, group, left)
    by = ["a", "b", *([kind] if kind else [])]
    return found.groupBy(*by).agg(F.array_sort(F.collect_set(via)).alias("shared"), F.countDistinct(via).alias("n")).withColumn("weight", F.least(F.col("n") / 5, F.lit(1.0)))


def conflicts(edges: DataFrame, left: str, via: str, kind: str, one: str, other: str) -> DataFrame:
    """a, b, n: how many neighbours a has by one kind of edge and b by the other."""
    x = edges.where(F.col(kind) == one).select(F.col(left).alias("a"), via).distinct()
    y = edges.where(F.col(kind) == other).select(F.col(left).alias("b"), via).distinct()
    return x.join(y, via).where("a <> b").groupBy("a", "b").agg(F.countDistinct(via).alias("n"))
