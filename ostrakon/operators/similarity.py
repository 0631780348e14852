"""Set and vector similarity, and the edges that are discovered from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Jaccard similarity of two arrays; ``empty`` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.when((dot(a, a) > 0) & (dot(b, b) > 0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded, halves away from zero; no negative zero."""
    return np.trunc(x * 10.0**places + np.copysign(0.5, x)) / 10.0**places + 0.0


def cosine_pairs(vectors: DataFrame, entity: str, vector: str, group: Sequence[str] = (), places: int = 5, tile: int = 1000) -> DataFrame:
    """a, b (a < b), cosine of all pairs within a group, as ``cosine`` has it, rounded; a product of matrices a pair of tiles."""
    from .relational import tile_pairs

    kind = vectors.schema[entity].dataType.simpleString()

    def matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of the vectors: places of the rows and unit vectors; none for rows without a vector, a length or some number."""
        column = table[vector].combine_chunks()
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        gaps = np.concatenate([[0], np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False))])
        values, ends = flat.to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)
        sound = (sizes > 0) & (gaps[ends] == gaps[ends - sizes])
        out = {}
        for n in np.unique(sizes[sound]):
            at = np.flatnonzero(sound & (sizes == n))
            x = values[(ends[at] - n)[:, None] + np.arange(n)]
            square = (x * x).sum(1)
            keep = ~(square <= 0)
            out[int(n)] = at[keep], x[keep] / np.sqrt(square[keep])[:, None]
        return out

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = (t[entity].to_numpy() for t in (left, right))
        score = np.full((len(a), len(b)), np.nan)
        known = np.zeros(score.shape, bool)
        of = matrices(left)
        for n, (j, y) in (of if same else matrices(right)).items():
            if n in of:
                i, x = of[n]
                score[np.ix_(i, j)] = np.clip(x @ y.T, -1.0, 1.0)
                known[np.ix_(i, j)] = True
        i, j = np.nonzero(a[:, None] < b[None, :] if same else a[:, None] != b[None, :])
        x, y = a[i], b[j]
        swap = x > y
        return pa.table({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "cosine": pa.array(half_up(score[i, j], places), mask=~known[i, j])})

    return tile_pairs(vectors.select(*group, entity, vector), group, entity, run, f"a {kind}, b {kind}, cosine double", tile)


def unit(a: Column) -> Column:
    """The vector over its length; unchanged if it has none."""
    return F.when(dot(a, a) > 0, F.transform(a, lambda v: v.cast("double") / F.sqrt(dot(a, a)))).otherwise(F.transform(a, lambda v: v.cast("double")))


def overlaps(left: pa.ListArray, right: pa.ListArray, rows: int = 1000, step: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """How many items the sets from a place in ``left`` on share with each of ``right``: products of incidence matrices, some rows and items at a time."""
    flat = [x.flatten() for x in (left, right)]
    code = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy()
    codes = code[: len(flat[0])], code[len(flat[0]) :]
    items = np.intersect1d(*codes)
    found = []
    for sets, c in zip((left, right), codes):
        at = np.minimum(np.searchsorted(items, c), max(len(items) - 1, 0))
        row = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy())
        keep = items[at] == c if len(items) else np.zeros(len(c), bool)
        found.append((row[keep], at[keep]))

    def matrix(n: int, row: np.ndarray, item: np.ndarray, start: int) -> np.ndarray:
        m, keep = np.zeros((n, min(step, len(items) - start)), np.float32), (item >= start) & (item < start + step)
        m[row[keep], item[keep] - start] = 1
        return m

    whole = matrix(len(right), *found[1], 0).T if len(items) <= step else None
    for first in range(0, len(left), rows):
        n, (row, item) = min(rows, len(left) - first), found[0]
        part = slice(*np.searchsorted(row, [first, first + rows]))
        out = np.zeros((n, len(right)), np.float32)
        for start in range(0, len(items), step):
            out += matrix(n, row[part] - first, item[part], start) @ (matrix(len(right), *found[1], start).T if whole is None else whole)
        yield first, out


def _jaccard_tiles(whole: DataFrame, entity: str, threshold: float, group: Sequence[str], least_shared: int, best: int | None, tile: int = 4000) -> DataFrame:
    """group, a, b, shared, jaccard from whole sets (``items``); with ``best``, x, y in place of a, b: the best partners of x within each pair of tiles."""
    from .relational import tile_pairs

    ends = ("x", "y") if best else ("a", "b")
    kind = whole.schema[entity].dataType.simpleString()
    groups = "".join(f"`{c}` {whole.schema[c].dataType.simpleString()}, " for c in group)

    def top(x: np.ndarray, y: np.ndarray, shared: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((np.unique(y, return_inverse=True)[1], -score, np.unique(x, return_inverse=True)[1]))
        x = x[order]
        start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
        rank = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
        keep = order[rank < best]
        return y[keep], shared[keep], score[keep], keep

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = (t[entity].to_numpy() for t in (left, right))
        ia, ib = (t["items"].combine_chunks() for t in (left, right))
        sa, sb = (x.value_lengths().to_numpy() for x in (ia, ib))
        chunks = [(a[:0], b[:0], np.zeros(0, np.int64), np.zeros(0))]
        for start, common in overlaps(ia, ib):
            size = sa[start : start + len(common)]
            bound = np.float32(threshold / (1 + threshold)) * (size[:, None].astype(np.float32) + sb[None, :].astype(np.float32))
            i, j = np.nonzero(common >= np.maximum(bound * np.float32(1 - 1e-5), np.float32(0.5)))
            shared = common[i, j].astype(np.int64)
            score = shared / (size[i] + sb[j] - shared)
            x, y = a[i + start], b[j]
            keep = (score >= threshold - 1e-12) & (shared >= least_shared) & ((x < y) if same else (x != y))
            x, y, shared, score = x[keep], y[keep], shared[keep], score[keep]
            chunks.append((x, y, shared, score))
        x, y, shared, score = (np.concatenate(c) for c in zip(*chunks))
        if best:
            x, y, shared, score = np.r_[x, y], np.r_[y, x], np.r_[shared, shared], np.r_[score, score]
            y, shared, score, keep = top(x, y, shared, score)
            x = x[keep]
        else:
            swap = x > y
            x, y = np.where(swap, y, x), np.where(swap, x, y)
        fixed = {c: pa.repeat(left[c][0], len(x)) for c in group}
        return pa.table(fixed | {ends[0]: pa.array(x, left.schema.field(entity).type), ends[1]: pa.array(y, left.schema.field(entity).type), "shared": shared.astype(np.int32), "jaccard": score})

    return tile_pairs(whole, group, entity, run, f"{groups}{ends[0]} {kind}, {ends[1]} {kind}, shared int, jaccard double", tile)


def _jaccard_sides(sets: DataFrame, entity: str, item: str, threshold: float, group: Sequence[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Prefixes (with sizes), whole sets, and whether the prefixes' join would make more rows than there are pairs to look at.

    The choice takes a job over the sets, which are written once.
    """
    one = sets.select(*group, entity, item).distinct()
    df = one.groupBy(*group, item).agg(F.count(F.lit(1)).alias("__df"))
    w = Window.partitionBy(*group, entity)
    ordered = one.join(df, [*group, item]).withColumn("s", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("__df", item)))
    ordered = cut(ordered, "sets")
    prefix = ordered.where(F.col("r") <= F.col("s") - F.ceil(F.lit(threshold) * F.col("s") - 1e-9) + 1).select(*group, entity, item, "s")
    whole = ordered.groupBy(*group, entity).agg(F.collect_set(item).alias("items"))
    half = lambda d: d.agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2)).first()[0] or 0.0
    joined = half(prefix.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n")))
    pairs = half(ordered.where("r = 1").groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    return prefix, whole, joined * 20 > pairs


def jaccard_join(sets: DataFrame, entity: str, item: str, threshold: float, group: Sequence[str] = (), least_shared: int = 1) -> DataFrame:
    """group, a, b (a < b), shared, jaccard >= threshold.

    Only the rarest items of a set, its prefix, are joined: sets of sizes s
    and t can reach the threshold only if they share one of the first
    s - ceil(threshold * s) + 1 items in a common order from rare to frequent.
    Sizes are compared before anything is counted.  Where items are so
    frequent that this would form about every pair, all pairs of a group are
    compared by products of matrices, tile by tile, and none is shuffled.
    """
    prefix, whole, dense = _jaccard_sides(sets, entity, item, threshold, group)
    if dense and threshold > 0:
        return _jaccard_tiles(whole, entity, threshold, group, least_shared, None)
    return _jaccard_prefixes(prefix, whole, entity, item, threshold, group, least_shared)


def jaccard_best(sets: DataFrame, entity: str, item: str, threshold: float, k: int, group: Sequence[str] = (), least_shared: int = 1) -> DataFrame:
    """group, a, b, shared, jaccard: ``top_neighbours`` of ``jaccard_join`` within a group; in dense groups not all pairs.

    There equal sets are one class: a class keeps k other classes by jaccard and
    least entity, which hold its k best partners outside, and the k + 1 least entities of each.
    """
    prefix, whole, dense = _jaccard_sides(sets, entity, item, threshold, group)
    if not (dense and threshold > 0):
        return top_neighbours(_jaccard_prefixes(prefix, whole, entity, item, threshold, group, least_shared), k, group=group).select(*group, "a", "b", "shared", "jaccard")
    whole = whole.where(F.size("items") >= least_shared).withColumn("items", F.array_sort("items"))
    first = lambda d, by, order: d.withColumn("__r", F.row_number().over(Window.partitionBy(*group, *by).orderBy(*order))).where(F.col("__r") <= k + 1).drop("__r")
    some = first(whole, ["items"], [entity])
    classes = cut(some.groupBy(*group, "items").agg(F.min(entity).alias("lead"), F.array_sort(F.collect_list(entity)).alias("own")), "classes")
    near = _jaccard_tiles(classes.select(*group, "lead", "items"), "lead", threshold, group, least_shared, k)
    near = first(near, ["x"], [F.desc("jaccard"), "y"])
    far = near.join(classes.select(*group, F.col("lead").alias("y"), F.explode("own").alias("id")), [*group, "y"])
    far = first(far, ["x"], [F.desc("jaccard"), "id"]).groupBy(*group, F.col("x").alias("lead")).agg(F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("w"), "id", "shared"))).alias("far"))
    own = F.transform("own", lambda y: F.struct(F.lit(-1.0).alias("w"), y.alias("id"), F.size("items").alias("shared")))
    lists = classes.join(far, [*group, "lead"], "left").select(*group, "items", F.when(F.col("far").isNull(), own).otherwise(F.concat(own, "far")).alias("list"))
    best = whole.join(lists, [*group, "items"]).select(*group, F.col(entity).alias("x"), F.explode(F.slice(F.filter("list", lambda y: y["id"] != F.col(entity)), 1, k)).alias("y"))
    return best.select(*group, F.least("x", "y.id").alias("a"), F.greatest("x", "y.id").alias("b"), F.col("y.shared").alias("shared"), (-F.col("y.w")).alias("jaccard")).distinct()


def _jaccard_prefixes(prefix: DataFrame, whole: DataFrame, entity: str, item: str, threshold: float, group: Sequence[str], least_shared: int) -> DataFrame:
    left, right = prefix.select(*group, item, F.col(entity).alias("a"), F.col("s").alias("sa")), prefix.select(*group, item, F.col(entity).alias("b"), F.col("s").alias("sb"))
    near = left.join(right, [*group, item]).where((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.lit(threshold) * F.greatest("sa", "sb") - 1e-9)).select(*group, "a", "b").distinct()
    for end in ("a", "b"):
        near = near.join(whole.select(*group, F.col(entity).alias(end), F.col("items").alias(f"i{end}")), [*group, end])
    out = near.withColumn("shared", F.size(F.array_intersect("ia", "ib"))).withColumn("jaccard", F.col("shared") / F.size(F.array_union("ia", "ib")))
    return out.where((F.col("jaccard") >= threshold - 1e-12) & (F.col("shared") >= least_shared)).select(*group, "a", "b", "shared", "jaccard")


def feature_join(owners: DataFrame, key: str, owner: str, least_shared: int = 2, most_owners: int = 50) -> DataFrame:
    """a, b, shared, specificity of owners that share keys with 2 to ``most_owners`` owners.

    The bound on owners is part of what the operator computes: commoner keys
    say nothing; so no key makes more than that many pairs a row.
    """
    from .aggregates import specificity

    one = owners.select(key, owner).distinct()
    n = one.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n").between(2, most_owners)).select(key)
    return specificity(one.join(n, key, "left_semi"), key, owner).where(F.col("shared") >= least_shared)


def top_neighbours(pairs: DataFrame, k: int, score: str = "jaccard", group: Sequence[str] = ()) -> DataFrame:
    """The k best partners of each entity (ties by id), as undirected pairs once each."""
    columns = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), *columns).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), *columns))
    w = Window.partitionBy(*group, "x").orderBy(F.desc(score), "y")
    best = both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *columns).distinct()


def smooth(values: DataFrame, entity: str, value: str, pairs: DataFrame, weight: float = 0.3, score: str = "jaccard", cross: str | None = None, decay: float = 0.7) -> DataFrame:
    """(1 - w) own + w * weighted mean of neighbours; entities without neighbours keep their own value."""
    s = F.col(score) * (F.pow(F.lit(decay), F.col(cross)) if cross else F.lit(1.0))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), s.alias("s")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), s.alias("s")))
    of = values.select(F.col(entity).alias("y"), F.col(value).alias("v"))
    mean = both.join(of, "y").groupBy("x").agg((F.sum(F.col("s") * F.col("v")) / F.sum("s")).alias("near"))
    joined = values.join(mean, F.col(entity) == F.col("x"), "left")
    return joined.withColumn("smoothed", F.when(F.col("near").isNull(), F.col(value)).otherwise((1 - weight) * F.col(value) + weight * F.col("near"))).drop("x", "near")


def column_correlation(long: DataFrame, row: str, column: str, value: str, least: int = 30) -> DataFrame:
    """a, b, n, r: mean product of whole-column z-scores (population deviation) over common rows."""
    moments = long.groupBy(column).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = long.join(moments, column).where("s > 0").select(row, column, ((F.col(value) - F.col("m")) / F.col("s")).alias("z"))
    left, right = z.select(row, F.col(column).alias("a"), F.col("z").alias("za")), z.select(row, F.col(column).alias("b"), F.col("z").alias("zb"))
    return left.join(right, row).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("za") * F.col("zb")).alias("r")).where(F.col("n") >= least)


def pearson_edges(long: DataFrame, row: str, column: str, value: str, least_r: float = 0.3, most_p: float = 0.05, top: int = 50_000, least: int = 3) -> DataFrame:
    """a, b, n, r, p of the strongest pairwise-complete correlations."""
    from .stats import t_two_sided

    left, right = long.select(row, F.col(column).alias("a"), F.col(value).alias("va")), long.select(row, F.col(column).alias("b"), F.col(value).alias("vb"))
    out = left.join(right, row).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("r")).where((F.col("n") >= least) & (F.abs("r") >= least_r))
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15)))
    return out.withColumn("p", t_two_sided(t, F.col("n") - 2)).where(F.col("p") < most_p).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def lin_similarity(annotations: DataFrame, entity: str, term: str, ic: DataFrame, tile: int = 1000) -> DataFrame:
    """a, b, lin: 2 max shared information over the sum of both maxima; ``ic`` has term, ic.

    Where terms are so frequent that joining them would make more rows than
    there are pairs of entities, all pairs are looked at tile by tile, and none is shuffled.
    Beyond one ``tile`` of entities, whose copies would travel to all others, few terms are sent as words.
    """
    from .relational import pairs_within

    told = cut(annotations.select(entity, term).distinct().join(ic.select(term, "ic"), term), "told")
    half = lambda by: told.groupBy(*by).agg(F.countDistinct(entity).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2)).first()[0] or 0.0
    if half([term]) > (pairs := half([])):
        terms = [] if pairs <= tile * (tile - 1) / 2 else told.select(term, "ic").distinct().limit(64).collect()
        if 0 < len(terms) < 64 and all(r["ic"] is not None for r in terms):
            return _lin_bits(told, entity, term, sorted(terms, key=lambda r: -r["ic"]))
        return _lin_tiles(told, entity, term, tile)
    most = told.groupBy(entity).agg(F.max("ic").alias("m"))
    shared = pairs_within(told, [term], entity, ["ic"]).groupBy("a", "b").agg(F.max("ic_a").alias("s"))
    out = shared.join(most.select(F.col(entity).alias("a"), F.col("m").alias("ma")), "a").join(most.select(F.col(entity).alias("b"), F.col("m").alias("mb")), "b")
    return out.select("a", "b", F.when(F.col("ma") + F.col("mb") > 0, 2 * F.col("s") / (F.col("ma") + F.col("mb"))).otherwise(0.0).alias("lin"))


def _lin_bits(told: DataFrame, entity: str, term: str, terms: list) -> DataFrame:
    """a, b, lin where all entities share fewer than 64 ``terms`` (term, ic; the most informative first): an entity is a word, its lowest bit the best term.

    All words are sent to the tasks, which tell the pairs; none is shuffled.
    """
    from . import compact

    spark, kind = told.sparkSession, told.schema[entity].dataType.simpleString()
    bits = spark.createDataFrame([(*r, 1 << k) for k, r in enumerate(terms)], f"`{term}` {told.schema[term].dataType.simpleString()}, ic double, bit long")
    found = told.where(F.col(entity).isNotNull()).join(F.broadcast(bits), [term, "ic"]).groupBy(entity).agg(F.bit_or("bit").alias("w")).toArrow()
    of, names, words = found.schema.field(0).type, found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(names, kind="stable")
    lowest = lambda x: np.bitwise_count((x & -x) - 1)
    ics = np.array([r["ic"] for r in terms], float)
    shared, n = spark.sparkContext.broadcast((names[order], words[order], ics)), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, ics = shared.value
        most = ics[lowest(words)]
        # Early rows have more partners: a turn takes one from either end.
        for i in (k for batch in batches for t in batch.column(0).to_pylist() for k in sorted({t, n - 1 - t})):
            for j in range(i + 1, n, 1 << 18):
                both = words[i] & words[j : j + (1 << 18)]
                at = np.flatnonzero(both)
                total = most[i] + most[j + at]
                lin = np.where(total > 0, 2 * ics[lowest(both[at])] / np.where(total > 0, total, 1.0), 0.0)
                x = names[np.full(len(at), i)]
                yield pa.RecordBatch.from_arrays([pa.array(x, of), pa.array(names[j + at], of), pa.array(lin)], names=["a", "b", "lin"])

    return compact.turns(spark, (n + 1) // 2).mapInArrow(run, f"a {kind}, b {kind}, lin double")


def _lin_tiles(told: DataFrame, entity: str, term: str, tile: int = 1000) -> DataFrame:
    """a, b, lin from entity, term, ic (one row each), by pairs of tiles of entities."""
    from .relational import tile_pairs

    kind = told.schema[entity].dataType.simpleString()
    known = told.groupBy(entity).agg(F.max("ic").alias("m"), F.collect_list(F.struct(F.col(term).alias("t"), "ic")).alias("l"))

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        owners, terms, ics = [], [], []
        for table in (left, right):
            column = table["l"].combine_chunks()
            flat = column.flatten()
            owners.append(np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()))
            terms.append(flat.field(0))
            ics.append(flat.field(1).to_numpy(zero_copy_only=False).astype(float))
        code = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
        codes = code[: len(terms[0])], code[len(terms[0]) :]
        order = [np.argsort(c, kind="stable") for c in codes]
        rank = [c[o] for c, o in zip(codes, order)]
        shared, at = np.unique(rank[0], return_index=True)
        value = ics[0][order[0]][at]
        most = np.full((left.num_rows, right.num_rows), -np.inf)
        for t in shared[np.argsort(value, kind="stable")]:
            rows = [owners[k][order[k][slice(*np.searchsorted(rank[k], [t, t + 1]))]] for k in (0, 1)]
            most[np.ix_(*rows)] = ics[0][order[0][np.searchsorted(rank[0], t)]]
        a, b = (x[entity].to_numpy() for x in (left, right))
        i, j = np.nonzero((most > -np.inf) & (a[:, None] < b[None, :] if same else a[:, None] != b[None, :]))
        total = left["m"].to_numpy()[i] + right["m"].to_numpy()[j]
        lin = np.where(total > 0, 2 * most[i, j] / np.where(total > 0, total, 1.0), 0.0)
        x, y = a[i], b[j]
        swap = x > y
        of = left.schema.field(entity).type
        return pa.table({"a": pa.array(np.where(swap, y, x), of), "b": pa.array(np.where(swap, x, y), of), "lin": lin})

    return tile_pairs(known, [], entity, run, f"a {kind}, b {kind}, lin double", tile)


def analogous(profile: DataFrame, entity: str, column: str, share: str, least_size: float = 1.5, least_cosine: float = 0.92) -> DataFrame:
    """a, b, cosine of entities whose z-profiles (per column, sample deviation) are long enough and point the same way."""
    moments = profile.groupBy(column).agg(F.avg(share).alias("m"), F.stddev_samp(share).alias("s"))
    z = profile.join(moments, column).where("s > 0").select(F.col(entity).alias("e"), column, ((F.col(share) - F.col("m")) / F.col("s")).alias("z"))
    size = z.groupBy("e").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("size")).where(F.col("size") >= least_size)
    u = z.join(size, "e").select("e", column, (F.col("z") / F.col("size")).alias("u"))
    left, right = u.select(column, F.col("e").alias("a"), F.col("u").alias("ua")), u.select(column, F.col("e").alias("b"), F.col("u").alias("ub"))
    return left.join(right, column).where("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")).where(F.col("cosine") >= least_cosine)


def pair_counts(df: DataFrame, entity: str, item: str) -> DataFrame:
    """a, b, both, n_a, n_b, n: all pairs of items (also those never together) with their counts of entities."""
    from .relational import pairs_within

    one = df.select(entity, item).distinct()
    n = one.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    total = one.agg(F.countDistinct(entity).alias("n_all"))
    together = pairs_within(one, [entity], item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    left, right = n.select(F.col(item).alias("a"), F.col("n").alias("n_a")), n.select(F.col(item).alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, F.col("a") < F.col("b"))
    return pairs.join(together, ["a", "b"], "left").fillna(0, ["both"]).crossJoin(F.broadcast(total)).withColumnRenamed("n_all", "n")


def converges(counts: DataFrame, most_ratio: float = 0.3, least_expected: float = 5.0, most_p: float = 0.001) -> DataFrame:
    """Pairs seen together far less than chance: observed / expected, one-sided Fisher p."""
    from .stats import fisher

    out = counts.withColumn("expected", F.col("n_a") * F.col("n_b") / F.col("n")).withColumn("ratio", F.col("both") / F.col("expected"))
    out = out.where((F.col("expected") >= least_expected) & (F.col("ratio") < most_ratio))
    p = fisher(F.col("both"), F.col("n_a") - F.col("both"), F.col("n_b") - F.col("both"), F.col("n") - F.col("n_a") - F.col("n_b") + F.col("both"), "less")
    return out.withColumn("p", p).where(F.col("p") < most_p)


def enables(counts: DataFrame, least_lift: float = 1.5, least_asymmetry: float = 1.3, least_both: int = 10, by: str = "lift") -> DataFrame:
    """Directed pairs by lift and its asymmetry.

    Lift is symmetric, so with exact counts none passes; ``by="confidence"``
    compares P(b|a) with P(a|b) instead.
    """
    out = counts.where(F.col("both") >= least_both).withColumn("lift", F.col("both") * F.col("n") / (F.col("n_a") * F.col("n_b")))
    ab, ba = (F.col("both") / F.col("n_a"), F.col("both") / F.col("n_b"))
    forward, back = (ab / (F.col("n_b") / F.col("n")), ba / (F.col("n_a") / F.col("n"))) if by == "lift" else (ab, ba)
    ratio = F.round(forward / F.greatest(back, F.lit(1e-6)), 9)
    out = out.withColumn("asymmetry", F.greatest(ratio, 1 / ratio)).where((F.col("lift") >= least_lift) & (F.col("asymmetry") >= least_asymmetry))
    return out.select(F.when(ratio >= 1, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(ratio >= 1, F.col("b")).otherwise(F.col("a")).alias("target"), "lift", "asymmetry", "both")


def transposes(users: DataFrame, signature: str, user: str, categories: str, least_gap: int = 2, farthest_only: bool = True) -> DataFrame:
    """Users of one signature in different categories: gap = size of the symmetric difference of their category sets.

    Each set of categories is stood for by its least user; with
    ``farthest_only`` a signature keeps its widest gap (ties: least pair).
    """
    one = users.withColumn("__c", F.array_sort(F.array_distinct(categories))).groupBy(signature, "__c").agg(F.min(user).alias("u"))
    left, right = one.select(signature, F.col("u").alias("a"), F.col("__c").alias("ca")), one.select(signature, F.col("u").alias("b"), F.col("__c").alias("cb"))
    gap = F.size(F.array_except("ca", "cb")) + F.size(F.array_except("cb", "ca"))
    out = left.join(right, signature).where("a < b").withColumn("gap", gap).where(F.col("gap") >= least_gap).select(signature, "a", "b", "gap")
    if farthest_only:
        w = Window.partitionBy(signature).orderBy(F.desc("gap"), "a", "b")
        out = out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out


def verified_transposes(pairs: DataFrame, users: DataFrame, user: str, methods: str, refs: str) -> DataFrame:
    """The pairs of ``transposes`` with shared_methods, shared_refs and score = gap + 2 * shared methods + shared refs.

    ``methods`` and ``refs`` are arrays of ``users``, one row a user; a null
    array, or a user without a row, shares nothing.
    """
    known = users.select(user, methods, refs)
    out = pairs
    for end in ("a", "b"):
        out = out.join(known.select(F.col(user).alias(end), F.col(methods).alias(f"m{end}"), F.col(refs).alias(f"r{end}")), end, "left")
    for name, x in (("shared_methods", "m"), ("shared_refs", "r")):
        both = F.array_intersect(f"{x}a", f"{x}b")
        out = out.withColumn(name, F.when(both.isNull(), 0).otherwise(F.size(both)))
    return out.withColumn("score", F.col("gap") + 2 * F.col("shared_methods") + F.col("shared_refs")).select(*pairs.columns, "shared_methods", "shared_refs", "score")


def vote(members: DataFrame, gene_sets: DataFrame, gene: str, set_name: str, channel: str, tiebreak: DataFrame | None = None) -> DataFrame:
    """Each gene's channel by the number of gene sets it shares with the channel's known genes; ties by ``tiebreak`` (gene, channel, n), then name."""
    known = gene_sets.join(members.select(F.col(gene), channel), gene).select(set_name, channel)
    votes = gene_sets.join(members.select(gene), gene, "left_anti").join(known, set_name).groupBy(gene, channel).agg(F.count(F.lit(1)).alias("votes"))
    if tiebreak is not None:
        votes = votes.join(tiebreak.select(gene, channel, F.col("n").alias("__t")), [gene, channel], "left").fillna(0, ["__t"])
    else:
        votes = votes.withColumn("__t", F.lit(0))
    w = Window.partitionBy(gene).orderBy(F.desc("votes"), F.desc("__t"), channel)
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(gene, channel, "votes")


def contradictions(claims: DataFrame, quantity: str, value: str) -> DataFrame:
    """Quantities for which different values are claimed."""
    return claims.groupBy(quantity).agg(F.countDistinct(value).alias("n"), F.array_sort(F.collect_set(value)).alias("values")).where("n > 1")
