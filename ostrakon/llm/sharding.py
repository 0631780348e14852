"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together.  A group is an item of its own if it is
large (more than one part in ``shards * bundles`` of a total); groups above
``whole_share`` of a shard's capacity are split into pieces by a hash of the
id; all small groups are bundled by a hash of their text into
``shards * bundles`` bundles.  So the number of items is bounded by the
parameters, not by the data, and the driver may pack them: in falling size,
each goes to the shard where the dot product of its vector with the shard's
residual capacity is highest; a last step swaps items while the largest and
the smallest shard in bytes come closer.

Slots are gapless in two levels: an item starts where the items before it in
its shard end, and rows are numbered within items.  So no task holds a shard.

Defined cases: null texts count as empty (16 bytes, no tokens, one group);
repeated rows keep a slot each; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

DIMENSIONS = ("size", "tokens", "one")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of ``vectors``): largest first, to the highest dot product with what is left."""
    total = vectors.sum(0)
    unit = vectors / np.maximum(total / shards, 1e-12)
    left = np.where(total > 0, 1.0, 0.0) * np.ones((shards, 1))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(unit)), -unit.sum(1), -unit.max(1, initial=0))):
        k = int(np.argmax(left @ unit[i]))
        out[i] = k
        left[k] -= unit[i]
    return out


def even_out(vectors: np.ndarray, where: np.ndarray, shards: int, near: float = 0.002, most_steps: int = 2000) -> np.ndarray:
    """Swap or move items between the shards with most and fewest bytes while that brings the two closer.

    Items are few (bounded by the parameters), so this runs on the driver.
    """
    where, sizes = where.copy(), vectors[:, 0]
    loads = np.bincount(where, sizes, minlength=shards)
    goal = max(loads.mean(), 1e-12)
    for _ in range(most_steps):
        high, low = int(loads.argmax()), int(loads.argmin())
        gap = loads[high] - loads[low]
        if gap <= near * goal:
            break
        ours, theirs = np.flatnonzero(where == high), np.append(np.flatnonzero(where == low), -1)
        theirs = theirs[np.argsort(np.append(sizes, 0.0)[theirs], kind="stable")]
        have = np.append(sizes, 0.0)[theirs]
        at = np.searchsorted(have, sizes[ours] - gap / 2)
        best = None
        for shift in (-1, 0):
            j = np.clip(at + shift, 0, len(have) - 1)
            moved = sizes[ours] - have[j]
            off = np.abs(moved - gap / 2)
            i = int(off.argmin())
            if 0 < moved[i] < gap and (best is None or off[i] < best[0]):
                best = off[i], ours[i], theirs[j[i]], moved[i]
        if best is None:
            break
        where[best[1]] = low
        if best[2] >= 0:
            where[best[2]] = high
        loads[high] -= best[3]
        loads[low] += best[3]
    return where


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and the digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def assign(docs: DataFrame, shards: int = 40, bundles: int = 512, whole_share: float = 0.5) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    rows = materialise(measured(docs), "shard-rows").withColumn("one", F.lit(1).cast("long"))
    groups = rows.groupBy("digest").agg(*(F.sum(c).alias(c) for c in DIMENSIONS))
    totals = rows.agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).collect()[0]
    capacity = {c: max((totals[c] or 0) / shards, 1e-12) for c in DIMENSIONS}
    small = shards * bundles
    weight = F.greatest(*(F.col(c) / F.lit(capacity[c]) for c in DIMENSIONS))
    # At most three times ``small`` groups can exceed their share of some total.
    large = groups.withColumn("share", weight).where(F.col("share") > 1 / bundles).orderBy("digest").select("digest", "share").collect()
    first, table = small, []
    for g in large:
        pieces = 1 if g.share <= whole_share else int(np.ceil(g.share / whole_share)) * 4
        table.append((bytes(g.digest), first, pieces))
        first += pieces
    big = spark.createDataFrame(table, "digest binary, first long, pieces int")
    item = F.coalesce(F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.pmod(F.xxhash64("digest"), F.lit(small)))
    placed = rows.join(F.broadcast(big), "digest", "left").withColumn("item", item.cast("long")).drop("first", "pieces")
    items = placed.groupBy("item").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).orderBy("item").collect()
    vectors = np.array([[r[c] for c in DIMENSIONS] for r in items], float).reshape(-1, 3)
    where = even_out(vectors, pack(vectors, shards), shards)
    begin, starts = [0] * shards, []
    for r, k in zip(items, where):
        starts.append((r.item, int(k), begin[k]))
        begin[k] += r.one
    plan = spark.createDataFrame(starts, "item long, shard int, start long")
    within = Window.partitionBy("item").orderBy("doc_id", "text_crc32", "size")
    return placed.join(F.broadcast(plan), "item").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.row_number().over(within) - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """``assign`` with its law: the sizes of shards are near equal."""
    return assign(docs, shards, **options).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
