"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of at most ``block_words`` words (most are
one block).  A source with target T and S words is passed over T // S times in
full; the rest is drawn without replacement from a permutation of its blocks,
and the block at the border gives just the words that are missing, so the
words taken equal the rounded target.

The blocks that each source owes are an exact quota.  A binary tree over the
output shards splits the vector of quotas: at each node the left half's share
is a multivariate-hypergeometric draw, so each shard ends with an exact number
of blocks of each source and all sum to the quotas.  Shards then take disjoint
runs of the permuted blocks and shuffle them locally.

Ranks within a permutation are found in two levels: blocks fall into buckets
of about max(256, sqrt(n)) by their hash, only totals of buckets are summed
along a source, and rows are ordered within buckets.  So a source with a third
of all rows is spread over many tasks.  The driver holds one row a source
(at most ``max_sources``, else an error says so) and the quotas.

Defined cases: null texts have no words; a null source is a source of its own
and comes last; documents without words are taken 0 times and get their
source's figures; rows of equal doc_id, source and size count as copies, each
with its own row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, free_name, frugal, materialise, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; what is above is shared again.

    The fixed point: min(level * weight, most * size) with one level for all.
    """
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    full, rest = 0.0, float(sum(weights))
    level = 0.0
    for i in order:
        level = (total - full) / rest if rest > 0 else 0.0
        if level * weights[i] <= caps[i]:
            break
        full, rest = full + caps[i], rest - weights[i]
    else:
        level = float("inf")
    return [float(min(level * w, c)) if c else 0.0 for w, c in zip(weights, caps)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A draw at any size; from 10**9 on, where numpy's sampler ends, by the sums of the probabilities around the mode.

    These follow from ratios of neighbours, so they carry the rounding of
    doubles only; what lies beyond 16 deviations has less than 1e-50 in all.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad and draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    reach = int(16 * (draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5) + 64
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def split_tree(quotas: Sequence[int], shards: int, seed: int = 0) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns); rows sum to the quotas, columns differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(sum(quotas))
    ends = [total * k // shards for k in range(shards + 1)]

    def split(low: int, high: int, have: list[int]) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        need, left, pool = ends[middle] - ends[low], [], sum(have)
        for q in have:
            take = hypergeometric(rng, q, pool - q, need)
            left.append(take)
            need, pool = need - take, pool - q
        split(low, middle, left)
        split(middle, high, [q - t for q, t in zip(have, left)])

    if shards and len(quotas):
        split(0, shards, [int(q) for q in quotas])
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), copy: a row for each document; rows that agree in all three are numbered copies."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return narrow.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "source", "size", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 512, max_sources: int = 1_000_000) -> DataFrame:
    """source, source_size, target, blocks: weights repeat over the sources in code point order, null last."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / block_words))).alias("blocks")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    targets = water_fill([r.n for r in rows], w, share * sum(r.n for r in rows), most)
    data = [(r.source, int(r.n), float(t), int(r.blocks)) for r, t in zip(rows, targets)]
    return sizes.sparkSession.createDataFrame(data, "source string, source_size long, target double, blocks long")


def blocks(sizes: DataFrame, targets: DataFrame, block_words: int = 512, seed: int = 0) -> DataFrame:
    """A row for each block: passes in full, words of the last pass (``part``) and its rank in its source's permutation.

    ``last_rank`` counts the blocks with words only, as those without are not drawn in the last pass.

    ``targets`` has a row a source; its size was checked, so it is broadcast.
    """
    wanted = F.floor(F.col("target") + 0.5)
    known = targets.select(
        F.col("source").alias("s"), "source_size", "target", F.col("blocks").alias("source_blocks"),
        F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", (F.floor(F.col("target") + 0.5) - F.col("passes") * F.col("source_size")).cast("long"))
    cut = (
        sizes.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {block_words}))")))
        .withColumn("words", F.expr(f"least({block_words}L, size - block * {block_words})"))
        .withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"), F.col("block").cast("string"))))
        .withColumn("per_bucket", F.greatest(F.lit(256), F.ceil(F.sqrt("source_blocks"))))
        .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("source_blocks") / F.col("per_bucket")) / F.lit(4294967296)).cast("long"))
    )
    cut = cut.select("doc_id", "source", "size", "copy", "source_size", "target", "passes", "rest", "block", "words", "h", "bucket")
    totals = cut.groupBy("source", "bucket").agg(F.sum("words").alias("bw"), F.count(F.lit(1)).alias("bn"), F.sum((F.col("words") > 0).cast("long")).alias("ln"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bw").over(along), F.lit(0)).alias("words_before"), F.coalesce(F.sum("bn").over(along), F.lit(0)).alias("blocks_before"), F.coalesce(F.sum("ln").over(along), F.lit(0)).alias("last_before"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "copy", "block")
    ranked = cut.withColumn("own_words", F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).withColumn("own_rank", F.row_number().over(within) - 1).withColumn("own_last", F.sum((F.col("words") > 0).cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("words") > 0).cast("long"))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("words_before") - F.col("own_words")))
    return joined.select("doc_id", "source", "size", "copy", "source_size", "target", "passes", "block", "words", part.alias("part"), (F.col("blocks_before") + F.col("own_rank")).alias("rank"), (F.col("last_before") + F.col("own_last")).alias("last_rank"), "h")


def draws(plan: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Every drawn block once a pass: doc_id, source, copy, block, pass, n_words, shard, order (the shard's local shuffle).

    ``plan`` is a materialised result of ``blocks``.
    """
    stats = plan.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("passes").alias("passes"), F.sum((F.col("part") > 0).cast("long")).alias("last")).collect()
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    quotas = split_tree([r.n * r.passes + r["last"] for r in stats], shards, seed)
    edges = plan.sparkSession.createDataFrame([(r.source, int(r.n), [int(x) for x in np.cumsum(q)]) for r, q in zip(stats, quotas)], "s string, n long, edges array<long>")
    drawn = plan.withColumn("pass", F.explode(F.expr("filter(sequence(0L, passes), p -> p < passes OR part > 0)"))).withColumn("n_words", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part")))
    placed = drawn.join(F.broadcast(edges), F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.col("pass") * F.col("n") + F.when(F.col("pass") < F.col("passes"), F.col("rank")).otherwise(F.col("last_rank")))
    return placed.select(
        "doc_id", "source", "size", "copy", "source_size", "target", "block", "words", "pass", "n_words",
        F.expr("size(filter(edges, e -> e <= at))").alias("shard"),
        F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), "h", F.col("pass").cast("string"))).alias("order"),
    )


def plan_of(docs: DataFrame, block_words: int = 512, seed: int = 0, **options) -> DataFrame:
    """The materialised blocks of a mix."""
    sizes = materialise(sized(docs), "mix-sizes")
    return materialise(blocks(sizes, source_targets(sizes, block_words=block_words, **options), block_words, seed), "mix-blocks")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    plan = plan_of(docs, **options)
    drawn = draws(plan).select("doc_id", "source", "size", "copy", "source_size", "target", "n_words")
    none = plan.where("block = 0").select("doc_id", "source", "size", "copy", "source_size", "target", F.lit(0).cast("long").alias("n_words"))
    return drawn.unionByName(none).groupBy("doc_id", "source", "size", "copy", "source_size", "target").agg(F.sum("n_words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def cut_text(text: str, parts: list[tuple[int, int]], block_words: int) -> str:
    """The words of the drawn parts (block, words) with the white space that follows them; whole texts stay as they are."""
    starts = [m.start() for m in re.finditer(WORD, text)]
    out = []
    for block, n in sorted(parts):
        first = block * block_words
        end = first + n
        out.append(text[starts[first] if first else 0 : starts[end] if end < len(starts) else len(text)])
    return "".join(out)


def drawn_texts(docs: DataFrame, plan: DataFrame, drawn: DataFrame, by: Sequence[str], block_words: int) -> DataFrame:
    """The rows of ``docs`` with the text of the blocks drawn: one for each pass and value of ``by``.

    With ``by``, its columns and the least ``order`` of the blocks follow the columns of ``docs``.
    """
    columns, more = docs.columns, [*by, "order"] if by else []
    d, s, z, c, parts, size, copy, b, w = (free_name(columns, f"__{n}") for n in ("d", "s", "z", "c", "parts", "size", "copy", "b", "w"))
    first = [F.min("order").alias("order")] if by else []
    per_pass = drawn.groupBy("doc_id", "source", "size", "copy", "pass", *by).agg(F.collect_list(F.struct("block", "n_words")).alias("parts"), F.sum("n_words").alias("n"), *first)
    keyed = docs.select("*", word_count(F.col("text")).alias(size))
    if plan.where("copy > 1").isEmpty():
        keyed = keyed.withColumn(copy, F.lit(1).cast("long"))
    else:
        copies = Window.partitionBy("doc_id", "source", size).orderBy("text")
        keyed = keyed.withColumn(copy, F.row_number().over(copies).cast("long"))
    own = per_pass.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copy").alias(c), F.when(F.col("n") < F.col("size"), F.col("parts")).alias(parts), *more)
    joined = keyed.join(own, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)) & (F.col(copy) == F.col(c)))
    flat = joined.select(*columns, F.transform(parts, lambda x: x["block"]).alias(b), F.transform(parts, lambda x: x["n_words"]).alias(w), *more)
    at, width = columns.index("text"), len(columns)
    schema = StructType([*docs.schema.fields, *(flat.schema[m] for m in more)])
    names = [*columns, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bs, ws = batch.column(at).to_pylist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            out = [t if x is None else cut_text(t, list(zip(x, y)), block_words) for t, x, y in zip(texts, bs, ws)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : width], *batch.columns[width + 2 :]], names=names)

    mixed = flat.mapInArrow(frugal(run), schema)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else mixed


def mixed_documents(docs: DataFrame, block_words: int = 512, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass over a document, with the text of the blocks drawn.

    Full passes give the text unchanged.  ``n_chars`` follows the text.  Copies
    of a row take each the draws of one copy.
    """
    plan = plan_of(docs, block_words=block_words, **options)
    return drawn_texts(docs, plan, draws(plan), [], block_words)


def mixed_shards(docs: DataFrame, shards: int = 40, block_words: int = 512, seed: int = 0, **options) -> DataFrame:
    """The mix as the splitting tree deals it: the columns of ``docs``, then shard and order, sorted by both.

    A row for each pass over a document and each shard that drew blocks of it,
    with the text of these blocks, at the place of the first of them in the
    shard's shuffle.  Columns shard and order of ``docs`` give way.  Rows are
    dealt by ranges of (shard, order), so a shard larger than a task is spread
    over several, in order.
    """
    docs = docs.drop("shard", "order")
    plan = plan_of(docs, block_words, seed, **options)
    return materialise(drawn_texts(docs, plan, draws(plan, shards, seed), ["shard"], block_words), "mix-texts").orderBy("shard", "order")


#: The rows of ``taken`` in SQL: water-filling in closed form, then running words along each source's permutation.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source
), weighted AS (
  SELECT source, n, CASE (i - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0 * n AS cap FROM src
), ordered AS (
  SELECT source, n, w, cap, row_number() OVER (ORDER BY cap / w, source) AS k,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below,
    sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM weighted
), lv AS (
  SELECT (1.5 * (SELECT sum(n) FROM src)::DOUBLE - below) / above AS level FROM ordered
  WHERE (1.5 * (SELECT sum(n) FROM src)::DOUBLE - below) / above * w <= cap ORDER BY k LIMIT 1
), target AS (
  SELECT source, n AS source_size, least(level * w, cap)::DOUBLE AS target FROM weighted, lv
), rest AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS passes FROM target
), cut AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.passes, CAST(floor(r.target + 0.5) AS BIGINT) - r.passes * r.source_size AS rest, b.block,
    least(512, d.size - b.block * 512) AS words, md5('0:' || d.doc_id || ':1:' || b.block) AS h
  FROM sized d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source
  JOIN (SELECT unnest(range(0, (SELECT max(size) // 512 + 1 FROM sized))) AS block) b ON b.block <= greatest(0, (d.size - 1) // 512)
), run AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h, doc_id, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM cut
)
SELECT doc_id, size, source_size, target, CAST(sum(passes * words + greatest(0, least(words, rest - before))) AS BIGINT) AS taken
FROM run GROUP BY doc_id, source, size, source_size, target
"""
