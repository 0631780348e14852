"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step t a character c is written out, and a
random bit of (t, c) says whether the walk moves on to the next character.
Texts at a small edit distance soon walk in step again, so the Hamming
distance of what they write follows their edit distance (Chakraborty,
Goldenberg, Koucky, STOC 2016).  Characters fall into 64 classes by a hash and
the random bits repeat after ``PERIOD`` steps; so a walk is a chain of look-ups
in a fixed table, a few dozen nanoseconds a character.

A fingerprint holds one random bit of what was written at each multiple of
2**level, the level being the least that gives at most ``SAMPLES`` of them in
three times the length.  Levels are nested: a finer fingerprint is compared
with a coarser one on the steps they share.  The likeness of two fingerprints
is twice the share of agreeing bits less one, over the longer of both, held
within 0 and 1.

``near_classes`` finds near duplicates: bit samples over the whole fingerprint
make bands, texts that share a band are candidates, and the likeness of the
whole fingerprints verifies them.

Defined cases: null texts count as empty; the empty text has an empty
fingerprint, like 1 to itself and 0 to others; equal texts have equal
fingerprints; texts of any length are walked to their end; the order of
documents is descending doc_id, then text, null ids last, and the one after
the last is the first (so a lone document follows itself); repeated rows keep
a place each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, texts_of
from .partenum import components

CLASSES, PERIOD, SAMPLES = 64, 4096, 1024
BAND_BITS = 24
#: Bands of a room, the factor between the lengths of rooms, and the side of a tile of pairs.
ROOM_BANDS, GRID, TILE = 40, 1.06, 1024


@lru_cache(1)
def tables() -> tuple[np.ndarray, list[list], np.ndarray]:
    """(class of each code point, states, sampled bit of each step and class).

    ``states[t][c]`` is the state in which the character after one of class c
    begins if that one begins at step t; ``states[t][CLASSES]`` is t itself.
    """
    of = (mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(11)) % np.uint64(CLASSES)).astype(np.uint8)
    cells = mix64(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(1 << 32)).reshape(PERIOD, CLASSES)
    moves = (cells & np.uint64(1)).astype(bool)
    states: list[list] = [[None] * CLASSES + [t] for t in range(PERIOD)]
    for c in range(CLASSES):
        at = np.flatnonzero(moves[:, c])
        nxt = at[np.searchsorted(at, np.arange(PERIOD)) % len(at)]
        for t in range(PERIOD):
            states[t][c] = states[(int(nxt[t]) + 1) % PERIOD]
    return of, states, ((cells >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)


def classes_of(text: str) -> bytes:
    return tables()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes()


def walk(classes: bytes, begin: int = 0) -> np.ndarray:
    """The step at which each character begins, and the one after the last ends, from step ``begin``."""
    states = tables()[1]
    steps = np.fromiter(map(itemgetter(CLASSES), accumulate(classes, getitem, initial=states[begin % PERIOD])), np.int64, len(classes) + 1)
    gaps = np.diff(steps)
    gaps[gaps <= 0] += PERIOD
    return begin + np.concatenate([[0], np.cumsum(gaps)])


def level_of(n: int) -> int:
    return max(0, (max(1, (3 * n + SAMPLES - 1) // SAMPLES) - 1).bit_length())


def sample(classes: bytes, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, sampled bits) of a walked text."""
    level = level_of(len(classes))
    at = np.arange(0, int(steps[-1]), 1 << level)
    if not len(classes):
        return 0, np.empty(0, np.uint8)
    active = np.searchsorted(steps, at, "right") - 1
    return level, tables()[2][mix_steps(at), np.frombuffer(classes, np.uint8)[active]]


def mix_steps(at: np.ndarray) -> np.ndarray:
    """The row of the table of sampled bits for a step, so that multiples of a power of two use all rows."""
    return (mix64(at.astype(np.uint64)) % np.uint64(PERIOD)).astype(np.int64)


def pack(level: int, bits: np.ndarray) -> str:
    return f"{level:02x}{len(bits):04x}{np.packbits(bits).tobytes().hex()}"


def unpack(print_: str) -> tuple[int, np.ndarray]:
    n = int(print_[2:6], 16)
    return int(print_[:2], 16), np.unpackbits(np.frombuffer(bytes.fromhex(print_[6:]), np.uint8))[:n]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1; of the steps that both fingerprints sample."""
    (la, x), (lb, y) = a, b
    level = max(la, lb)
    x, y = x[:: 1 << (level - la)], y[:: 1 << (level - lb)]
    if not len(x) and not len(y):
        return 1.0
    n = min(len(x), len(y))
    agree = int((x[:n] == y[:n]).sum())
    return max(0.0, (2 * agree - n) / max(len(x), len(y)))


def fingerprint_of(text: str) -> str:
    c = classes_of(text)
    return pack(*sample(c, walk(c)))


def edit_text(text: str, following: str) -> str:
    """The last third of the code points (rounded down) gives way to as many of the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


# --- operators -------------------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint_of(t) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def rooms_of(n: int, least: float) -> np.ndarray:
    """Lengths, from a grid common to all fingerprints, within which bands of a fingerprint of n bits pick.

    Fingerprints with a likeness of at least ``least`` differ in length by that
    factor at most, so the greatest grid length within the shorter one is among
    those of both: bands see the whole of what the two share, up to the factor
    of the grid.
    """
    grid = np.unique((GRID ** np.arange(int(np.log(max(n, 2)) / np.log(GRID)) + 2)).astype(np.int64))
    return grid[(grid >= least * n / GRID - 1) & (grid <= n)]


@lru_cache(10_000)
def positions(room: int) -> np.ndarray:
    """The bits of each band within a room."""
    at = np.arange(ROOM_BANDS * BAND_BITS, dtype=np.uint64) + np.uint64(77 + (room << 20))
    return (mix64(at) % np.uint64(room)).astype(np.int64)


def bands_of(print_: str, least: float = 0.8) -> list[int]:
    """Band keys at the fingerprint's level and the next coarser one, so texts on both sides of a change of level meet.

    Bands pick from the whole fingerprint, by rooms of the lengths it may share.
    """
    level, bits = unpack(print_)
    out = []
    for up in (0, 1):
        own = bits[:: 1 << up]
        for room in rooms_of(len(own), least).tolist():
            for k, row in enumerate(np.packbits(own[positions(room)].reshape(ROOM_BANDS, BAND_BITS), axis=1)):
                out.append(int.from_bytes(hashlib.blake2b(b"%d,%d,%d,%b" % (level + up, room, k, row.tobytes()), digest_size=8).digest(), "little", signed=True))
    return out


def tile_pairs(prints: list[str], left: np.ndarray, right: np.ndarray, open_: Callable[[int, np.ndarray], np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs (x, y) of ``left`` and ``right`` (places in ``prints``) with the least likeness; ``open_`` picks the y to try for an x."""
    own = [unpack(p) for p in prints]
    level, padded = np.array([v for v, _ in own]), {}
    for v in sorted(set(level.tolist())):
        cut = [b[:: 1 << (v - u)] if u <= v else b[:0] for u, b in own]
        size = np.array([len(b) for b in cut])
        bits = np.full((len(own), size.max(initial=0)), 2, np.uint8)
        for row, b in zip(bits, cut):
            row[: len(b)] = b
        padded[v] = size, bits
    for x in left:
        tried = open_(x, right)
        for v, (size, bits) in padded.items():
            y = tried[np.maximum(level[tried], level[x]) == v]
            n = size[x]
            agree = (bits[y, :n] == bits[x, :n]).sum(1)
            short, long = np.minimum(size[y], n), np.maximum(size[y], n)
            like = np.where(long > 0, np.maximum(0, (2 * agree - short) / np.maximum(long, 1)), 1.0)
            yield from ((int(x), int(k)) for k in y[like >= least])


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, links: near duplicates by banding and verification of fingerprints.

    Equal fingerprints are one vertex.  In each band every member is compared
    with the least id and with the member before it in the order of
    fingerprints, which settles most bands in linear time.  Where members of a
    band still lie in several components, all pairs between components are
    compared, in tiles.  Links are those verified.
    """
    prints = materialise(fingerprints(docs), "prints").where("doc_id IS NOT NULL")
    reps = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "print-reps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands_of(p, least) for p in batch.column(0).to_pylist()]
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([k for row in keys for k in row], pa.int64()), batch.column(1).take(pa.array(np.repeat(np.arange(len(n)), n)))], names=["band", "rep"])

    banded = reps.mapInArrow(run, "band long, rep long").distinct()
    leads = materialise(banded.groupBy("band").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("k"), "lead"), "band-leads")
    named = reps.select(F.col("rep").alias("r"), F.col("fingerprint").alias("p"))
    members = materialise(banded.join(leads, F.col("band") == F.col("k")).select("band", "rep", "lead"), "band-members")
    before = F.lag("rep").over(Window.partitionBy("band").orderBy("p", "rep"))
    pairs = members.join(named, F.col("rep") == F.col("r")).withColumn("before", before).select("rep", F.explode(F.array_distinct(F.array_compact(F.array("lead", "before")))).alias("other"))
    pairs = pairs.where("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(end), F.col("fingerprint").alias(f"p{end}")), end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if likeness(unpack(x), unpack(y)) >= least]
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    links = materialise(pairs.select("a", "b", "pa", "pb").mapInArrow(verify, "a long, b long"), "print-links")
    labels = components(links).select(F.col("v").alias("rep"), "c")
    placed = materialise(members.select("band", "rep").join(labels, "rep", "left").withColumn("c", F.coalesce("c", "rep")), "band-components")
    open_bands = placed.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 2 AND c0 <> c1").select("band", "m")
    ranked = placed.join(open_bands, "band").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # A pair is compared in the least of its common bands only.
    listed = ranked.groupBy("rep").agg(F.collect_list("band").alias("bands"))
    sides = ranked.join(listed, "rep").join(named, F.col("rep") == F.col("r")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    sides = sides.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "c", "p", "bands")

    def tiles(key: tuple, group: pa.Table) -> pa.Table:
        band, i, j = (k.as_py() for k in key)
        tile, rep, c = (group.column(x).to_numpy() for x in ("tile", "rep", "c"))
        bands = [set(b) for b in group.column("bands").to_pylist()]
        other = lambda x, y: y[(c[y] != c[x]) & ((rep[y] > rep[x]) if i == j else True)]
        found = tile_pairs(group.column("p").to_pylist(), np.flatnonzero(tile == i), np.flatnonzero(tile == j), other, least)
        out = [(min(rep[x], rep[y]), max(rep[x], rep[y])) for x, y in found if min(bands[x] & bands[y]) == band]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    more = materialise(sides.groupBy("band", "i", "j").applyInArrow(tiles, "a long, b long"), "print-more-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links).select(F.col("v").alias("rep"), "c")
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    own = reps.join(labels, "rep", "left").join(degree, "rep", "left")
    return prints.join(own, "fingerprint").select("doc_id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` beside the one that follows it: fingerprints of both and of the edited text.

    Ids are cut at quantiles into runs; the first row of each run is also sent
    to the run before it, so a run is read from start to end in one task
    without any window over the whole table.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = 4 * width
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [(i + 1) / runs for i in range(runs - 1)] or [0.5], 20 * runs).alias("cuts")).collect()[0]
    cuts = np.array(sorted({c for c in stats.cuts or [] if c > stats.low}), np.int64)

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            own = np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), ids], names=["run", "doc_id"])

    # One row for each run, so at most ``runs`` of them.
    firsts = rows.select("doc_id").mapInArrow(run_of, "run long, doc_id long").groupBy("run").agg(F.max("doc_id").alias("first")).collect()
    ahead = {r["first"]: (r.run + 1) % (len(cuts) + 1) for r in firsts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            own = np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            copies = [i for i, d in enumerate(ids.to_pylist()) if d in ahead]
            names = ["run", "ahead", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.zeros(len(own), np.int32)), ids, batch.column(1)], names=names)
            if copies:
                part = batch.take(pa.array(copies, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([ahead[d] for d in part.column(0).to_pylist()], pa.int64()), pa.array(np.ones(len(copies), np.int32)), part.column(0), part.column(1)], names=names)

    placed = rows.mapInArrow(place, "run long, ahead int, doc_id long, text string").repartition(width, "run").sortWithinPartitions("run", "ahead", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def pair(now: tuple, after: tuple) -> tuple:
        """The result for a document (id, text, classes, steps, sample) and the one after it."""
        doc_id, text, classes, steps, own = now
        edited = edit_text(text, after[1])
        kept = len(text) - len(text) // 3
        tail = after[2][: len(text) // 3]
        all_steps = np.concatenate([steps[:kept], walk(tail, int(steps[kept]))])
        other = sample(classes[:kept] + tail, all_steps)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(*own), pack(*other), likeness(own, other), likeness(own, after[4])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, done, out = None, None, False, []
        for batch in batches:
            for run_, ahead_, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, "text")):
                if run_ != at:
                    at, now, done = run_, None, False
                if done:
                    continue
                classes = classes_of(text)
                steps = walk(classes)
                row = doc_id, text, classes, steps, sample(classes, steps)
                if now is not None:
                    out.append(pair(now, row))
                now, done = row, bool(ahead_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))
                out = []

    return placed.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
