"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct word shingles.  Sets fall into bands of
near-equal sizes; two sets that reach the similarity lie in one band or in
neighbouring ones, and then differ in at most k elements, k following from the
larger size of the band.  For each window of two bands the feature domain is
partitioned by a hash into n1 groups of n2 cells; of every group all subsets
of n2 - k2 cells are enumerated, and the part of the set that falls into such
a subset is a signature.  A group with more than k2 differing elements is bad,
so of a pair that differs in d elements at most d / (k2 + 1) groups are bad,
and the two sets agree on a subset of every other group.  A window takes the
form with the fewest signatures that cover enough elements each: only such
signatures tell sets apart.

Signatures over nothing, or over common shingles only, say little.  A set
leaves them out if they touch fewer groups than are good for certain: another
good group then holds a shared signature (see ``signatures``).  How many are
good for certain follows from the set's own size, as its partners are bounded
by it; so the smaller sets of a window, which have the most empty signatures,
can leave out the most.  Nothing is lost, and boiler plate makes no large
buckets.  Which shingles are common is told by a bounded sample of documents;
it decides what is left out, never what is found.

Work on buckets is linear in their size: members are compared with the
bucket's least id; a bucket whose members all end in one component is done.
Only of the others are the remaining pairs examined, in tiles of bounded size,
by bitmaps whose Hamming distance is a lower bound, and then exactly; tiles
that lie in the bucket's largest component are not set against each other.
Equal sets are one vertex, so a large group of copies costs a row a member.

Components come from alternating star contraction on the links; neither links
nor components reach the driver.

Defined cases: null and empty texts have no shingles and link with nothing;
texts with fewer words than a shingle have their whole sequence as the only
one; rows with one doc_id are one vertex if their texts are equal, and take the
least of their components if not; a null doc_id is its own component (null); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bytes_of, free_name, frugal, hash_words, materialise, mix64, small_batches

#: Documents in the sample that tells common shingles, and in how many of them such a shingle occurs.
SAMPLE, COMMON = 4000, 8
#: From so many members in one map batch on, a signature is combined there: only its least id travels.
COMBINED = 128
#: Ids up to this number are broadcast to pick texts (16 MB); beyond it texts are picked by a shuffle join.
MOST_BROADCAST = 1_000_000
TILE, SALT = 1024, 16
#: Signatures of a window: at most so many an element of its largest sets, or FEW if that is more; how many elements of its
#: smallest sets they should cover; the share of groups beyond the fewest possible.
COST, FEW, COVER, SPARE = 0.4, 60, 3.5, 0.04

U64 = np.uint64


class Scheme:
    """Bands, windows and their parameters for a similarity of ``num / den``."""

    def __init__(self, num: int = 85, den: int = 100, words: int = 4):
        self.num, self.den, self.words = num, den, words
        self.upper = [0]
        while self.upper[-1] < 1 << 40:
            low = self.upper[-1] + 1
            self.upper.append(low * den // num)
        self.uppers = np.array(self.upper[1:])

    def linked(self, common: int, union: int) -> bool:
        return self.den * common >= self.num * union

    def may_link(self, differing, total):
        """Whether sets of ``total`` elements together that differ in so many may reach the similarity."""
        return (self.num + self.den) * differing <= (self.den - self.num) * total

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.uppers, n))

    def most_differing(self, total: int) -> int:
        """In how many elements two linked sets of ``total`` elements together may differ."""
        return (self.den - self.num) * total // (self.num + self.den)

    @cache
    def window(self, i: int) -> tuple[int, int, int]:
        """(n1, n2, k2) for the sets of bands i - 1 and i.

        Of the forms with few signatures the one whose signatures cover most;
        if that is not ``COVER`` elements of the smallest sets, the form with
        the fewest signatures that cover so many; if there is none, the one
        that covers most.
        """
        upper = int(self.uppers[i])
        k = self.most_differing(2 * upper)
        if not k:
            return 1, 1, 0
        least, forms = self.upper[max(0, i - 1)] + 1, []
        for k2 in range(1, 7):
            fewest = k // (k2 + 1) + 1
            n1 = fewest if fewest == 1 else fewest + ceil(SPARE * fewest)
            forms += [(least * (n2 - k2) / (n1 * n2), n1 * comb(n2, k2), n1, n2, k2) for n2 in range(k2 + 1, 13)]
        forms = [f for f in forms if f[1] <= max(FEW, COST * upper)]
        if not forms:
            return k // 2 + 1, 2, 1
        most = lambda f: (f[0], -f[1])
        best = max((f for f in forms if f[1] <= FEW), key=most, default=(0.0,))
        if best[0] < COVER:
            best = min((f for f in forms if f[0] >= COVER), key=lambda f: (f[1], -f[0]), default=max(forms, key=most))
        return best[2:]

    def spare(self, n: int, i: int) -> int:
        """How many of its good groups a set of ``n`` elements can do without in window ``i``, whichever its partner."""
        n1, _, k2 = self.window(i)
        return n1 - 1 - self.most_differing(n + min(int(self.uppers[i]), n * self.den // self.num)) // (k2 + 1)


def shingles(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles (A-Z in lower case)."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, U64)
    h = hash_words(tokens, known)
    known.trim()
    n = len(h)
    width = min(n, words)
    out = np.full(n - width + 1, width, U64)
    for i in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i]
    return np.unique(mix64(out))


def signatures(elements: np.ndarray, scheme: Scheme, common: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set in its two windows.

    A set A agrees with any partner B on some subset in 1 + e groups or more,
    e being what A can spare; B has an e of its own.  Let a signature be weak
    if it has no element but common ones.  If weak signatures touch at most e
    groups of A, one good group has none in A; the subset shared there is not
    weak, in A as in B, and both emit it.  If they touch more groups of both,
    the same holds for empty signatures; and if these touch more than e groups
    of both, both emit all.
    """
    if not len(elements):
        return np.empty(0, U64)
    band, out = scheme.band(len(elements)), []
    rare = np.ones(len(elements), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] != elements
    for i in (band, band + 1):
        n1, n2, k2 = scheme.window(i)
        e = scheme.spare(len(elements), i)
        cells = n1 * n2
        salted = mix64(elements + U64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        cell = ((salted >> U64(32)) * U64(cells) >> U64(32)).astype(np.int64)
        counts = np.bincount(cell, minlength=cells).reshape(n1, n2)
        order = np.argsort(cell, kind="stable")
        running = np.concatenate([np.zeros(1, U64), np.cumsum(salted[order], dtype=U64)])
        ends = np.cumsum(counts.ravel())
        sums = (running[ends] - running[ends - counts.ravel()]).reshape(n1, n2)
        subsets = list(combinations(range(n2), n2 - k2))
        told_by = np.bincount(cell[rare], minlength=cells).reshape(n1, n2)
        held = [np.stack([c[:, s].sum(1) for s in subsets], 1) == 0 for c in (told_by, counts)]
        told = np.stack([sums[:, s].sum(1, dtype=U64) for s in subsets], 1)
        place = (np.arange(n1 * len(subsets), dtype=U64) + U64(i << 40)).reshape(n1, len(subsets))
        marks = mix64(told * U64(0xA24BAED4963EE407) + mix64(place))
        for weak in held:
            if weak.any(1).sum() <= e:
                marks = marks[~weak]
                break
        out.append(marks.ravel())
    return np.concatenate(out)


def bitmap(elements: np.ndarray) -> bytes:
    """A bit for each element's hash, 8 to 16 bits an element; widths are powers of two."""
    width = max(64, 1 << int(8 * max(1, len(elements)) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(elements & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) as they would be at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), 1)


def differing(a: bytes, b: bytes) -> int:
    """At least so many elements are in one of the sets only."""
    width = min(len(a), len(b))
    a, b = (int.from_bytes(x if len(x) == width else fold(np.frombuffer(x, np.uint8)[None], width).tobytes(), "little") for x in (a, b))
    return (a ^ b).bit_count()


# --- map and reduce of signatures -------------------------------------------

_MAPPED = "part int, kind int, a long, n long, key binary, blob binary"
_REDUCED = "kind int, a long, b long, n long, key binary, blob binary"
_PAIR = np.dtype([("sig", "<u8"), ("id", "<i8")])
#: Kinds of rows: documents, signatures on their way, stars within a map task's batch, stars among those batches.
DOC, SENT, LOCAL, GLOBAL = 0, 1, 2, 3


def _stars(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by signature: (sig, id, least id of the signature, members of the signature), sorted."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(sig)))
    return sig, ids, np.repeat(ids[first], size), np.repeat(size, size)


def _mapper(scheme: Scheme, parts: int, common, combined: int, most: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["part", "kind", "a", "n", "key", "blob"])

        def flush(sigs: list[np.ndarray], ids: list[int], lengths: list[int]) -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig, who, lead, size = _stars(np.concatenate(sigs), np.repeat(np.array(ids, np.int64), lengths))
            leads = (who == lead) | (size < combined)
            dup = np.concatenate([[False], (sig[1:] == sig[:-1]) & (who[1:] == who[:-1])])
            sent = np.empty(int((leads & ~dup).sum()), _PAIR)
            sent["sig"], sent["id"] = sig[leads & ~dup], who[leads & ~dup]
            part = (sent["sig"] % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sent, ends = sent[order], np.cumsum(np.bincount(part, minlength=parts))
            out = [(p, SENT, None, None, None, sent[e - n : e].tobytes()) for p, (e, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n]
            rest = ~leads & ~dup
            local = np.unique(np.stack([who[rest], lead[rest]], 1), axis=0)
            spread = (mix64(local[:, 0].view(U64)) % U64(parts)).tolist()
            out += [(p, LOCAL, a, b, None, None) for p, (a, b) in zip(spread, local.tolist())]
            for i in range(0, len(out), 1024):
                yield rows(out[i : i + 1024])

        sigs, ids, lengths, total, seen = [], [], [], 0, set()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text")):
                s = shingles(text, scheme.words, known)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append(((0 if doc_id is None else int(doc_id) * 0x9E3779B1) % parts, DOC, doc_id, len(s), key, bitmap(s) if len(s) else None))
                if len(s) and doc_id is not None and key not in seen:
                    seen.add(key)
                    marks = signatures(s, scheme, common.value)
                    sigs.append(marks)
                    ids.append(doc_id)
                    lengths.append(len(marks))
                    total += len(marks)
                if total > most:
                    yield from flush(sigs, ids, lengths)
                    sigs, ids, lengths, total = [], [], [], 0
            for i in range(0, len(out), 4096):
                yield rows(out[i : i + 4096])
        yield from flush(sigs, ids, lengths)

    return run


def _reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part follow each other; stars are pairs of a member and its signature's least id."""
    names = ["kind", "a", "b", "n", "key", "blob"]
    at, blobs = None, []

    def stars(pairs: np.ndarray, kind: int) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        if blobs:
            sent = np.frombuffer(b"".join(blobs), _PAIR)
            sig, ids, lead, _ = _stars(sent["sig"], sent["id"])
            many = ids != lead
            if many.any():
                yield stars(np.stack([ids[many], lead[many]], 1), GLOBAL)

    for batch in batches:
        part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        docs = np.flatnonzero(kind == DOC)
        if len(docs):
            b = batch.take(pa.array(docs))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.nulls(len(docs), pa.int64()), b.column(3), b.column(4), b.column(5)], names=names)
        local = np.flatnonzero(kind == LOCAL)
        if len(local):
            b = batch.take(pa.array(local))
            yield stars(np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], 1), LOCAL)
        for i in np.flatnonzero(kind == SENT):
            if part[i] != at:
                yield from flush()
                at, blobs = part[i], []
            blobs.append(batch.column(5)[int(i)].as_py())
    yield from flush()


# --- graph ------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """v, c: the least vertex that each vertex of ``edges`` (a, b) reaches, by alternating large and small stars.

    The rounds grow with the logarithm of the number of edges; the bound on them, far beyond what chains need, only keeps a fault from running for ever.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state, left = None, 40 + 10 * now.count().bit_length()
    while left:
        left -= 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).collect()[0]
        if tuple(seen) == state:
            return now.select(F.col("u").alias("v"), F.col("v").alias("c"))
        state = tuple(seen)
    raise RuntimeError("components did not settle")


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pairs`` (a, b, ...) with ca, cb: the components of both ends."""
    if labels is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    for end in ("a", "b"):
        own = labels.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs


class Join:
    """One run of the join over a table with doc_id and text."""

    def __init__(self, docs: DataFrame, scheme: Scheme):
        small_batches(docs.sparkSession)
        self.docs, self.scheme, self.spark = docs.select("doc_id", "text"), scheme, docs.sparkSession
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = 4 * width
        common = self.spark.sparkContext.broadcast(self.common_shingles())
        mapped = self.docs.mapInArrow(frugal(_mapper(scheme, parts, common, COMBINED)), _MAPPED)
        all_ = materialise(mapped.repartition(width, "part").sortWithinPartitions("part").mapInArrow(frugal(_reducer), _REDUCED), "partenum")
        self.rows = all_.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), "n", "key", F.col("blob").alias("bits"))
        self.stars = all_.where(F.col("kind").isin(LOCAL, GLOBAL)).select("kind", "a", "b").distinct()
        # One vertex for equal sets: the least id that has the set.
        keyed = self.rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
        reps = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        self.reps = materialise(reps, "reps")
        self.member = materialise(keyed.select("doc_id", "key").join(self.reps.select("key", "rep"), "key").select("doc_id", "rep").distinct(), "members")
        self.labels: DataFrame | None = None
        self.links: DataFrame | None = None

    def common_shingles(self) -> np.ndarray:
        """The shingles that at least ``COMMON`` of about ``SAMPLE`` documents hold; at most SAMPLE / COMMON times the shingles of a document."""
        scheme, every = self.scheme, max(1, self.docs.count() // SAMPLE)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                found = [shingles(t, scheme.words, known) for t in bytes_of(batch, "text")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, U64), *found]).view("<i8"))], names=["s"])

        sample = self.docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        rows = sample.mapInArrow(frugal(run), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("s").toArrow()
        return np.sort(rows.column("s").to_numpy().astype("<i8").view(U64))

    def to_reps(self, stars: DataFrame) -> DataFrame:
        """Stars (kind, a member, b least id) between vertices."""
        for end in ("a", "b"):
            own = self.member.select(F.col("doc_id").alias(end), F.col("rep").alias(f"r{end}"))
            stars = stars.join(own, end)
        return stars.select("kind", F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of vertices those that bitmaps cannot rule out, with the least possible number of differing elements."""
        scheme = self.scheme
        sides = pairs
        for end in ("a", "b"):
            own = self.reps.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"s{end}"))
            sides = sides.join(own, end)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
                d = [differing(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
                keep = [i for i, (x, y, z) in enumerate(zip(na, nb, d)) if scheme.may_link(z, x + y) and scheme.linked(min(x, y), max(x, y))]
                got = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array([d[i] for i in keep], pa.int64())], names=["a", "b", "d"])

        return sides.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(frugal(run), "a long, b long, d long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of vertices that reach the similarity, by their sets."""
        scheme = self.scheme
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        few = wanted.count() <= MOST_BROADCAST
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, self.docs["doc_id"] == wanted["id"], "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, scheme.words, known).tobytes() for t in bytes_of(part, "text")], pa.binary())], names=["id", "s"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(batch.column(k)[i].as_py(), U64) for k in (2, 3))
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if scheme.linked(common, len(both) - common):
                        keep.append(i)
                got = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

        known = texts.mapInArrow(frugal(sets), "id long, s binary")
        first = pairs.select("a", "b").join(known.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        second = first.join(known.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return second.select("a", "b", "sa", "sb").mapInArrow(frugal(run), "a long, b long").distinct()

    def link(self, near: DataFrame) -> None:
        """Add the links among ``near`` (a, b, d; materialised) that join components.

        First each vertex tries its nearest partner, which settles most; then
        what still lies between two components is tried.
        """
        ends = near.select(F.col("a").alias("x"), "a", "b", "d").unionByName(near.select(F.col("b").alias("x"), "a", "b", "d"))
        best = materialise(ends.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "nearest")
        self._add(self.verified(best))
        rest = _labelled(near.join(best, ["a", "b"], "left_anti"), self.labels).where("ca <> cb").select("a", "b")
        rest = materialise(rest, "rest")
        if not rest.isEmpty():
            self._add(self.verified(rest))

    def _add(self, found: DataFrame) -> None:
        found = materialise(found, "links")
        if found.isEmpty():
            return
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = components(self.links)

    def unsettled(self, stars: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs of vertices that may share a signature, lie in two components and were not tested, and pass the bitmaps.

        All who share a signature lie around one centre, the least of the
        signature's least ids: next to it, or behind the least id of their
        batch.  Centres whose surroundings are one component are done.
        """
        scheme = self.scheme
        local = stars.where(F.col("kind") == LOCAL).select(F.col("b").alias("via"), F.col("a").alias("id"))
        far = stars.where(F.col("kind") == GLOBAL).select(F.col("a").alias("via"), F.col("b").alias("sig")).join(local, "via").select("sig", "id")
        around = stars.select(F.col("b").alias("sig"), F.col("a").alias("id")).unionByName(far)
        around = around.unionByName(stars.select(F.col("b").alias("sig"), F.col("b").alias("id"))).distinct()
        if self.labels is not None:
            around = around.join(self.labels.select(F.col("v").alias("id"), "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        else:
            around = around.withColumn("c", F.col("id"))
        around = materialise(around.select("sig", "id", "c"), "around")
        sizes = around.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("m"))
        open_ = sizes.groupBy("sig").agg(F.sum("m").alias("all"), F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("k")).where("all > 2 AND k > 1")
        open_ = open_.select("sig", F.col("top.c").alias("c0"), F.ceil(F.col("top.m") / TILE).cast("int").alias("t0"), F.ceil((F.col("all") - F.col("top.m")) / TILE).cast("int").alias("t1"))
        # A centre's members are dealt over several tasks, as one centre may have very many.
        salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
        ranked = around.withColumn("salt", salt).join(open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["sig", "salt"]).drop("salt")
        # Tiles of the largest component come first, then those of the others.
        ranked = ranked.withColumn("tile", F.expr("int(if(c = c0, pmod(xxhash64(id), t0), t0 + pmod(xxhash64(id), t1)))"))
        # A pair is looked at around the least of its common centres only.
        listed = ranked.groupBy("id").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))
        sides = ranked.join(listed, "id").join(self.reps.select(F.col("rep").alias("id"), "n", "bits"), "id")
        meets = F.expr("if(tile < t0, sequence(t0, t0 + t1 - 1), sequence(0, t0 + t1 - 1))")
        sides = sides.withColumn("other", F.explode(meets)).select("sig", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "n", "bits", "c", "sigs")

        def tiles(key: tuple, group: pa.Table) -> pa.Table:
            sig, i, j = (k.as_py() for k in key)
            width = min(map(len, group.column("bits").to_pylist()))
            bits = np.vstack([fold(np.frombuffer(b, np.uint8)[None], width) for b in group.column("bits").to_pylist()])
            tile, ids, n, c = (group.column(x).to_numpy() for x in ("tile", "id", "n", "c"))
            buckets = [set(s) for s in group.column("sigs").to_pylist()]
            left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            out = []
            for x in left:
                y = right[(c[right] != c[x]) & ((ids[right] > ids[x]) if i == j else True)]
                d = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
                small, large = np.minimum(n[y], n[x]), np.maximum(n[y], n[x])
                good = scheme.may_link(d, n[y] + n[x]) & (scheme.den * small >= scheme.num * large)
                out += [(min(ids[x], ids[k]), max(ids[x], ids[k]), v) for k, v in zip(y[good], d[good]) if min(buckets[x] & buckets[k]) == sig]
            return pa.table({k: pa.array([r[t] for r in out], pa.int64()) for t, k in enumerate("abd")})

        found = sides.groupBy("sig", "i", "j").applyInArrow(tiles, "a long, b long, d long")
        return found.join(tested, ["a", "b"], "left_anti")

    def run(self) -> None:
        stars = materialise(self.to_reps(self.stars), "stars")
        tested = materialise(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
        self.link(materialise(self.near(tested), "near"))
        more = materialise(self.unsettled(stars, tested), "unsettled")
        if not more.isEmpty():
            self.link(more)

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        own = self.member
        if self.labels is not None:
            own = own.join(self.labels.select(F.col("v").alias("rep"), "c"), "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("c"))
        else:
            own = own.select("doc_id", F.col("rep").alias("c"))
        own = own.groupBy("doc_id").agg(F.min("c").alias("c"))
        return self.rows.select("doc_id", "n").join(own, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def _copies(docs: DataFrame) -> DataFrame | None:
    """doc_id, first: the rows whose text a row with a lesser id has; None if there are none, or if ids repeat."""
    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("h"))
    hashed = materialise(hashed, "text-hashes")
    if not hashed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    # A text's copies are dealt over several tasks, as one text may have very many.
    dealt = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    found = materialise(dealt.join(groups, ["h", "salt"]).where("doc_id <> first").select("doc_id", "first"), "copies")
    return None if found.isEmpty() else found


def join(docs: DataFrame, num: int = 85, den: int = 100, words: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: documents whose shingle sets reach num / den in Jaccard similarity are linked.

    Rows with the text of a lesser id take that id's result and send no
    signatures.  Their ids are broadcast up to ``MOST_BROADCAST``; beyond that
    they are joined by a shuffle.  (Where ids repeat, all rows go their own
    way, and equal sets meet as one vertex.)
    """
    docs = docs.select("doc_id", "text")
    copies = _copies(docs)
    if copies is None:
        job = Join(docs, Scheme(num, den, words))
        job.run()
        return job.result()
    gone = copies.select(F.col("doc_id").alias("gone"))
    few = gone.count() <= MOST_BROADCAST
    job = Join(docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone"), "left_anti"), Scheme(num, den, words))
    job.run()
    own = materialise(job.result(), "joined")
    firsts = own.withColumnRenamed("doc_id", "first")
    return own.unionByName(copies.join(firsts, "first").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def deduplicated(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that of the least doc_id (one row of it, if the id repeats).

    If ids repeat, rows are the vertices: those that share an id with another
    text are judged by their own text.  Rows without shingles are copies only
    of those with their id.  Rows without an id stay.  The ids to drop are
    broadcast up to ``MOST_BROADCAST``; beyond that they are joined by a shuffle.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        return _deduplicated_rows(docs, num, den, words)
    drop = free_name(docs.columns, "__drop")
    found = materialise(join(docs, num, den, words).where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct(), "dropped")
    few = found.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(found) if few else found, F.col("doc_id") == F.col(drop), "left_anti")


def _deduplicated_rows(docs: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """``deduplicated`` for tables whose ids repeat: the join runs over numbered rows."""
    row, c, stay, n = (free_name(docs.columns, f"__{x}") for x in ("row", "c", "stay", "n"))
    numbered = materialise(docs.where("doc_id IS NOT NULL").withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = join(numbered.select(F.col(row).alias("doc_id"), "text"), num, den, words)
    found = found.select(F.col("doc_id").alias("vertex"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"))
    placed = materialise(numbered.select("doc_id", F.col(row).alias("row")).join(found, F.col("row") == F.col("vertex")).select("doc_id", "row", "c"), "row-components")
    least = placed.where("c IS NOT NULL").groupBy(F.col("c").alias("k")).agg(F.min("doc_id").alias("least"))
    staying = placed.join(least, F.col("c") == F.col("k"), "left").where("c IS NULL OR doc_id = least").select(F.col("row").alias(stay), F.col("c").alias(c))
    first = Window.partitionBy("doc_id", c).orderBy(*(F.col(x) for x in docs.columns if x != "doc_id"), row)
    kept = numbered.join(staying, F.col(row) == F.col(stay)).withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


#: The rows of ``join`` at 85 / 100 and four words in SQL, for tables in which an id occurs once: shingles meet by value, components by reachability.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, o) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.o
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(o) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
