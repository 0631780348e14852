"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
end up inside one token, so a cut between them is certain.  Words are cut at
every such pair, the fragments are encoded independently (and remembered, as
fragments recur far more often than words) and the ids are concatenated.  The
result equals the encoding of the uncut word: every merge yields a vocabulary
token, so no merge spans a forced boundary.

The vocabulary file is a parameter; the driver reads it once and broadcasts
its text (about 2 MB, fixed by the file and not by the data).

Defined cases: null and empty texts give no ids and an empty decoded text;
repeated rows give repeated results; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import frugal, texts_of

#: Unicode White_Space; a fixed value of the normaliser.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")
_BUILT: dict[str, ForcedBoundaryBPE] = {}


# Letters and numbers that the library knows and Unicode 15.1 does not, as first and last code points.
LATER = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D49), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
]
# Capitals that the library lowers and Unicode 15.1 does not know: first, last, lower case of the first.
LATER_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LOWERED = {a + k: low + k for a, b, low in LATER_CAPITALS for k in range(b - a + 1)}
CAPITALS = re.compile(f"[{''.join(map(chr, LOWERED))}]")


@cache
def unassigned() -> str:
    """As ranges of a character class: what ``regex`` counts among letters and numbers and the library, whose Unicode version is older, does not."""
    known = {i for a, b in LATER for i in range(a, b + 1)}
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    starts = [i for i, p in zip(found, [-2, *found]) if i != p + 1]
    ends = [i for i, p in zip(found, [*found[1:], -2]) if p != i + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Remembered(dict):
    """Results of a function by argument, in two generations of at most ``most`` each: what is asked for again survives."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) < 200:
            self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary with word-end marks."""

    def __init__(self, spec: str, most_cached: int = 160_000):
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left], self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        self.alphabet = _byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_re = regex.compile(split.replace(r"[^\s", f"[^{_SPACE}"))
        #: The same for runs that hold such characters, which count as marks.
        self.rare_re = regex.compile(f"[{unassigned() or '^\x00-\U0010ffff'}]")
        self.rare_words_re = regex.compile(split.replace(r"[^\s", f"[^{_SPACE}").replace(r"\p{L}", rf"[\p{{L}}--[{unassigned()}]]").replace(r"\p{N}", rf"[\p{{N}}--[{unassigned()}]]"), regex.V1) if unassigned() else self.words_re
        self.space_re = regex.compile(f"[{_SPACE}]+")
        back = {c: b for b, c in enumerate(self.alphabet)}
        inside = set()
        for token in self.vocab:
            body = [back[c] for c in token.removesuffix(self.suffix)] if self.suffix else [back[c] for c in token]
            inside.update(zip(body, body[1:]))
        #: Pairs of bytes that occur inside some token; all others are forced boundaries.
        self.inside = frozenset(a * 256 + b for a, b in inside)
        self.most_cached = most_cached
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}
        self.chunks = Remembered(self._chunk, most_cached)

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between its forced boundaries."""
        inside, start, out = self.inside, 0, []
        for i in range(1, len(word)):
            if word[i - 1] * 256 + word[i] not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _merge(self, ids: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals."""
        get, merged = self.ranks.get, self.merged
        if len(ids) <= 64:
            never = len(merged)
            ranks = [get(p, never) for p in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best == never:
                    break
                i = ranks.index(best)
                ids[i : i + 2] = [merged[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), never)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), never)
            return ids
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            new = merged[rank]
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := get((new, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (m, i, new, ids[after[j]]))
            if before[i] >= 0 and (m := get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (m, before[i], ids[before[i]], new))
        return [x for x, a in zip(ids, alive) if a]

    def _fragment(self, fragment: bytes, last: bool) -> tuple[int, ...]:
        key = fragment, last
        found = self.fragments.get(key)
        if found is None:
            chars = [self.alphabet[b] for b in fragment]
            if last:
                chars[-1] += self.suffix
            found = tuple(self._merge([self.vocab[c] for c in chars]))
            if len(self.fragments) >= self.most_cached // 4:
                self.fragments.clear()
            if len(fragment) < 200:
                self.fragments[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        parts = self.cuts(word.encode("utf-8", "surrogatepass"))
        ids: list[int] = []
        for part in parts[:-1]:
            ids.extend(self._fragment(part, False))
        ids.extend(self._fragment(parts[-1], True))
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """What lies between two spaces: its words, encoded one by one."""
        words = self.words_re if chunk.isascii() or not self.rare_re.search(chunk) else self.rare_words_re
        ids = [i for word in words.findall(chunk) for i in self.encode_word(word)]
        return b"".join(i.to_bytes(4, "little") for i in ids), " ".join(map(self.tokens.__getitem__, ids))

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special_re.finditer(text) if any(s in text for s in self.specials) else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit words, decoded tokens) of each run without spaces, in order."""
        out, chunks = [], self.chunks
        for part, special in self._segments(text):
            if special:
                out.append((self.specials[part].to_bytes(4, "little"), part))
            elif part:
                # Case is mapped character by character, so a capital sigma never becomes a final one.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if not part.isascii() and CAPITALS.search(part):
                    part = part.translate(LOWERED)
                # str.split also splits at four separators that the vocabulary's white space lacks.
                found = part.split() if part.isprintable() or not SEPARATORS.search(part) else [c for c in self.space_re.split(part) if c]
                out += map(chunks.__getitem__, found)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([p[0] for p in self.pieces(text)])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as this vocabulary names no decoder; unknown ids are left out."""
        return " ".join(t for t in map(self.tokens.get, ids) if t is not None)


def encoder_of(spec: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = ForcedBoundaryBPE(spec)
    return _BUILT[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int) and the decoded text of every row of ``docs``."""
    import numpy as np

    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pieces = [bpe.pieces(t) for t in texts_of(part, "text")]
                joined = [b"".join([x[0] for x in p]) for p in pieces]
                lengths = np.fromiter((len(x) // 4 for x in joined), np.int64, len(joined))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.frombuffer(b"".join(joined), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), ids, pa.array([" ".join([x[1] for x in p]) for p in pieces], pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of ``encode_documents``, taken where the ids are made.

    Ids and decoded texts stay in the worker, so what leaves it does not grow with the texts.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder_of(spec.value), hashlib.sha256
        for batch in batches:
            n, first, second = [], [], []
            for text in texts_of(batch, "text"):
                pieces = bpe.pieces(text)
                ids = b"".join([p[0] for p in pieces])
                n.append(len(ids) // 4)
                first.append(sha(ids).hexdigest())
                second.append(sha(" ".join([p[1] for p in pieces]).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_corpus(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and the digest of the decoded text of every row of ``docs``."""
    import numpy as np

    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                joined, digests = [], []
                for text in texts_of(part, "text"):
                    pieces = bpe.pieces(text)
                    joined.append(b"".join([p[0] for p in pieces]))
                    digests.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode("utf-8", "surrogatepass")).hexdigest())
                lengths = np.fromiter((len(x) // 4 for x in joined), np.int64, len(joined))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.frombuffer(b"".join(joined), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(lengths), ids, pa.array(digests, pa.string())], names=names)

    narrow = docs.select("doc_id", "lang", "source", "n_chars", "text")
    kinds = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in names[:4])
    return narrow.mapInArrow(frugal(run), f"{kinds}, n_tokens long, ids array<int>, decoded_sha256 string")
