"""Matroska media columns: write, and parse into packet tables.

``packets`` reads a binary column of Matroska (or WebM) files and returns one
row per frame: track, cluster, block, place in its lace, timestamp, duration,
key flag and byte range.  It reads EBML elements with variable-length ids and
sizes (unknown sizes included), clusters with SimpleBlocks and BlockGroups,
all three lacings, and cues.  ``from_bytes`` writes payloads as 8-bit PCM in
such files, with every kind of lacing in use, and ``features`` reads the
stored bytes back.

Defined cases: null payloads are empty ones; a null or damaged file gives no
packets beyond the damage and an ``error``; empty tables give empty tables;
other columns are ignored.  A file is one row, so it must fit in a worker.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of

# Element ids of the container format.
EBML, DOC_TYPE, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLE_RATE, CHANNELS, BIT_DEPTH, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, VOID, CRC = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xEC, 0xBF
MUXING_APP, WRITING_APP, FLAG_LACING = 0x4D80, 0x5741, 0x9C
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS})
#: Elements at which a cluster of unknown size ends.
TOP_LEVEL = frozenset({SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367})
LACINGS = ("none", "xiph", "fixed", "ebml")
RATE = 8000
UNIT = 64


# --- writing ---------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length integer; all ones is kept for an unknown size."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block_body(track: int, offset_ms: int, frames: list[bytes], lacing: str, flags: int = 0) -> bytes:
    """The body of a block: header, lace sizes, frames."""
    head = vint(track) + struct.pack(">hB", offset_ms, flags | LACINGS.index(lacing) << 1)
    if lacing == "none":
        return head + b"".join(frames)
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not abs(b - a) < (1 << 7 * width - 1):
                width += 1
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def from_bytes(payload: bytes, frame: int = 1024, lace: int = 4, blocks_per_cluster: int = 8) -> bytes:
    """A Matroska file holding ``payload`` (a multiple of 64 bytes) as unsigned 8-bit mono PCM at 8 kHz.

    Blocks take turns in their lacing and their kind of element; EBML and Xiph
    laces hold frames of unequal sizes.
    """
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"ostrakon") + element(WRITING_APP, b"ostrakon"))
    audio = element(AUDIO, element(SAMPLE_RATE, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, cues, at, block, position, base = [], [], 0, 0, len(info) + len(tracks), 0
    body: list[bytes] = []
    while at < len(payload):
        if not body:
            base = at
        kind = LACINGS[block % 4]
        step = frame if kind in ("none", "fixed") else frame // 2
        sizes = []
        for i in range(1 if kind == "none" else lace):
            size = min(step + (UNIT * (i % 3) if kind in ("ebml", "xiph") else 0), len(payload) - at - sum(sizes))
            if size <= 0 or kind == "fixed" and size < step:
                break
            sizes.append(size)
        if not sizes or len(sizes) == 1:
            kind, sizes = "none", sizes or [min(step, len(payload) - at)]
        frames, p = [], at
        for size in sizes:
            frames.append(payload[p : p + size])
            p += size
        data = block_body(1, (at - base) * 1000 // RATE, frames, kind, 0x80 if block % 3 else 0)
        body.append(element(SIMPLE_BLOCK, data) if block % 3 else element(BLOCK_GROUP, element(BLOCK, data) + uint(BLOCK_DURATION, (p - at) * 1000 // RATE)))
        at, block = p, block + 1
        if len(body) == blocks_per_cluster or at >= len(payload):
            time = base * 1000 // RATE
            clusters.append(element(CLUSTER, uint(CLUSTER_TIME, time) + b"".join(body)))
            cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, position))))
            position += len(clusters[-1])
            body = []
    return head + element(SEGMENT, b"".join([info, tracks, *clusters, element(CUES, b"".join(cues))]))


# --- reading ---------------------------------------------------------------


class Damaged(ValueError):
    """The bytes break the container format."""


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """(value, next place); None for the unknown size."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return value, at + width
    value -= 1 << 7 * width
    return (None if value == (1 << 7 * width) - 1 else value), at + width


@dataclass
class Media:
    """What a file holds; a packet is (track, cluster, block, lace_index, timestamp_ns, offset, length, key, lacing)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    lacings: Counter = field(default_factory=Counter)
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    clusters: int = 0
    blocks: int = 0
    error: str | None = None
    _entry: dict = field(default_factory=dict)
    _cue: dict = field(default_factory=dict)
    _time: int = 0


def lace_sizes(data: bytes, at: int, end: int, kind: str) -> tuple[list[int], int]:
    """(sizes of the frames of a block, place of the first)."""
    if kind == "none":
        return [end - at], at
    if at >= end:
        raise Damaged(f"no lace at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % n:
            raise Damaged(f"unequal fixed lace at {at}")
        return [(end - at) // n] * n, at
    if kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"lace cut off at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            start = at
            value, at = read_vint(data, at)
            if value is None:
                value = (1 << 7 * (at - start)) - 1
            sizes.append(value if not i else sizes[-1] + value - (1 << 7 * (at - start) - 1) + 1)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged(f"lace beyond its block at {at}")
    return [*sizes, rest], at


def _block(media: Media, data: bytes, at: int, end: int, simple: bool) -> None:
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise Damaged(f"block cut off at {at}")
    offset, flags = struct.unpack_from(">hB", data, at)
    kind = LACINGS[flags >> 1 & 3]
    sizes, at = lace_sizes(data, at + 3, end, kind)
    entry = media.tracks.get(track, {})
    time = (media._time + offset) * media.scale
    each = entry.get("frame_ns") or 0
    pcm = entry.get("ns_per_byte") or 0
    done = 0
    media.lacings[kind] += 1
    for i, size in enumerate(sizes):
        media.packets.append((track, media.clusters - 1, media.blocks, i, int(time + (i * each or done * pcm)), at, size, bool(flags & 0x80) if simple else True, kind))
        at += size
        done += size
    media.blocks += 1


def _close(media: Media, eid: int) -> None:
    if eid == TRACK_ENTRY and media._entry:
        e = media._entry
        if e.get("codec", "").startswith("A_PCM") and e.get("rate"):
            e["ns_per_byte"] = 8e9 / (e["rate"] * e.get("channels", 1) * e.get("bits", 8))
        media.tracks[e.get("number", 0)] = e
        media._entry = {}
    elif eid == CUE_POINT and media._cue:
        media.cues.append((media._cue.get("time", 0) * media.scale, media._cue.get("track", 0), media._cue.get("position", 0)))
        media._cue = {}


def _leaf(media: Media, eid: int, data: bytes, at: int, end: int) -> None:
    number = lambda: int.from_bytes(data[at:end], "big")
    real = lambda: struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end - at in (4, 8) else 0.0
    if eid == SIMPLE_BLOCK:
        _block(media, data, at, end, True)
    elif eid == BLOCK:
        _block(media, data, at, end, False)
    elif eid == CLUSTER_TIME:
        media._time = number()
    elif eid == TIMESTAMP_SCALE:
        media.scale = number() or 1_000_000
    elif eid == DURATION:
        media.duration = real()
    elif eid == DOC_TYPE:
        media.doc_type = data[at:end].rstrip(b"\0").decode("ascii", "replace")
    elif eid == TRACK_NUMBER:
        media._entry["number"] = number()
    elif eid == TRACK_TYPE:
        media._entry["type"] = number()
    elif eid == CODEC_ID:
        media._entry["codec"] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
    elif eid == DEFAULT_DURATION:
        media._entry["frame_ns"] = number()
    elif eid == SAMPLE_RATE:
        media._entry["rate"] = real()
    elif eid == CHANNELS:
        media._entry["channels"] = number()
    elif eid == BIT_DEPTH:
        media._entry["bits"] = number()
    elif eid == CUE_TIME:
        media._cue["time"] = number()
    elif eid == CUE_TRACK:
        media._cue["track"] = number()
    elif eid == CUE_CLUSTER:
        media._cue["position"] = number()


def parse(data: bytes) -> Media:
    """All that the file holds; on damage, what stands before it and ``error``."""
    media, at = Media(), 0
    open_masters: list[tuple[int, int]] = []  # (id, end); -1 where the size is unknown
    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise Damaged("no EBML header")
        while True:
            while open_masters and (open_masters[-1][1] if open_masters[-1][1] >= 0 else len(data)) <= at:
                _close(media, open_masters.pop()[0])
            if at >= len(data):
                break
            eid, body = read_vint(data, at, keep_mark=True)
            size, body = read_vint(data, body)
            while open_masters and open_masters[-1][1] < 0 and eid in TOP_LEVEL and open_masters[-1][0] != SEGMENT:
                _close(media, open_masters.pop()[0])
            if eid in MASTERS:
                if size is not None and body + size > len(data):
                    media.error = f"element at {at} is cut off"
                    size = len(data) - body
                open_masters.append((eid, -1 if size is None else body + size))
                if eid == CLUSTER:
                    media.clusters += 1
                    media._time = 0
                at = body
                continue
            if size is None or body + size > len(data):
                raise Damaged(f"element at {at} is cut off")
            _leaf(media, eid, data, body, body + size)
            at = body + size
    except Damaged as e:
        media.error = str(e)
    return media


def payload_of(media: Media, data: bytes, track: int = 1) -> bytes:
    return b"".join([data[p[5] : p[5] + p[6]] for p in media.packets if p[0] == track])


def describe(media: Media, payload: bytes) -> str:
    """Features of the container and of its samples."""
    samples = np.frombuffer(payload, np.uint8)
    mean = float(samples.mean()) if len(samples) else 0.0
    spread = float(samples.std()) if len(samples) else 0.0
    turns = int(np.count_nonzero(np.diff((samples > 96).view(np.int8)))) if len(samples) else 0
    laces = ",".join(f"{k}:{media.lacings[k]}" for k in LACINGS if media.lacings[k])
    return f"tracks={len(media.tracks)};clusters={media.clusters};blocks={media.blocks};packets={len(media.packets)};lacing={laces};cues={len(media.cues)};duration_ms={media.duration * media.scale / 1e6:.0f};mean={mean:.3f};std={spread:.3f};crossings={turns}"


# --- operators -------------------------------------------------------------


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and a ``media`` column: each text's UTF-8 bytes, padded to a positive multiple of 64, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = bytes_of(part, "text")
                files = [from_bytes(t + bytes(-len(t) % UNIT if t else UNIT)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


PACKETS = "track int, cluster int, block int, lace_index int, timestamp_ns long, offset long, length long, key boolean, lacing string"


def packets(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """The packet table of a media column, a row for each frame; ``error`` is set on the last row before damage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                media = parse(data) if data is not None else Media(error="no file")
                rows = [(*p, None) for p in media.packets]
                if media.error:
                    rows = [*rows[:-1], (*(rows[-1][:-1] if rows else (None,) * 9), media.error)]
                kinds = [pa.int32()] * 4 + [pa.int64()] * 3 + [pa.bool_(), pa.string(), pa.string()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "track", "cluster", "block", "lace_index", "timestamp_ns", "offset", "length", "key", "lacing", "error"])

    narrow = files.select(files[id_col].alias("id"), files[media_col].alias("media"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, {PACKETS}, error string").withColumnRenamed("id", id_col)


def features(files: DataFrame) -> DataFrame:
    """Digests and features of stored files, all from the bytes read back (doc_id, n_bytes and media expected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                media = parse(data)
                payload = payload_of(media, data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), describe(media, payload)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
