import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ostrakon.llm import matroska as m


@given(st.integers(1, 900), st.integers(0, 255))
@settings(max_examples=60, deadline=None)
def test_round_trip_and_timestamps(units, seed):
    payload = bytes((seed + i * i // 7) % 256 for i in range(units * 64))
    data = m.from_bytes(payload)
    media = m.parse(data)
    assert media.error is None and m.payload_of(media, data) == payload
    at = 0
    for p in media.packets:
        assert p[4] == at * 125_000 and data[p[5] : p[5] + p[6]] == payload[at : at + p[6]]
        at += p[6]
    assert len(media.cues) == media.clusters
    segment = data.index(m.SEGMENT.to_bytes(4, "big"))
    start = m.read_vint(data, segment + 4)[1]
    for time, track, position in media.cues:
        assert track == 1 and data[start + position : start + position + 4] == m.CLUSTER.to_bytes(4, "big")


@given(st.lists(st.integers(0, 70000), min_size=2, max_size=9), st.sampled_from(["xiph", "ebml"]))
@settings(max_examples=80, deadline=None)
def test_lacing(sizes, kind):
    body = m.block_body(1, 5, [bytes(s) for s in sizes], kind)
    found, at = m.lace_sizes(body, 4, len(body), kind)
    assert found == sizes and at == len(body) - sum(sizes)


def test_unknown_sizes_damage_and_void():
    data = m.from_bytes(bytes(range(256)) * 40)
    i = data.index(m.CLUSTER.to_bytes(4, "big"))
    size, body = m.read_vint(data, i + 4)
    open_ended = data[: i + 4] + b"\x01" + b"\xff" * 7 + data[body:]
    s = open_ended.index(m.SEGMENT.to_bytes(4, "big"))
    _, b = m.read_vint(open_ended, s + 4)
    open_ended = open_ended[: s + 4] + b"\x01" + b"\xff" * 7 + b"\xec\x82ab" + open_ended[b:]
    media = m.parse(open_ended)
    assert media.error is None and m.payload_of(media, open_ended) == bytes(range(256)) * 40
    cut = m.parse(data[: len(data) // 2])
    assert cut.error and 0 < len(cut.packets) < len(m.parse(data).packets)
    assert m.parse(b"").error and m.parse(b"RIFFxxxx").error


def test_columns(spark):
    texts = [None, "", "a" * 64, "héllo" * 500, "héllo" * 500, "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    files = m.store(docs)
    rows = {r.doc_id: r for r in m.features(files).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[3].media_sha256 == rows[4].media_sha256
    table = m.packets(files, "doc_id").collect()
    assert sum(p.length for p in table if p.doc_id == 5) == rows[5].payload_bytes
    assert {p.lacing for p in table} == set(m.LACINGS)
    bad = spark.createDataFrame([(1, None), (2, b"abc")], "doc_id long, media binary")
    assert [(r.track, bool(r.error)) for r in m.packets(bad, "doc_id").collect()] == [(None, True)] * 2
    assert m.features(m.store(docs.limit(0))).count() == 0
