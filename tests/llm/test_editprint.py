import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ostrakon.llm import editprint as e
from ostrakon.llm.common import table


@given(st.text(max_size=300), st.integers(0, 9000))
@settings(max_examples=60, deadline=None)
def test_walk_equals_the_plain_random_walk(text, begin):
    cells = e.mix64(np.arange(e.PERIOD * e.CLASSES, dtype=np.uint64) + np.uint64(1 << 32)).reshape(e.PERIOD, e.CLASSES)
    classes = e.classes_of(text)
    want, t = [begin], begin
    for c in classes:
        while not int(cells[t % e.PERIOD, c]) & 1:
            t += 1
        t += 1
        want.append(t)
    assert e.walk(classes, begin).tolist() == want


def test_likeness_follows_edits():
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(3000))
    last = 1.0
    for edits in (2, 20, 150):
        other = list(text)
        for _ in range(edits):
            p = rng.randrange(len(other))
            other[p : p + rng.randrange(2)] = rng.choice("xyz")
        near = e.likeness(e.unpack(e.fingerprint_of(text)), e.unpack(e.fingerprint_of("".join(other))))
        assert near < last
        last = near
    assert last > 0.3 and e.likeness(e.unpack(e.fingerprint_of(text)), e.unpack(e.fingerprint_of(text[::-1]))) < 0.25
    level, bits = e.unpack(e.fingerprint_of(text))
    assert e.pack(level, bits) == e.fingerprint_of(text) and len(bits) <= e.SAMPLES
    empty = e.unpack(e.fingerprint_of(""))
    assert e.likeness(empty, empty) == 1 and e.likeness(empty, (level, bits)) == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        edited = e.edit_text(t, n)
        a, b, c = map(e.fingerprint_of, (t, edited, n))
        like = lambda x, y: e.likeness(e.unpack(x), e.unpack(y))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return sorted(out, key=str)


def test_neighbours_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = e.with_neighbours(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert min(r.near_edited for r in got) > 0.25 and sum(r.near_next < r.near_edited for r in got) > 0.98 * len(got)


def test_defined_cases(spark):
    rows = [(5, None), (3, ""), (3, ""), (9, "abcdef"), (None, "zz"), (1, "é" * 5000), (2, "a"), (2, "b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, run int")
    assert sorted(map(tuple, e.with_neighbours(docs).collect()), key=str) == brute(rows)
    one = spark.createDataFrame([(4, "abc")], "doc_id long, text string")
    assert list(map(tuple, e.with_neighbours(one).collect())) == brute([(4, "abc")])
    assert e.with_neighbours(docs.limit(0)).count() == 0 and e.fingerprints(docs.limit(0)).count() == 0


def test_near_classes(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("etaoin shrdlu,.") for _ in range(rng.randrange(40, 2500))) for _ in range(60)]
    rows, family = [], {}
    for f, t in enumerate(texts):
        for c in range(4):
            x = list(t)
            for _ in range(c * len(x) // 1000):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = rng.choice("xyz")
            family[len(rows)] = f
            rows.append((len(rows), "".join(x)))
    docs = spark.createDataFrame(rows + [(10**6, ""), (10**6 + 1, None)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in e.near_classes(docs).collect()}
    assert len(got) == len(rows) + 2 and got[10**6] == got[10**6 + 1]
    prints = {i: e.unpack(e.fingerprint_of(t)) for i, t in rows}
    pairs = [(a, b) for a in family for b in family if a < b and e.likeness(prints[a], prints[b]) >= 0.8]
    assert len(pairs) > 200 and np.mean([got[a] == got[b] for a, b in pairs]) > 0.95
    assert all(family[a] == family[got[a]] for a in family)
