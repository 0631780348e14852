import random

import numpy as np
import pytest

from ostrakon.llm import editprint as e


def stretch(rng, text, at, share):
    """A stretch of the text (at: 0 front, 1 middle, 2 end) gives way to other characters."""
    k = int(share * len(text))
    begin = (len(text) - k) * at // 2
    return text[:begin] + "".join(rng.choice("QWXYZJKV") for _ in range(k)) + text[begin + k :]


@pytest.mark.parametrize("at", [0, 1, 2])
def test_recall_of_edits_in_one_stretch(spark, at):
    rng = random.Random(11)
    rows, n = [], 120
    for f in range(n):
        text = "".join(rng.choice("etaoin shrdlu,.") for _ in range(rng.randrange(300, 2500)))
        rows += [(2 * f, text), (2 * f + 1, stretch(rng, text, at, rng.uniform(0.05, 0.18)))]
    prints = {i: e.unpack(e.fingerprint_of(t)) for i, t in rows}
    near = [f for f in range(n) if e.likeness(prints[2 * f], prints[2 * f + 1]) >= 0.8]
    got = {r.doc_id: r.class_id for r in e.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 40 and np.mean([got[2 * f] == got[2 * f + 1] for f in near]) > 0.95
    assert all(i // 2 == c // 2 for i, c in got.items())


def test_open_pairs_of_a_mixed_band_are_compared(spark, monkeypatch):
    """Bands that hold everything: all links come from the comparison of pairs, and equal brute force."""
    monkeypatch.setattr(e, "TILE", 7)
    rng = random.Random(5)
    rows = []
    for _ in range(15):
        text = "".join(rng.choice("etaoin shrdlu,.") for _ in range(rng.randrange(200, 900)))
        rows += [text, stretch(rng, text, 0, 0.1), stretch(rng, text, 2, 0.1)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    prints = [e.unpack(e.fingerprint_of(t)) for _, t in rows]
    label = list(range(len(rows)))
    for a, x in enumerate(prints):
        for b in range(a):
            if e.likeness(x, prints[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    monkeypatch.setattr(e, "bands_of", lambda *_: [1, 2])
    got = {r.doc_id: r.class_id for r in e.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(label)) < len(rows) and [got[i] for i in range(len(rows))] == label
