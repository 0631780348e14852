import zlib

import numpy as np

from ostrakon.llm import toxicity as t
from ostrakon.llm.common import table


def test_features_are_words_stems_pairs_and_skips():
    ids = t.feature_ids(b"Bad, bad dog ran", t.Words())
    alone = t.feature_ids(b"bad", t.Words())
    assert set(alone) <= set(ids) and len(alone) == 2
    assert len(t.feature_ids(b"", t.Words())) == 0
    assert set(t.feature_ids(b"a b c", t.Words())) - set(t.feature_ids(b"a b", t.Words())) - set(t.feature_ids(b"b c", t.Words()))


def test_ftrl_matches_the_scalar_update():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    y = np.array([float(3 in r) for r in rows])
    w = t.ftrl(rows, y, bits=6, alpha=0.5, l1=0.3, l2=0.2, epochs=3)
    z, n, bias, bn = [0.0] * 64, [0.0] * 64, float(np.log(y.sum() / (len(y) - y.sum()))), 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - np.sign(z[i]) * 0.3) / ((1 + n[i] ** 0.5) / 0.5 + 0.2)
    for _ in range(3):
        for r, label in zip(rows, y):
            ws = {i: weight(i) for i in r}
            g = 1 / (1 + np.exp(-(sum(ws.values()) + bias))) - label
            for i in r:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - s * ws[i]
                n[i] += g * g
            bn += g * g
            bias -= 0.1 * g / (1 + bn**0.5)
    assert np.allclose(w.values, [weight(i) for i in w.ids], atol=1e-5) and abs(w.intercept - bias) < 1e-9
    assert set(w.ids) == {i for i in range(64) if abs(z[i]) > 0.3}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = t.classify(docs, labels).toPandas().merge(labels.toPandas())
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted[held.toxic == 0] == 1).mean() < 0.01
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.7


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (2, "", 1.0), (None, "x y", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 1), (None, 0, 1)], "doc_id long, toxic int, quality int")
    assert docs.count() == t.classify(docs, labels).count()
    assert t.classify(docs, labels.limit(0)).agg({"score": "max"}).collect()[0][0] < 1e-9
    assert t.classify(docs.limit(0), labels).count() == 0


def test_labels_of_fold_0_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"
    flipped = labels.selectExpr("doc_id", f"if({held}, 1 - toxic, toxic) AS toxic")
    score = lambda y: {r.doc_id: r.score for r in t.classify(docs, y).collect()}
    assert score(labels) == score(flipped)
    ids, y, rows = t.sample(docs, labels)
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    best = t.choose(ids, y, rows, [{"l1": 1e6}, t.SETTINGS])
    assert len(best) == 2 and best[0][:2] <= best[1][:2]


def test_the_sample_is_bounded_in_bytes_and_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 50 + [(2, "g h"), (3, "i j"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    ids, y, rows = t.sample(docs, labels, held_out=False)
    assert sorted(ids) == [1, 2, 3, 4] and len(y) == len(rows) == 4
    few, _, some = t.sample(docs, labels, held_out=False, most_bytes=40)
    assert set(few) < set(ids) and sum(4 * len(r) for r in some) <= 40
