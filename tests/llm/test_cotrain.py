import numpy as np

from ostrakon.llm import cotrain as c
from ostrakon.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = labels.where("doc_id % 3 != 0")
    got = c.classify(docs, seen).toPandas().merge(labels.where("doc_id % 3 = 0").toPandas())
    assert len(got) > 100
    assert got.keep[got.quality == 1].mean() > 0.98 and got.keep[got.quality == 0].mean() < 0.05


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = np.repeat([0.0, 1.0], 400)
    text = np.column_stack([y[:, None] + rng.normal(0, 0.2, (800, 1)), rng.normal(0, 1, (800, len(c.TEXT_FEATURES) - 1))])
    meta = np.column_stack([y[:, None] + rng.normal(0, 0.4, (800, 1)), rng.normal(0, 1, (800, 9 + c.HASHED_SOURCES))])
    few = np.r_[0:20, 400:420]
    model = c.co_train(text[few], meta[few], y[few], text, meta, rounds=4, share=0.2)
    alone = c.co_train(text[few], meta[few], y[few], text[:0], meta[:0], rounds=4)
    accuracy = lambda m: ((m.score(text, meta)[1] > 0.5) == (y > 0.5)).mean()
    assert accuracy(model) > accuracy(alone) and ((model.score(text, meta)[2] > 0.5) == (y > 0.5)).mean() > 0.95


def test_logistic_reaches_a_zero_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    w = c.logistic(x, y)
    p = 1 / (1 + np.exp(-c.log_odds(x, w)))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-6


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0.5), (2, "", "en", "s", 0, 0.1), (2, "", "en", "s", 0, 0.1), (None, "w " * 50000, "en", "s", 9, 0.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = c.classify(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert c.classify(docs.limit(0), labels).count() == 0
    assert c.classify(docs, labels.limit(0)).count() == 4
