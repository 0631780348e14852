from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from ostrakon.llm import bpe, mixing
from ostrakon.llm.common import materialise, table
from ostrakon.llm.queries import QUERIES, vocabulary
from tests.llm.test_partenum import brute


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(materialise(f(spark, out[-1], sf), f"test-{name}"))
    return sf, out


def test_columns_and_names(stages):
    _, out = stages
    assert all(d.columns == out[0].columns for d in out[:-1])
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "bpe"]


def test_filters_follow_the_labels(spark, stages):
    sf, out = stages
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    first, second = ({r.doc_id for r in d.select("doc_id").collect()} for d in out[1:3])
    good, bad = [i for i, r in labels.items() if r.quality], [i for i, r in labels.items() if not r.quality]
    assert np.mean([i in first for i in good]) > 0.99 and np.mean([i in first for i in bad]) < 0.03
    clean = [i for i, r in labels.items() if not r.toxic and i in first]
    assert np.mean([i in second for i in clean]) > 0.99
    assert np.mean([i in second for i, r in labels.items() if r.toxic and i in first]) < 0.2


def test_one_document_of_each_group_stays(stages):
    _, out = stages
    want = brute([(r.doc_id, r.text) for r in out[2].collect()], 80, 100, 5)
    assert sorted(r.doc_id for r in out[3].select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_mix_and_ids(stages):
    _, out = stages
    words = Counter()
    for r in out[4].collect():
        words[r.source] += len(r.text.split())
    target = {}
    source = {r.doc_id: r.source for r in out[3].collect()}
    for r in mixing.taken(out[3]).collect():
        target[source[r.doc_id]] = r.target
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    coder = bpe.encoder_of(open(vocabulary("word_bpe_49k.json")).read())
    want = Counter((r.doc_id, coder.encode(r.text)) for r in out[4].collect())
    got = Counter((r.doc_id, np.array(r.ids, "<i4").tobytes()) for r in out[5].collect())
    assert got == want


def test_registered_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= names
