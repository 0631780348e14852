import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from ostrakon.llm import bpe
from ostrakon.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
VOCAB = vocabulary("word_bpe_49k.json")
TEXTS = [None, "", " ", "The quick brown fox", "a<|endoftext|>b", "<|startoftext|>", "!" * 900, "ΑΣ ΣΣ İI", "é don't I'LL", "a" * 700, "½²Ⅷ٣", "日本語 😀", "x y\x85z\x1c", "Éeauouon.\nEn", "Éeauouon.\nEn"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCAB)


def test_ids_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, id string")
    for r in bpe.encode_documents(docs, VOCAB).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    for r in bpe.digest_documents(docs, VOCAB).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_fragments_join_to_the_uncut_word():
    coder = bpe.ForcedBoundaryBPE(open(VOCAB).read())
    word = "thnt#ble€reonxqz".encode()
    assert b"".join(coder.cuts(word)) == word and len(coder.cuts(word)) > 1
    assert coder.decode([0, 10**9]) == coder.tokens[0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert bpe.digest_documents(empty, VOCAB).count() == 0


def test_every_code_point_equals_the_library(library):
    """Between letters, after a space and beside a number and a mark."""
    coder = bpe.ForcedBoundaryBPE(open(VOCAB).read())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for start in range(0, len(points), 50_000):
        part = [f"a{c}b {c}1!{c}" for c in points[start : start + 50_000]]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert coder.encode(text) == np.array(want.ids, "<u4").tobytes(), hex(ord(text[1]))
