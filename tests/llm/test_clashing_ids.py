import random

from ostrakon.llm import partenum as p


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    copied, own, other, alone = text(), text(), text(), text()
    rows = [(1, copied, "a"), (5, copied, "a"), (5, own, "a"), (5, other, "b"), (5, other, "a"), (7, alone, "a"), (8, alone + " end", "a"), (9, "", "a"), (9, "", "a"), (10, None, "a"), (None, own, "a")]
    want = [(1, copied, "a"), (5, own, "a"), (5, other, "a"), (7, alone, "a"), (9, "", "a"), (10, None, "a"), (None, own, "a")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = p.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_columns_of_clashing_names_are_carried(spark):
    from ostrakon.llm import cotrain

    schema = "doc_id long, text string, lang string, source string, n_chars long, __drop string, __row long, __c long, __N long, __stay long, __lang string, __n_chars long"
    more = ("d", 1, 2, 3, 4, "l", 5)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(i, t, "en", "s", len(t), *more) for i, t in [(1, text), (2, text), (3, "other words here and there")]]
    once = p.deduplicated(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, once.collect())) == [rows[0], rows[2]]
    twice = p.deduplicated(spark.createDataFrame([*rows, rows[2]], schema))
    assert sorted(map(tuple, twice.collect())) == [rows[0], rows[2]]
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    kept = cotrain.kept_documents(spark.createDataFrame(rows, schema), labels)
    assert sorted(map(tuple, kept.collect())) == rows
