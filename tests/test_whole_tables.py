"""Queries without SQL give a result for every row of their table."""

import operator
import re

import pytest

from ostrakon.plans import documents as D
from ostrakon.queries import QUERIES

OPS = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": lambda a, b: a / b if b else None}


def test_structure_beside_plain_patterns(spark):
    texts = [
        r"\textbf{Theorem 1a} and \textbf{LEMMA 22} \textbf{Def 3} \textbf{Definition4b} \textbf{Open Question 5} \textbf{Theorem x}",
        "[Ab2001,  Cd1999b] {[Ab2001]} [Zz9] [ab2001 x] [Ef2003a]", r"\textbf{too short} \textbf{ in bold, long enough }" * 12, r"\(x\)", "a $ sign", "", "plain " * 20_000, None,
    ]
    rows = D.structure(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").orderBy("id").collect()
    for r in rows[:-1]:
        for name, p in D.STRUCTURE.items():
            assert [tuple(x) for x in r[name]] == [m.groups() for m in re.finditer(p, r.text)]
        assert r.citations == list(dict.fromkeys(k for m in re.finditer(D.CITATION, r.text) for k in re.split(r",\s*", m[1])))
        assert r.bold_claims == [m[1].strip() for m in re.finditer(D.BOLD, r.text)] and r.has_math == bool(re.search(D.MATH, r.text))
    assert [len(rows[0][n]) for n in D.STRUCTURE] == [2, 2, 1] and rows[1].citations == ["Ab2001", "Cd1999b", "Ef2003a"] and len(rows[2].bold_claims) == 12
    assert rows[-1].theorems is None and rows[-1].citations is None and rows[-1].has_math is None
    assert len(D.structure(spark.createDataFrame([(texts[2],)], "text string"), "text", 10).first().bold_claims) == 10


def test_templates_of_every_part(spark, sf):
    got = {}
    for r in QUERIES["f15_templates"](spark, sf).collect():
        got.setdefault(r.p_partkey, {})[r.expression] = r.value
    parts = {r.p_partkey: float(r.p_size) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert got.keys() == parts.keys() and max(parts) >= 20
    for key, size in parts.items():
        n, want = (size, 3.0, 4.0), {}
        for i in range(3):
            for j in {0, 1, 2} - {i}:
                k = 3 - i - j
                for op in OPS:
                    one = OPS[op](n[i], n[j])
                    want[f"{n[i]} {op} {n[j]}"] = one
                    for op2 in OPS:
                        want[f"{n[i]} {op} {n[j]} {op2} {n[k]}"] = OPS[op2](one, n[k])
        assert got[key] == pytest.approx(want, abs=1e-6)
