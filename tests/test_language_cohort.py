import pytest
from pyspark.sql import functions as F

from ostrakon.functions import language as L
from ostrakon.plans import cohort as C


@pytest.mark.parametrize("text,value", [("16 - 3 - 4", 9), ("2 ^ 3 ^ 2", 512), ("-(2 + 3) * 2", -10), ("twelve over three", 4), ("7 % 4", 3), ("1 / 0", None), ("2 +", None), ("", None), ("x + 1", None), ("(" * 50 + "1" + ")" * 50, 1)])
def test_expressions(text, value):
    assert L.evaluate(L.parse(L.lex(text))) == value


def test_linear_forms_and_systems():
    assert L.linear(L.parse(L.lex("2 * (x + 3) - x / 2"))) == {"x": 1.5, "": 6.0} and L.linear(L.parse(L.lex("x * y"))) is None
    assert L.solve_system(["x + y = 10", "x - y = 4"]) == {"x": 7.0, "y": 3.0}
    assert L.solve_system(["a = 2 * b", "b = 3", "c * c = 9"]) == {"a": 6.0, "b": 3.0} and L.solve_system([]) == {}


def test_callables_and_routes(spark):
    c = L.Callables()
    c.register("double", lambda x: x * 2)
    c.register("next", lambda x: x + 1)
    c.register("plus", lambda a, b: a + b)
    assert c.pipe("double", "next")(5) == 11 and c.compose("double", "next")(5) == 12 and c.curry("plus", 3)(4) == 7
    a = F.array(F.lit(1), F.lit(2))
    assert tuple(spark.range(1).select(c.map_over("double", a), c.reduce_with("plus", a, F.lit(10))).first()) == ([2, 4], 13)
    c.for_sql(spark, "double")
    assert spark.sql("SELECT double(CAST(4 AS DOUBLE))").first()[0] == 8
    assert L.route("How many genes are there?", {"count": lambda x: x}) == "genes" and L.route("why?", {}) is None


def test_average_linkage():
    d = {("a", "b"): 0.1, ("c", "d"): 0.2, ("a", "c"): 0.9, ("a", "d"): 0.9, ("b", "c"): 0.8, ("b", "d"): 0.9}
    assert C.average_linkage(d, 2) == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_clinical_times(spark):
    df = spark.createDataFrame([("p", "dead", 5, None), ("p", "dead", None, 9), ("q", "alive", None, 7), ("r", "alive", None, 0)], "p string, s string, d int, f int")
    assert sorted(map(tuple, C.clinical_times(df, "p", F.col("s") == "dead", "d", "f").collect())) == [("p", 5, 1), ("q", 7, 0)]


def test_calibration_is_reproducible():
    from ostrakon.operators.walk import calibrate

    score = lambda w: -((w["a"] - 0.3) ** 2)
    one, two = (calibrate(score, ["a"], 0, 1, 200) for _ in range(2))
    assert one == two and abs(one[0]["a"] - 0.3) < 0.05
