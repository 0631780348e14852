"""Texts to numbers: expressions, linear forms, roles of quantities, coverage, questions, callables.

Parsing needs recursion, so it runs in Arrow-batched pandas functions, a row
at a time within a batch; everything around it is relational.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z]+)|(.))")
PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 3}
#: Words for operators and small numbers; fixed values.
WORDS = {"plus": "+", "and": "+", "minus": "-", "less": "-", "times": "*", "of": "*", "over": "/", "mod": "%", "to": "^"}
NUMBERS = {w: float(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"twenty": 20.0, "hundred": 100.0, "half": 0.5, "twice": 2.0}


def lex(text: str) -> list[tuple[str, object]]:
    """(kind, value): num, name, op; number words and operator words are what they stand for."""
    out: list[tuple[str, object]] = []
    for number, word, mark in TOKEN.findall(text):
        w = word.lower()
        if number:
            out.append(("num", float(number)))
        elif w in NUMBERS:
            out.append(("num", NUMBERS[w]))
        elif w in WORDS:
            out.append(("op", WORDS[w]))
        elif word:
            out.append(("name", word))
        elif mark in "+-*/%^()":
            out.append(("op", mark))
    return out


def parse(tokens: Sequence[tuple[str, object]]):
    """A tree of ('num', x), ('ref', name), ('neg', t) and (op, left, right); None if the tokens are no expression."""
    at = 0

    def unit():
        nonlocal at
        if at >= len(tokens):
            raise ValueError
        kind, value = tokens[at]
        at += 1
        if kind == "num":
            return ("num", value)
        if kind == "name":
            return ("ref", value)
        if value == "-":
            return ("neg", unit())
        if value == "(":
            t = level(1)
            if at >= len(tokens) or tokens[at] != ("op", ")"):
                raise ValueError
            at += 1
            return t
        raise ValueError

    def level(least: int):
        nonlocal at
        left = unit()
        while at < len(tokens) and tokens[at][0] == "op" and PRECEDENCE.get(tokens[at][1], 0) >= least:
            op = tokens[at][1]
            at += 1
            left = (op, left, level(PRECEDENCE[op] + (op != "^")))
        return left

    try:
        tree = level(1)
    except (ValueError, RecursionError):
        return None
    return tree if at == len(tokens) else None


def evaluate(tree, names: Mapping[str, float] | None = None) -> float | None:
    """The value of a tree; None for unknown names and division by zero."""
    if tree is None:
        return None
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind == "ref":
        return (names or {}).get(tree[1])
    if kind == "neg":
        v = evaluate(tree[1], names)
        return None if v is None else -v
    a, b = evaluate(tree[1], names), evaluate(tree[2], names)
    if a is None or b is None:
        return None
    try:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "^": lambda: a**b}[kind]()
    except (ZeroDivisionError, OverflowError):
        return None


def linear(tree) -> dict[str, float] | None:
    """Coefficients by name, the constant under ''; None if the tree is not linear."""
    if tree is None:
        return None
    kind = tree[0]
    if kind == "num":
        return {"": tree[1]}
    if kind == "ref":
        return {tree[1]: 1.0}
    if kind == "neg":
        a = linear(tree[1])
        return None if a is None else {k: -v for k, v in a.items()}
    a, b = linear(tree[1]), linear(tree[2])
    if a is None or b is None:
        return None
    fixed = lambda f: set(f) <= {""}
    if kind in "+-":
        s = 1 if kind == "+" else -1
        return {k: v for k in {*a, *b} if (v := a.get(k, 0.0) + s * b.get(k, 0.0)) or not k}
    if kind == "*" and (fixed(a) or fixed(b)):
        c, f = (a.get("", 0.0), b) if fixed(a) else (b.get("", 0.0), a)
        return {k: c * v for k, v in f.items()}
    if kind == "/" and fixed(b) and b.get("", 0.0):
        return {k: v / b[""] for k, v in a.items()}
    return None


def solve_system(equations: Sequence[str]) -> dict[str, float]:
    """Names that equations (left = right) settle, by substitution of linear forms, until nothing changes."""
    known: dict[str, float] = {}
    forms = []
    for e in equations:
        left, _, right = e.partition("=")
        a, b = linear(parse(lex(left))), linear(parse(lex(right)))
        if a is not None and b is not None:
            forms.append({k: a.get(k, 0.0) - b.get(k, 0.0) for k in {*a, *b}})
    defined: list[tuple[str, dict[str, float]]] = []
    for f in list(forms):
        for name, g in defined:
            if c := f.pop(name, 0.0):
                for k, v in g.items():
                    f[k] = f.get(k, 0.0) + c * v
        pivot = max((k for k in f if k and abs(f[k]) > 1e-12), key=lambda k: abs(f[k]), default=None)
        if pivot is not None:
            c = f.pop(pivot)
            defined.append((pivot, {k: -v / c for k, v in f.items()}))
    for name, g in reversed(defined):
        if all(k == "" or k in known for k in g if abs(g[k]) > 1e-12):
            known[name] = sum(v * (known[k] if k else 1.0) for k, v in g.items() if abs(v) > 1e-12)
    return known


@F.pandas_udf(T.DoubleType())
def _value(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else evaluate(parse(lex(t))) for t in texts], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
def _solved(equations: pd.Series) -> pd.DataFrame:
    found = [solve_system(list(e)) if e is not None else {} for e in equations]
    return pd.DataFrame({"names": [sorted(f) for f in found], "values": [[float(f[k]) for k in sorted(f)] for f in found]})


def expression_value(text: Column) -> Column:
    """The number that an expression in digits or words stands for; null if it is none."""
    v = _value(text)
    return F.when(~F.isnan(v), v)


def solve(equations: Column) -> Column:
    """name -> value of a system of linear equations (an array of texts)."""
    s = _solved(equations)
    return F.map_from_arrays(s["names"], s["values"])


def numbers_in(text: Column) -> Column:
    """The numbers that a text states in digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def quantity_roles(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, value, unit, role of each number with a noun: scale if it counts per something ('each', 'per', 'every') or multiplies ('times'), else hub."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\d+(?:\.\d+)?)\s+([a-z]+)((?:\s+(?:each|per|every|times))?)"), F.lit(0))
    one = df.select(key, F.explode(found).alias("m"))
    part = lambda i: F.regexp_extract("m", r"(\d+(?:\.\d+)?)\s+([a-z]+)((?:\s+(?:each|per|every|times))?)", i)
    return one.select(key, part(1).cast("double").alias("value"), F.regexp_replace(part(2), "s$", "").alias("unit"), F.when((part(3) != "") | (part(2) == "times"), "scale").otherwise("hub").alias("role"))


def parse_coverage(df: DataFrame, key: str, text: str, used: str) -> DataFrame:
    """key, stated, used, missing (numbers of the text that a parse left out), coverage."""
    stated = F.array_distinct(numbers_in(F.col(text)))
    missing = F.array_except(stated, F.col(used))
    return df.select(key, F.size(stated).alias("stated"), F.size(F.array_intersect(stated, F.col(used))).alias("used"), missing.alias("missing"), F.when(F.size(stated) > 0, 1 - F.size(missing) / F.size(stated)).otherwise(1.0).alias("coverage"))


def hashed_embedding(df: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """key, embedding: signed hashing of words, length one; stands in where no model is at hand."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("w"))
    h = F.xxhash64("w")
    cells = words.groupBy(key, F.pmod(h, F.lit(width)).alias("i")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return maps.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.greatest("n", F.lit(1e-300))).alias("embedding"))


#: Question patterns and the views they ask for; fixed values.
QUESTIONS = [(r"how many (\w+)", "count"), (r"(?:best|highest) (\w+)", "best"), (r"(?:worst|lowest) (\w+)", "worst"), (r"(?:what|who) (?:is|are) (?:connected|linked) to (\w+)", "neighbours"), (r"(?:find|search|about) (\w+)", "search")]


def route(question: str, handlers: Mapping[str, Callable[[str], DataFrame]]) -> DataFrame | None:
    """The answer of the first handler whose pattern a question matches."""
    for pattern, name in QUESTIONS:
        m = re.search(pattern, question.lower())
        if m and name in handlers:
            return handlers[name](m[1])
    return None


class Callables:
    """Functions by concept, to be composed, and registered for SQL."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def register(self, name: str, function: Callable) -> None:
        self.functions[name] = function

    def compose(self, *names: str) -> Callable:
        """The last named function first."""
        return self.pipe(*reversed(names))

    def pipe(self, *names: str) -> Callable:
        def run(x):
            for n in names:
                x = self.functions[n](x)
            return x

        return run

    def curry(self, name: str, *first) -> Callable:
        return lambda *rest: self.functions[name](*first, *rest)

    def map_over(self, name: str, values: Column) -> Column:
        """A function of Columns over an array column."""
        return F.transform(values, self.functions[name])

    def reduce_with(self, name: str, values: Column, start: Column) -> Column:
        return F.aggregate(values, start, self.functions[name])

    def for_sql(self, spark: SparkSession, name: str, returns: str = "double") -> None:
        f = self.functions[name]
        spark.udf.register(name, F.pandas_udf(lambda s: s.map(f), returns))

    def for_aggregates(self, spark: SparkSession, name: str, returns: str = "double") -> None:
        """A function of a pandas Series as an aggregate for SQL; the values of a group are in one task."""
        f = self.functions[name]
        spark.udf.register(name, F.pandas_udf(lambda s: f(s), returns, F.PandasUDFType.GROUPED_AGG))

    def for_tables(self, spark: SparkSession, name: str, returns: str) -> None:
        """A function that yields tuples as a table function for SQL."""
        f = self.functions[name]

        class Rows:
            def eval(self, *arguments):
                yield from f(*arguments)

        spark.udtf.register(name, F.udtf(Rows, returnType=returns))
