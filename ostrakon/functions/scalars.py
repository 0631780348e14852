"""Scalar functions and small lookups: strings, numbers, units, operations, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units with their other names, dimension and size in the dimension's base unit.
UNITS = [
    ("millisecond", "milliseconds ms", "time", 0.001), ("second", "seconds sec secs", "time", 1.0), ("minute", "minutes min mins", "time", 60.0),
    ("hour", "hours hr hrs", "time", 3600.0), ("day", "days", "time", 86400.0), ("week", "weeks", "time", 604800.0),
    ("month", "months", "time", 2592000.0), ("year", "years", "time", 31536000.0),
    ("inch", "inches in", "length_imperial", 1.0), ("foot", "feet ft", "length_imperial", 12.0), ("yard", "yards yd", "length_imperial", 36.0), ("mile", "miles mi", "length_imperial", 63360.0),
    ("millimeter", "millimeters mm", "length_metric", 0.1), ("centimeter", "centimeters cm", "length_metric", 1.0), ("meter", "meters m", "length_metric", 100.0), ("kilometer", "kilometers km", "length_metric", 100000.0),
    ("penny", "pennies", "currency_usd", 0.01), ("nickel", "nickels", "currency_usd", 0.05), ("dime", "dimes", "currency_usd", 0.10), ("quarter", "quarters", "currency_usd", 0.25), ("dollar", "dollars", "currency_usd", 1.0),
    ("each", "single one", "quantity", 1.0), ("pair", "pairs", "quantity", 2.0), ("couple", "", "quantity", 2.0), ("dozen", "dozens", "quantity", 12.0), ("score", "", "quantity", 20.0), ("gross", "", "quantity", 144.0),
]

# Operations with their inverse and identity.
OPERATIONS = [
    ("add", "subtract", 0.0), ("subtract", "add", 0.0), ("multiply", "divide", 1.0), ("divide", "multiply", 1.0),
    ("remainder", None, None), ("percent", None, 100.0), ("power", None, 1.0),
]


def units(spark: SparkSession) -> DataFrame:
    """name, unit, dimension, size: a row for each name of a unit."""
    rows = [(name, unit, dimension, size) for unit, others, dimension, size in UNITS for name in (unit, *others.split())]
    return spark.createDataFrame(rows, "name string, unit string, dimension string, size double")


def operations(spark: SparkSession) -> DataFrame:
    """operation, inverse, identity."""
    return spark.createDataFrame(OPERATIONS, "operation string, inverse string, identity double")


def convert(df: DataFrame, value: str, source: str, target: str, to: str = "converted") -> DataFrame:
    """The value in another unit; null between dimensions (imperial and metric lengths are two) or for unknown units.  The unit table is fixed and small."""
    table = F.broadcast(units(df.sparkSession))
    a = table.select(F.col("name").alias("__a"), F.col("dimension").alias("__da"), F.col("size").alias("__sa"))
    b = table.select(F.col("name").alias("__b"), F.col("dimension").alias("__db"), F.col("size").alias("__sb"))
    joined = df.join(a, F.lower(F.trim(source)) == F.col("__a"), "left").join(b, F.lower(F.trim(target)) == F.col("__b"), "left")
    return joined.withColumn(to, F.when(F.col("__da") == F.col("__db"), F.col(value) * F.col("__sa") / F.col("__sb"))).drop("__a", "__b", "__da", "__db", "__sa", "__sb")


def operate(a: Column, op: Column, b: Column) -> Column:
    """One of the seven operations; null for an unknown one and for division by zero."""
    nonzero = F.when(b != 0, b)
    return F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when(op == "divide", a / nonzero).when(op == "remainder", F.pmod(a, nonzero)).when(op == "percent", a * b / 100).when(op == "power", F.pow(a, b))


def fold_chain(initial: Column, steps: Column) -> Column:
    """The value after an array of (op, value) steps, left to right."""
    return F.aggregate(steps, initial.cast("double"), lambda s, x: operate(s, x["op"], x["value"].cast("double")))


def resolve_verb(df: DataFrame, verb: str, table: DataFrame) -> DataFrame:
    """The operation of a verb phrase: the exact phrase, else its lemma, else a learned one, else the longest contained entry.

    ``table`` has entry, operation and kind (phrase, lemma, learned); it is a lexicon.
    """
    from pyspark.sql import Window

    t = F.broadcast(table.select("entry", "operation", "kind"))
    v = F.lower(F.col(verb))
    exact, inside = v == F.col("entry"), F.contains(v, F.col("entry"))
    rank = F.when(exact & (F.col("kind") == "phrase"), 1).when(exact & (F.col("kind") == "lemma"), 2).when(exact, 3).otherwise(4)
    found = df.select(verb).distinct().join(t, exact | inside)
    w = Window.partitionBy(verb).orderBy(rank, F.desc(F.length("entry")), "entry", "kind")
    best = found.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(verb, "operation", F.when(rank < 4, F.col("kind")).otherwise("substring").alias("how"))
    return df.join(best, verb, "left")


def protein_position(change: Column) -> Column:
    """The first number after an optional residue letter, as in V600E; null without one."""
    p = F.regexp_extract(change, r"[A-Z*]?(\d+)", 1)
    return F.when(p != "", p.cast("int"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def short_digest(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def signature(text: Column, patterns: Sequence[str]) -> Column:
    """The distinct matches of patterns, sorted and joined: texts with one signature assert the same shape."""
    found = F.concat(*(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(0)) for p in patterns))
    return F.concat_ws("+", F.array_sort(F.array_distinct(found)))


#: Patterns of quantifiers and predicates; fixed values.
QUANTIFIERS = [r"\bfor (?:all|every|each)\b", r"\bthere (?:exists?|is|are)\b", r"\bif and only if\b", r"\bat (?:least|most)\b"]
PREDICATES = [r"\bis (?:an?|the)\b", r"\b(?:equals?|implies|contains?|preserves?|divides?|converges?)\b"]
#: Verbs that claim a relation between two names; fixed values.
CLAIM_VERBS = ["activates", "inhibits", "binds", "regulates", "phosphorylates", "represses", "interacts with"]


def claims(df: DataFrame, text: str, names: str = r"[A-Z][A-Z0-9]{1,9}") -> DataFrame:
    """A row for each claim (subject, verb, object) that a text makes."""
    verbs = "|".join(CLAIM_VERBS)
    pattern = rf"\b({names})\s+({verbs})\s+({names})\b"
    parts = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return df.withColumn("__c", F.explode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("subject", "verb", "object")))))).select(*df.columns, "__c.subject", "__c.verb", "__c.object")


def claim_status(found: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """``status`` of claims: confirmed (an edge either way), novel (both names known), no_data."""
    both = edges.select(F.col("src").alias("subject"), F.col("dst").alias("object")).unionByName(edges.select(F.col("dst").alias("subject"), F.col("src").alias("object"))).distinct().withColumn("__e", F.lit(True))
    k = known.select("name").distinct()
    out = found.join(both, ["subject", "object"], "left").join(k.select(F.col("name").alias("subject"), F.lit(True).alias("__s")), "subject", "left").join(k.select(F.col("name").alias("object"), F.lit(True).alias("__o")), "object", "left")
    return out.withColumn("status", F.when(F.col("__e"), "confirmed").when(F.col("__s") & F.col("__o"), "novel").otherwise("no_data")).select(*found.columns, "status")


def two_step_templates(df: DataFrame, key: str, numbers: str) -> DataFrame:
    """key, expression, value: every a op b and (a op b) op c over the numbers of a row (an array; at most eight are meant).

    Operations are the fixed four, so the table grows with the cube of the
    numbers of one text, not with the number of texts.
    """
    ops = F.explode(F.array(*(F.lit(o) for o in ("add", "subtract", "multiply", "divide"))))
    n = df.select(key, F.posexplode(numbers).alias("i", "a"))
    m = df.select(key, F.posexplode(numbers).alias("j", "b"))
    one = n.join(m, key).where("i <> j").withColumn("op", ops).withColumn("value", operate(F.col("a"), F.col("op"), F.col("b")))
    third = df.select(key, F.posexplode(numbers).alias("k", "c"))
    two = one.join(third, key).where("k <> i AND k <> j").withColumn("op2", ops).withColumn("value2", operate(F.col("value"), F.col("op2"), F.col("c")))
    first = one.select(key, F.concat_ws(" ", F.col("a").cast("string"), "op", F.col("b").cast("string")).alias("expression"), "value")
    second = two.select(key, F.concat_ws(" ", F.col("a").cast("string"), "op", F.col("b").cast("string"), "op2", F.col("c").cast("string")).alias("expression"), F.col("value2").alias("value"))
    return first.unionByName(second).where("value IS NOT NULL").distinct()


def by_unit(df: DataFrame, problem: str, unit: str, value: str, role: str) -> DataFrame:
    """problem, unit: sum of hubs and product of scale factors (role: hub or scale)."""
    return df.groupBy(problem, unit).agg(F.coalesce(F.sum(F.when(F.col(role) == "hub", F.col(value))), F.lit(0.0)).alias("hub"), F.coalesce(F.product(F.when(F.col(role) == "scale", F.col(value))), F.lit(1.0)).alias("scale"))
