"""Tests, tails and regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- tails (vectorised; few rows reach them, as they follow aggregation) -------


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def fisher_p(a: int, b: int, c: int, d: int, side: str = "two-sided") -> float:
    """Fisher's exact p of a 2 x 2 table."""
    r, s, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    low, high = max(0, s - (n - r)), min(r, s)
    k = np.arange(low, high + 1)
    logs = np.array([choose(r, i) + choose(n - r, s - i) for i in k]) - choose(n, s)
    p = np.exp(logs)
    if side == "less":
        return float(min(1.0, p[k <= a].sum()))
    if side == "greater":
        return float(min(1.0, p[k >= a].sum()))
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(k) else gamma_upper(k / 2, v / 2) for v, k in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0 else beta_regularised(k / 2, 0.5, k / (k + v * v)) for v, k in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal2(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")


def _fisher(side: str):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(int(w), int(x), int(y), int(z), side) for w, x, y, z in zip(a, b, c, d)], dtype="float64")

    return run


def chi2_tail(x: Column, df: Column | int) -> Column:
    """P(X > x) for chi-squared."""
    return _chi2(x.cast("double"), (F.lit(df) if isinstance(df, int) else df).cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _t2(t.cast("double"), df.cast("double"))


def normal_two_sided(z: Column) -> Column:
    return _normal2(z.cast("double"))


def fisher(a: Column, b: Column, c: Column, d: Column, side: str = "two-sided") -> Column:
    return _fisher(side)(*(x.cast("long") for x in (a, b, c, d)))


# --- tables --------------------------------------------------------------------


def two_by_two(df: DataFrame, group: Sequence[str], exposed: Column, outcome: Column) -> DataFrame:
    """group, a, b, c, d: exposed with and without the outcome, others with and without."""
    e, o = exposed.cast("boolean"), outcome.cast("boolean")
    return df.groupBy(*group).agg(F.count_if(e & o).alias("a"), F.count_if(e & ~o).alias("b"), F.count_if(~e & o).alias("c"), F.count_if(~e & ~o).alias("d"))


def table_tests(tables: DataFrame) -> DataFrame:
    """Log odds ratio (0.5 added to each cell), Pearson's chi-squared with its p, Fisher's p, observed over expected."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    out = tables.withColumn("log_odds", F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
    out = out.withColumn("chi2", F.when(bottom > 0, n * (a * d - b * c) * (a * d - b * c) / bottom))
    out = out.withColumn("enrichment", F.when((a + b) * (a + c) > 0, a * n / ((a + b) * (a + c))))
    return out.withColumn("p_chi2", chi2_tail(F.col("chi2"), 1)).withColumn("p_fisher", fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


def chi2_independence(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pearson's chi-squared of a contingency table: chi2, df, n, p."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("o"))
    rows, columns = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # Cells that never occur count by their expectation: n (sum o^2 / (r c) - 1).
    s = cells.join(rows, row).join(columns, column).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct(row).alias("nr"), F.countDistinct(column).alias("nc"))
    out = s.crossJoin(total).select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"), "n")
    return out.withColumn("p", chi2_tail(F.col("chi2"), F.col("df")))


def exclusivity(df: DataFrame, group: str, entity: str, item: str, a: object, b: object) -> DataFrame:
    """By group: entities with both items, one, none; observed over expected together."""
    of = df.groupBy(group, entity).agg(F.max((F.col(item) == a).cast("int")).alias("x"), F.max((F.col(item) == b).cast("int")).alias("y"))
    n, x, y, both = F.count(F.lit(1)), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("y"))
    return of.groupBy(group).agg(n.alias("n"), x.alias("n_a"), y.alias("n_b"), both.alias("both"), F.when(x * y > 0, both * n / (x * y)).alias("ratio"))


# --- correlation and location ------------------------------------------------------


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15)))
    return out.withColumn("p", t_two_sided(t, F.col("n") - 2))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of average ranks."""
    from .aggregates import average_rank

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "__rx"), y, "__ry")
    return pearson(ranked, "__rx", "__ry")


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """u of the rows for which ``group`` holds, auc = u / (n1 n2), normal p with a correction for ties."""
    from .aggregates import average_rank

    base = df.withColumn("__g", group.cast("boolean")).where(F.col(value).isNotNull() & F.col("__g").isNotNull())
    ranked = average_rank(base, value, "__r")
    ties = base.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n1 = F.count_if("__g")
    out = ranked.agg(n1.alias("n1"), F.count_if(~F.col("__g")).alias("n2"), F.sum(F.when(F.col("__g"), F.col("__r"))).alias("s")).crossJoin(ties)
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("s") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((a + b + 1) - F.col("ties") / ((a + b) * (a + b - 1))))
    return out.select("n1", "n2", u.alias("u"), (u / (a * b)).alias("auc"), normal_two_sided((u - a * b / 2) / sd).alias("p"))


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Welch's t-test of two groups."""
    g = group.cast("boolean")
    f = lambda k, fn: fn(F.when(g if k else ~g, F.col(value)))
    out = df.agg(*(x for k in (1, 0) for x in (f(k, F.count).alias(f"n{k}"), f(k, F.avg).alias(f"m{k}"), f(k, F.var_samp).alias(f"v{k}"))))
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(s1 + s0)
    dof = (s1 + s0) * (s1 + s0) / (s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1))
    return out.select("n1", "n0", "m1", "m0", t.alias("t"), dof.alias("df"), t_two_sided(t, dof).alias("p"))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Area under the ROC curve by ranks, ties half."""
    return mann_whitney(df, score, label).select("n1", "n2", "auc")


# --- regression ------------------------------------------------------------------------


def _moments(df: DataFrame, x: Sequence[str], y: str, weight: str | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'WX, X'Wy, y'Wy, rows: one aggregation, (columns + 1)^2 numbers to the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    k = len(v)
    sums = [F.sum(w * v[i] * v[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * a * F.col(y)) for a in v] + [F.sum(w * F.col(y) * F.col(y)), F.count(F.lit(1))]
    r = [float(s or 0) for s in df.dropna(subset=[*x, y]).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()[0]]
    g = np.zeros((k, k))
    i = np.triu_indices(k)
    g[i] = r[: len(i[0])]
    g = g + g.T - np.diag(g.diagonal())
    return g, np.array(r[len(i[0]) : len(i[0]) + k]), r[-2], r[-1]


def least_squares(df: DataFrame, x: Sequence[str], y: str, weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """Coefficients with standard errors, t and p by the normal equations; ``ridge`` leaves the intercept free."""
    g, b, yy, n = _moments(df, x, y, weight)
    h = g + ridge * np.diag([0.0] + [1.0] * len(x))
    beta = np.linalg.solve(h, b)
    dof = n - len(beta)
    residual = max(0.0, yy - 2 * beta @ b + beta @ g @ beta)
    inverse = np.linalg.inv(h)
    se = np.sqrt(np.diag(inverse @ g @ inverse) * residual / max(dof, 1))
    rows = [(name, float(c), float(s), float(c / s) if s else None, float(beta_regularised(dof / 2, 0.5, float(dof / (dof + (c / s) ** 2)))) if s and dof > 0 else None) for name, c, s in zip(["(intercept)", *x], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double, p double")


def logistic(df: DataFrame, x: Sequence[str], y: str, steps: int = 30, ridge: float = 1e-9) -> DataFrame:
    """Logistic regression by Newton steps, each one aggregation; Wald tests."""
    base = df.dropna(subset=[*x, y]).select(*(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("__y")).persist()
    v = [F.lit(1.0), *(F.col(c) for c in x)]
    k = len(v)
    beta = np.zeros(k)
    h = np.eye(k)
    try:
        for _ in range(steps):
            eta = sum((F.lit(float(c)) * a for c, a in zip(beta, v)), F.lit(0.0))
            p = 1 / (1 + F.exp(-eta))
            sums = [F.sum(p * (1 - p) * v[i] * v[j]) for i in range(k) for j in range(i, k)] + [F.sum((F.col("__y") - p) * a) for a in v]
            r = np.array(base.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()[0], float)
            h = np.zeros((k, k))
            i = np.triu_indices(k)
            h[i] = r[: len(i[0])]
            h = h + h.T - np.diag(h.diagonal()) + ridge * np.eye(k)
            step = np.linalg.solve(h, r[len(i[0]) :] - ridge * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
    finally:
        base.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    rows = [(n, float(b), float(s), math.erfc(abs(b / s) / math.sqrt(2))) for n, b, s in zip(["(intercept)", *x], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, p double")


def folds(df: DataFrame, entity: str, stratum: str, k: int = 5) -> DataFrame:
    """Stratified folds that depend on the ids alone: the rank of the id's hash within its stratum, modulo k."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(entity).cast("string")), entity)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def bootstrap(df: DataFrame, statistic: Column, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, value: the statistic on Poisson resamples; ``statistic`` uses column ``w`` as the row's weight.

    The row's draw for a replicate is a hash, so reruns agree; aggregation is
    partial on each task.
    """
    u = (F.pmod(F.xxhash64(*df.columns, "replicate", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    steps, total, term = [], 0.0, math.exp(-1)
    for i in range(12):
        total += term
        steps.append(total)
        term /= i + 1
    w = F.size(F.filter(F.array(*(F.lit(s) for s in steps)), lambda s: s < u))
    repeated = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", w)
    return repeated.groupBy("replicate").agg(statistic.alias("value"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    s = cells.agg(pairs(F.col("c")).alias("s"), F.sum("c").alias("n"))
    sa = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("sa"))
    sb = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("sb"))
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return s.crossJoin(sa).crossJoin(sb).select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))
