"""Survival analysis on aggregates by time.

Rows are first counted by distinct time, with partial sums on each task; what
is left is a row a time and group.  Cox risk sets and the C-index then work in
two levels over times; curves and log-rank tests take the distinct times of one
group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .stats import chi2_tail, normal_two_sided


def kaplan_meier(df: DataFrame, time: str, event: str, group: Sequence[str] = ()) -> DataFrame:
    """group, time, at_risk, events, survival at each time with an event.

    The product runs as a sum of logarithms; a step to zero stays zero.
    """
    by_time = df.where(F.col(time).isNotNull()).groupBy(*group, time).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(*group)
    later = w.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    risk = by_time.withColumn("at_risk", F.sum("__n").over(later))
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))
    curve = risk.withColumn("__s", F.sum(F.coalesce(step, F.lit(0.0))).over(earlier)).withColumn("__zero", F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(earlier))
    return curve.where("events > 0").select(*group, time, "at_risk", "events", F.when(F.col("__zero") == 1, 0.0).otherwise(F.exp("__s")).alias("survival"))


def median_survival(curve: DataFrame, time: str, group: Sequence[str] = ()) -> DataFrame:
    """The first time at which the curve is at or below one half."""
    return curve.where(F.col("survival") <= 0.5 + 1e-12).groupBy(*group).agg(F.min(time).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, exposed: str, group: Sequence[str] = ()) -> DataFrame:
    """Two-sample log-rank test by group: observed and expected events of the exposed, variance, chi2, p."""
    e = F.col(exposed).cast("int")
    by_time = df.groupBy(*group, time).agg(F.count(F.lit(1)).alias("__n"), F.sum(e).alias("__n1"), F.sum(F.col(event).cast("long")).alias("d"), F.sum(F.col(event).cast("long") * e).alias("d1"))
    later = Window.partitionBy(*group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    n, n1, d = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("d").cast("double")
    risk = by_time.withColumn("n", F.sum("__n").over(later)).withColumn("n1", F.sum("__n1").over(later)).where("d > 0")
    v = F.when(n > 1, d * n1 * (n - n1) * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    out = risk.groupBy(*group).agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    out = out.withColumn("chi2", F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.col("variance")))
    return out.withColumn("p", chi2_tail(F.col("chi2"), 1))


def running(df: DataFrame, order: str, values: Sequence[str], descending: bool = True, buckets: int = 64) -> DataFrame:
    """Running sums of several columns along a unique column, in two levels; they replace the columns."""
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("__cuts"))
    keyed = df.crossJoin(F.broadcast(cuts)).withColumn("__b", F.size(F.filter("__cuts", lambda e: e < F.col(order)))).drop("__cuts")
    totals = keyed.groupBy("__b").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    before = Window.orderBy(F.desc("__b") if descending else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__b", *(F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0.0)).alias(f"__s_{v}") for v in values))
    w = Window.partitionBy("__b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(F.broadcast(starts), "__b")
    return joined.withColumns({v: F.col(f"__s_{v}") + F.sum(v).over(w) for v in values}).drop("__b", *(f"__s_{v}" for v in values))


def cox(df: DataFrame, x: Sequence[str], time: str, event: str, penalty: float = 0.0, steps: int = 25) -> DataFrame:
    """Cox regression with Breslow's ties: term, coefficient, se, hazard_ratio, p.

    Newton steps with halving; each is an aggregation by time, running sums
    over times and one row of sums to the driver.  ``penalty`` is the ridge
    weight per row, as half of penalty * n * b^2.
    """
    k = len(x)
    base = cut(df.dropna(subset=[*x, time, event]).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)), F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e")), "cox")
    means = base.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(k)), F.count(F.lit(1)).alias("n")).collect()[0]
    n = means.n
    for i in range(k):
        base = base.withColumn(f"x{i}", F.col(f"x{i}") - F.lit(float(means[f"m{i}"])))

    def evaluate(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        r = F.exp(eta)
        risk = {"s0": F.sum(r)} | {f"s1_{i}": F.sum(r * F.col(f"x{i}")) for i in range(k)} | {f"s2_{i}_{j}": F.sum(r * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)}
        own = {"d": F.sum("e"), "l": F.sum(F.col("e") * eta)} | {f"g_{i}": F.sum(F.col("e") * F.col(f"x{i}")) for i in range(k)}
        by_time = base.groupBy("t").agg(*(c.alias(name) for name, c in (risk | own).items()))
        sums = running(by_time, "t", list(risk)).where("d > 0")
        u = [F.col(f"s1_{i}") / F.col("s0") for i in range(k)]
        wanted = [F.sum(F.col("l") - F.col("d") * F.log("s0"))] + [F.sum(F.col(f"g_{i}") - F.col("d") * u[i]) for i in range(k)] + [F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - u[i] * u[j])) for i in range(k) for j in range(i, k)]
        got = np.array([v or 0.0 for v in sums.agg(*(c.alias(f"v{i}") for i, c in enumerate(wanted))).collect()[0]], float)
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[1 + k :]
        h = h + h.T - np.diag(h.diagonal()) + penalty * n * np.eye(k)
        return got[0] - penalty * n * beta @ beta / 2, got[1 : 1 + k] - penalty * n * beta, h

    beta = np.zeros(k)
    value, g, h = evaluate(beta)
    for _ in range(steps):
        step = np.linalg.solve(h + 1e-12 * np.eye(k), g)
        size = 1.0
        while True:
            new = evaluate(beta + size * step)
            if new[0] >= value - 1e-9 or size < 1e-4:
                break
            size /= 2
        beta, (value, g, h) = beta + size * step, new
        if np.abs(g).max() < 1e-8 or np.abs(size * step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h + 1e-12 * np.eye(k))))
    rows = [(c, float(b), float(s), math.exp(b), math.erfc(abs(b / s) / math.sqrt(2))) for c, b, s in zip(x, beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, hazard_ratio double, p double")


def _binary_fit(times: np.ndarray, n: np.ndarray, d: np.ndarray, t1: np.ndarray, n1: np.ndarray, d1: np.ndarray) -> tuple[float, float] | None:
    """(coefficient, se) of a binary covariate, Breslow's ties: all entities and the exposed ones by time."""
    at = np.searchsorted(times, t1)
    m, e = np.zeros(len(times)), np.zeros(len(times))
    np.add.at(m, at, n1)
    np.add.at(e, at, d1)
    risk, exposed = np.cumsum(n[::-1])[::-1], np.cumsum(m[::-1])[::-1]
    hit = d > 0
    risk, exposed, d, e = risk[hit], exposed[hit], d[hit], e[hit]
    b = 0.0
    for _ in range(60):
        w = exposed * math.exp(b)
        p = w / (w + risk - exposed)
        g, h = (e - d * p).sum(), (d * p * (1 - p)).sum()
        if h <= 1e-12:
            return None
        step = max(-2.0, min(2.0, g / h))
        b += step
        if abs(b) > 30:
            return None
        if abs(step) < 1e-10:
            break
    return b, 1 / math.sqrt(h)


def cox_atlas(df: DataFrame, group: str, entity: str, key: Sequence[str], time: str, event: str, outcomes: DataFrame, least_events: int = 3, least_with: int = 5, least_events_all: int = 10) -> DataFrame:
    """Binary Cox fits of every key within its group: hr, ci_low, ci_high, p, n_with, n_without, events_with, events_without, confident.

    Only entities that have a key are exploded; the others follow from the
    group's totals by time, one array a group.
    """
    one = df.select(group, entity, *key).distinct()
    o = outcomes.select(entity, group, F.col(time).cast("double").alias("t"), F.col(event).cast("long").alias("e")).where("t IS NOT NULL")
    totals = o.groupBy(group, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("t", "n", "d"))).alias("all"), F.sum("n").alias("n_all"), F.sum("d").alias("d_all"))
    own = one.join(o.drop(group), entity).groupBy(group, *key, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d")).groupBy(group, *key).agg(F.array_sort(F.collect_list(F.struct("t", "n", "d"))).alias("own"), F.sum("n").alias("n_with"), F.sum("d").alias("events_with"))
    joined = own.join(totals, group).withColumn("n_without", F.col("n_all") - F.col("n_with")).withColumn("events_without", F.col("d_all") - F.col("events_with"))
    gated = joined.where((F.col("events_with") >= least_events) & (F.col("n_with") >= least_with) & (F.col("d_all") >= least_events_all) & (F.col("n_without") > 0))
    names = [group, *key, "n_with", "n_without", "events_with", "events_without"]
    schema = ", ".join(f"{c} {gated.schema[c].dataType.simpleString()}" for c in names) + ", coefficient double, se double"

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (np.array([[x["t"], x["n"], x["d"]] for x in v], float) for v in (r.all, r.own))
                found = _binary_fit(*a.T, *b.T)
                rows.append((*(getattr(r, c) for c in names), *(found or (None, None))))
            yield pd.DataFrame(rows, columns=[*names, "coefficient", "se"])

    out = gated.select(*names, "all", "own").mapInPandas(fit, schema).where("coefficient IS NOT NULL")
    out = out.withColumn("hr", F.exp("coefficient")).withColumn("ci_low", F.exp(F.col("coefficient") - 1.96 * F.col("se"))).withColumn("ci_high", F.exp(F.col("coefficient") + 1.96 * F.col("se")))
    out = out.withColumn("ci_width", F.col("ci_high") - F.col("ci_low")).withColumn("p", normal_two_sided(F.col("coefficient") / F.col("se")))
    return out.withColumn("confident", (F.col("p") < 0.05) & (F.col("ci_width") < 2.5))


def _dominance(t: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[int, int, int]:
    """(concordant, tied, comparable) pairs with t_i < t_j and an event at i, in O(n log n)."""
    values = np.unique(h)
    at = np.searchsorted(values, h)
    tree = np.zeros(len(values) + 1, np.int64)

    def upto(i: int) -> int:
        s = 0
        while i:
            s += tree[i]
            i &= i - 1
        return s

    good = tie = all_ = seen = 0
    order = np.argsort(-t, kind="stable")
    start = 0
    while start < len(order):
        end = start
        while end < len(order) and t[order[end]] == t[order[start]]:
            end += 1
        for i in order[start:end]:
            if e[i]:
                low, same = upto(at[i]), upto(at[i] + 1)
                good, tie, all_ = good + low, tie + same - low, all_ + seen
        for i in order[start:end]:
            j = at[i] + 1
            while j <= len(values):
                tree[j] += 1
                j += j & -j
        seen += end - start
        start = end
    return int(good), int(tie), int(all_)


def c_index(df: DataFrame, time: str, event: str, hazard: str, buckets: int = 64) -> DataFrame:
    """Harrell's concordance: concordant, tied, comparable, c_index; a higher hazard should fail first.

    Exact without forming pairs and without one task over all rows: time and
    hazard are cut at quantiles.  Pairs in different buckets of both are
    counted from the grid; pairs in one time bucket, and pairs in one hazard
    bucket but different time buckets, are counted within the bucket in
    n log n.
    """
    q = [i / buckets for i in range(1, buckets)]
    base = df.where(F.col(time).isNotNull() & F.col(hazard).isNotNull()).select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(hazard).cast("double").alias("h"))
    cuts = base.agg(F.percentile_approx("t", q, 1000).alias("ct"), F.percentile_approx("h", q, 1000).alias("ch"))
    keyed = cut(base.crossJoin(F.broadcast(cuts)).select("t", "e", "h", F.size(F.filter("ct", lambda c: c < F.col("t"))).alias("bt"), F.size(F.filter("ch", lambda c: c < F.col("h"))).alias("bh")), "cindex")
    cells = keyed.groupBy("bt", "bh").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"))
    right = cells.select(F.col("bt").alias("bt2"), F.col("bh").alias("bh2"), F.col("n").alias("n2"))
    grid = cells.join(F.broadcast(right), (F.col("bt") < F.col("bt2")) & (F.col("bh") != F.col("bh2")))
    pairs = F.col("d") * F.col("n2")
    far = grid.select(F.when(F.col("bh2") < F.col("bh"), pairs).otherwise(0).alias("concordant"), F.lit(0).cast("long").alias("tied"), pairs.alias("comparable"))

    def within(by: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            t = pdf["t"] if by == "bt" else pdf["bt"].astype(float)
            return pd.DataFrame([_dominance(t.to_numpy(), pdf["e"].to_numpy(), pdf["h"].to_numpy())], columns=["concordant", "tied", "comparable"])

        return keyed.groupBy(by).applyInPandas(run, "concordant long, tied long, comparable long")

    total = far.unionByName(within("bt")).unionByName(within("bh")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("concordant", "tied", "comparable")))
    return total.withColumn("c_index", F.when(F.col("comparable") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("comparable")))


def _prefix_less(values: np.ndarray, length: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of the first ``length`` values (not negative) lie below ``bound``, for each query: a wavelet matrix, one pass a bit."""
    low, high, out = np.zeros(len(length), np.int64), length.astype(np.int64), np.zeros(len(length), np.int64)
    for k in range(int(max(values.max(initial=0), bound.max(initial=0))).bit_length() - 1, -1, -1):
        one = (values >> k & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        low0, high0, up = zeros[low], zeros[high], (bound >> k & 1).astype(bool)
        out += np.where(up, high0 - low0, 0)
        low, high = np.where(up, zeros[-1] + low - low0, low0), np.where(up, zeros[-1] + high - high0, high0)
        values = np.concatenate([values[~one], values[one]])
    return out


def concordance_by_entity(df: DataFrame, entity: str, stratum: str, time: str, event: str, hazard: str) -> DataFrame:
    """Each entity's comparable pairs within its stratum and the share that is concordant (ties half).

    No pairs are formed: a stratum's rows are counted in n log n, in one task.
    """
    kind = {c: df.schema[c].dataType.simpleString() for c in (stratum, entity)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, h = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1].astype(np.int64) for c in ("__t", "__h"))
        known, event1 = pdf["__known"].to_numpy(bool), pdf["__e"].to_numpy(bool)
        pairs, score = np.zeros(len(t), np.int64), np.zeros(len(t))

        def ordered(keep: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(keep)
            at = at[np.argsort(key[at], kind="stable")]
            return key[at], h[at]

        # As the earlier one, with an event: all later rows; as the later one: all earlier events.
        for key, points, of, higher in ((-t, np.ones(len(t), bool), event1, False), (t, event1, np.ones(len(t), bool), True)):
            pairs[of] += np.searchsorted(ordered(points, key)[0], key[of])
            when, values = ordered(points & known, key)
            at = of & known
            n = np.searchsorted(when, key[at])
            below, upto = _prefix_less(values, n, h[at]), _prefix_less(values, n, h[at] + 1)
            score[at] += (n - upto if higher else below) + (upto - below) / 2
        return pd.DataFrame({stratum: pdf[stratum], entity: pdf[entity], "__pairs": pairs, "__score": score})

    rows = df.where(F.col(stratum).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(stratum, entity, F.col(time).alias("__t"), F.coalesce(F.col(event).cast("int") == 1, F.lit(False)).alias("__e"), F.coalesce(F.col(hazard).cast("double"), F.lit(0.0)).alias("__h"), F.col(hazard).isNotNull().alias("__known"))
    counted = rows.groupBy(stratum).applyInPandas(run, f"`{stratum}` {kind[stratum]}, `{entity}` {kind[entity]}, __pairs long, __score double")
    return counted.groupBy(stratum, entity).agg(F.sum("__pairs").alias("pairs"), F.sum("__score").alias("__s")).where("pairs > 0").select(stratum, entity, "pairs", (F.col("__s") / F.col("pairs")).alias("concordance"))


def cox_loss(df: DataFrame, time: str, event: str, hazard: str) -> DataFrame:
    """Negative log partial likelihood per event: risk sets hold all rows of the same or a later time."""
    by_time = df.groupBy(F.col(time).alias("t")).agg(F.sum(F.exp(hazard)).alias("s0"), F.sum(F.col(event).cast("double")).alias("d"), F.sum(F.col(event) * F.col(hazard)).alias("l"))
    risk = running(by_time, "t", ["s0"])
    return risk.agg((-F.sum(F.col("l") - F.col("d") * F.log("s0")) / F.greatest(F.sum("d"), F.lit(1.0))).alias("loss"), F.sum("d").alias("events"))


def auc_at(df: DataFrame, time: str, event: str, hazard: str, times: Sequence[float]) -> DataFrame:
    """t, n, auc: rows whose state at t is known (event seen, or followed beyond t); positive if the event came by t."""
    from .aggregates import average_rank

    out = None
    for t in times:
        known = df.where((F.col(time) > t) | (F.col(event) == 1)).withColumn("__y", ((F.col(time) <= t) & (F.col(event) == 1)).cast("int"))
        ranked = average_rank(known, hazard, "__r")
        n1, n = F.sum("__y"), F.count(F.lit(1))
        one = ranked.agg(F.lit(float(t)).alias("t"), n.alias("n"), F.when((n1 > 0) & (n1 < n), (F.sum(F.col("__y") * F.col("__r")) - n1 * (n1 + 1) / 2) / (n1 * (n - n1))).alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


def interactions(df: DataFrame, group: str, entity: str, item: str, time: str, event: str, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """group, a, b, n_both, mean log-time-free view of synergy: event rates with both, a alone, b alone, neither, and their interaction on the log-odds scale."""
    from .relational import pairs_within

    o = outcomes.select(entity, group, F.col(event).cast("int").alias("e"))
    one = df.select(group, entity, item).distinct()
    single = one.join(o.drop(group), entity).groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"))
    both = pairs_within(one, [group, entity], item).join(o.drop(group), entity).groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n_ab"), F.sum("e").alias("d_ab")).where(F.col("n_ab") >= least)
    total = o.groupBy(group).agg(F.count(F.lit(1)).alias("n_all"), F.sum("e").alias("d_all"))
    out = both.join(total, group)
    for end in ("a", "b"):
        out = out.join(single.select(group, F.col(item).alias(end), F.col("n").alias(f"n_{end}"), F.col("d").alias(f"d_{end}")), [group, end])
    logit = lambda d, n: F.log((d + 0.5) / (n - d + 0.5))
    c = F.col
    neither_n, neither_d = c("n_all") - c("n_a") - c("n_b") + c("n_ab"), c("d_all") - c("d_a") - c("d_b") + c("d_ab")
    score = logit(c("d_ab"), c("n_ab")) - logit(c("d_a") - c("d_ab"), c("n_a") - c("n_ab")) - logit(c("d_b") - c("d_ab"), c("n_b") - c("n_ab")) + logit(neither_d, neither_n)
    return out.select(group, "a", "b", "n_ab", "d_ab", score.alias("interaction"))
