"""Composed analyses of cohorts: each is a short plan over the operators.

Tables: holdings (entity, item, channel, ...), outcomes (entity, t, e, ...).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import stats as T
from ..operators import survival as V


def status_matrix(holdings: DataFrame, entity: str, channel: str, channels: Sequence[str], sites: DataFrame, site: str, site_names: Sequence[str]) -> DataFrame:
    """A row for each entity: a flag for each channel hit and each site."""
    a = R.flags(holdings, entity, {f"hit_{c}": F.col(channel) == c for c in channels})
    b = R.flags(sites, entity, {f"site_{s}": F.col(site) == s for s in site_names})
    return R.chain_left(a, entity, [b])


def treatment_match(holdings: DataFrame, treatments: DataFrame, targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """arm, matched, n, events, median_time: whether an arm's target channel is among the entity's channels."""
    arms = treatments.join(F.broadcast(targets), "arm").select("entity", "arm", "channel").distinct()
    hit = arms.join(holdings.select("entity", "channel").distinct(), ["entity", "channel"], "left_semi").select("entity", "arm", F.lit(True).alias("matched")).distinct()
    flagged = treatments.select("entity", "arm").distinct().join(hit, ["entity", "arm"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return flagged.join(outcomes, "entity").groupBy("arm", "matched").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("events"), F.median("t").alias("median_time"))


def treatment_vector(drugs: DataFrame, entity: str, drug: str, classes: DataFrame, width: int) -> DataFrame:
    """entity, vector: 0/1 by class index; ``classes`` has name and indices (array).  Names match by containment of the known one."""
    known = F.broadcast(classes.select(F.lower("name").alias("__n"), F.explode("indices").alias("__i")))
    hits = drugs.join(known, F.contains(F.lower(F.col(drug)), F.col("__n")), "left").groupBy(entity).agg(F.collect_set("__i").alias("s"))
    return hits.select(entity, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("s", i).cast("int")).alias("vector"))


def clinical_times(df: DataFrame, entity: str, dead: Column, death: str, follow_up: str) -> DataFrame:
    """entity, t, e: days to death if dead, else the last follow-up; positive times only; first known value of each column."""
    one = df.groupBy(entity).agg(F.max(dead.cast("int")).alias("e"), F.min(death).alias("d"), F.max(follow_up).alias("f"))
    return one.withColumn("t", F.when(F.col("e") == 1, F.coalesce("d", "f")).otherwise(F.col("f"))).where("t > 0").select(entity, "t", "e")


def depth_within(holdings: DataFrame, outcomes: DataFrame, channels: int) -> DataFrame:
    """Log-rank test of many against few items (median split) among entities with a fixed number of channels."""
    per = holdings.groupBy("entity").agg(F.countDistinct("channel").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("k") == channels)
    cut = per.agg(F.median("n").alias("m"))
    split = per.crossJoin(F.broadcast(cut)).select("entity", (F.col("n") > F.col("m")).cast("int").alias("deep"))
    return V.log_rank(split.join(outcomes, "entity"), "t", "e", "deep")


def cross_or_same(holdings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entities with at least two items: one channel (same) or several (cross): n, events, rate."""
    per = holdings.groupBy("entity").agg(F.countDistinct("channel").alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.join(outcomes, "entity").groupBy(F.when(F.col("k") > 1, "cross").otherwise("same").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("events"), F.avg("e").alias("rate"))


def granularity(holdings: DataFrame, item: str, maps: Mapping[int, DataFrame], outcomes: DataFrame, penalty: float = 1e-4) -> DataFrame:
    """k, coefficient, hazard_ratio, p of the number of channels hit, for several maps of items (item, channel)."""
    out = None
    for k, m in sorted(maps.items()):
        n = holdings.select("entity", item).join(F.broadcast(m), item).groupBy("entity").agg(F.countDistinct("channel").cast("double").alias("channels"))
        fit = V.cox(outcomes.join(n, "entity", "left").fillna(0.0, ["channels"]), ["channels"], "t", "e", penalty).select(F.lit(k).alias("k"), "coefficient", "hazard_ratio", "p")
        out = fit if out is None else out.unionByName(fit)
    return out


def adjusted_cox(df: DataFrame, x: str, group: str, values: Sequence[str], penalty: float = 1e-3) -> DataFrame:
    """Crude and group-adjusted coefficients of x and the attenuation; the first value is the reference."""
    hot = R.one_hot(df, group, list(values)[1:], "g_")
    names = [f"g_{v}" for v in list(values)[1:]]
    crude = V.cox(df, [x], "t", "e", penalty).select(F.col("coefficient").alias("crude"))
    full = V.cox(hot, [x, *names], "t", "e", penalty).where(F.col("term") == x).select(F.col("coefficient").alias("adjusted"), "p")
    return crude.crossJoin(full).withColumn("attenuation", 1 - F.col("adjusted") / F.col("crude"))


def covariates(long: DataFrame, entity: str, name: str, value: str, wanted: Sequence[str], least_share: float = 0.5) -> DataFrame:
    """Long clinical attributes as columns: the least value of each; numbers where at least half of the values are numbers, else text codes (rank of the text)."""
    wide = long.groupBy(entity).pivot(name, list(wanted)).agg(F.min(value))
    shares = long.where(F.col(name).isin(*wanted)).groupBy(name).agg(F.avg(R.safe_number(value).isNotNull().cast("int")).alias("s")).collect()
    numeric = {r[name] for r in shares if r.s >= least_share}
    return wide.withColumns({c: R.safe_number(c) for c in wanted if c in numeric})


def cooccurrence_distance(holdings: DataFrame, groups: str) -> DataFrame:
    """a, b, n, distance of channels hit together more often than the median pair: 1 / n."""
    pairs = R.pairs_within(holdings, ["entity"], groups).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    m = pairs.agg(F.median("n").alias("m"))
    return pairs.crossJoin(F.broadcast(m)).where("n >= m").select("a", "b", "n", (1 / F.col("n")).alias("distance"))


def group_comparison(df: DataFrame, group: Column, event: str, sites: Sequence[str]) -> DataFrame:
    """site, a, b, c, d, log_odds, p_fisher of a group against the rest, for each 0/1 site column."""
    long = df.withColumn("__g", group).unpivot(["__g"], list(sites), "site", "v")
    return T.table_tests(T.two_by_two(long, ["site"], F.col("__g"), F.col("v") == 1)).select("site", *"abcd", "log_odds", "p_fisher")


def terminal_residues(atlas: DataFrame, lengths: DataFrame, gene: str, position: str, hr: str) -> DataFrame:
    """n, r, p of relative position in the protein against the size of the log hazard ratio."""
    joined = atlas.join(F.broadcast(lengths), gene).where((F.col(position) > 0) & (F.col("length") > 0))
    return T.pearson(joined.select((F.col(position) / F.col("length")).alias("x"), F.abs(F.log(hr)).alias("y")), "x", "y")


def position_severity(atlas: DataFrame, hubs: DataFrame, gene: str, channel: str, hr: str) -> DataFrame:
    """channel, place (hub or leaf), n, mean and median hazard ratio."""
    h = hubs.select(F.col("id").alias(gene), F.lit("hub").alias("place")).distinct()
    return atlas.join(h, gene, "left").withColumn("place", F.coalesce("place", F.lit("leaf"))).groupBy(channel, "place").agg(F.count(F.lit(1)).alias("n"), F.avg(hr).alias("mean_hr"), F.median(hr).alias("median_hr"))


def decomposition(df: DataFrame, levels: Mapping[str, str], time: str, event: str) -> DataFrame:
    """level, c_index of the scores that each level of signal gives."""
    out = None
    for name, column in levels.items():
        one = V.c_index(df, time, event, column).select(F.lit(name).alias("level"), "c_index")
        out = one if out is None else out.unionByName(one)
    return out


def confidence_bins(df: DataFrame, confidence: str, bins: int, time: str, event: str, hazard: str) -> DataFrame:
    """bin, n, c_index within quantile bins of a confidence."""
    from ..operators.aggregates import quantile_bins

    binned = quantile_bins(df, confidence, bins, "bin").persist()
    out = None
    for b in range(bins):
        part = binned.where(F.col("bin") == b)
        one = V.c_index(part, time, event, hazard).select(F.lit(b).alias("bin"), "comparable", "c_index")
        out = one if out is None else out.unionByName(one)
    return out


def gap_proposals(cases: DataFrame, group: str, item: str, gap: Column, known: DataFrame, least: int = 5, least_ratio: float = 2.0) -> DataFrame:
    """group, item pairs that are commoner among gap cases and have no edge yet: n_gap, ratio."""
    n = cases.groupBy(group, item).agg(F.count_if(gap).alias("n_gap"), F.count_if(~gap).alias("n_other"))
    total = cases.groupBy(group).agg(F.greatest(F.count_if(gap), F.lit(1)).alias("g"), F.greatest(F.count_if(~gap), F.lit(1)).alias("o"))
    scored = n.join(total, group).withColumn("ratio", ((F.col("n_gap") + 0.5) / F.col("g")) / ((F.col("n_other") + 0.5) / F.col("o")))
    return scored.where((F.col("n_gap") >= least) & (F.col("ratio") >= least_ratio)).join(known, [group, item], "left_anti").select(group, item, "n_gap", "ratio")


def class_enrichment(df: DataFrame, label: str, flag: Column) -> DataFrame:
    """label, a, b, c, d, log_odds, p_fisher: each class against all others.

    The others follow from the totals, so no class is joined to the rest.
    """
    per = df.groupBy(label).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    total = F.broadcast(df.agg(F.count_if(flag).alias("x"), F.count_if(~flag).alias("y")))
    return T.table_tests(per.crossJoin(total).select(label, "a", "b", (F.col("x") - F.col("a")).alias("c"), (F.col("y") - F.col("b")).alias("d"))).select(label, *"abcd", "log_odds", "p_fisher")


def ridge_search(df: DataFrame, x: Sequence[str], y: str, entity: str, stratum: str, alphas: Sequence[float], k: int = 5) -> DataFrame:
    """alpha, mse by k-fold cross-validation; the best first.  Each fit is one aggregation."""
    folded = T.folds(df, entity, stratum, k).persist()
    rows = []
    for a in alphas:
        error = n = 0.0
        for f in range(k):
            fit = {r.term: r.estimate for r in T.least_squares(folded.where(F.col("fold") != f), x, y, ridge=a).collect()}
            guess = sum((F.lit(fit[c]) * F.col(c) for c in x), F.lit(fit["(intercept)"]))
            r = folded.where(F.col("fold") == f).agg(F.sum((F.col(y) - guess) ** 2).alias("e"), F.count(F.lit(1)).alias("n")).first()
            error, n = error + (r.e or 0.0), n + r.n
        rows.append((float(a), error / max(n, 1)))
    folded.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), "alpha double, mse double")


def refresh(jobs: Mapping[str, tuple[Sequence[str], object]]) -> dict[str, DataFrame]:
    """Derived tables in the order of what they need: name -> (names it needs, function of those tables)."""
    from ..sources.readers import resolve

    out: dict[str, DataFrame] = {}
    for name in resolve(sorted(jobs), {n: list(needs) for n, (needs, _) in jobs.items()}):
        needs, make = jobs[name]
        out[name] = make(*(out[n] for n in needs))
    return out


def average_linkage(distances: Mapping[tuple[str, str], float], k: int) -> dict[str, int]:
    """item -> cluster of a small set of items (a channel map): average linkage down to k clusters, ties by name."""
    names = sorted({x for p in distances for x in p})
    clusters = {n: [n] for n in names}
    d = {tuple(sorted(p)): v for p, v in distances.items()}
    while len(clusters) > k:
        heads = sorted(clusters)
        mean = lambda a, b: sum(d.get(tuple(sorted((x, y))), 1.0) for x in clusters[a] for y in clusters[b]) / (len(clusters[a]) * len(clusters[b]))
        _, a, b = min((mean(a, b), a, b) for i, a in enumerate(heads) for b in heads[i + 1 :])
        clusters[a] += clusters.pop(b)
    return {x: i for i, h in enumerate(sorted(clusters)) for x in clusters[h]}


def first_channel(holdings: DataFrame, order: str) -> DataFrame:
    """entity, script: the channel of the entity's first row in an explicit order."""
    w = Window.partitionBy("entity").orderBy(order)
    return holdings.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("entity", F.col("channel").alias("script"))
