"""The document pipeline: sections, chunks, clusters, labels, phrases, representatives, pairs of classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.similarity import cosine, dot, unit
from ..session import cut

#: Words that say nothing in a label; a fixed list.
STOP = ("the and for that this with from are was were has have had not but its their which these those into over under than then there where when what who how".split())
# Patterns of structure in LaTeX texts.
#: Named items: their kind and number.
STRUCTURE = {
    "theorems": r"(?i)\\textbf\{(Theorem|Lemma|Corollary|Proposition)\s*(\d+[a-z]?)\}",
    "definitions": r"(?i)\\textbf\{(Definition|Def\.?)\s*(\d+[a-z]?)\}",
    "claims": r"(?i)\\textbf\{(Claim|Conjecture|Remark|Open Question)\s*(\d+[a-z]?)\}",
}
CITATION = r"\{?\[([A-Za-z][A-Za-z0-9]+\d{4}[a-z]?(?:,\s*[A-Za-z][A-Za-z0-9]+\d{4}[a-z]?)*)\]\}?"
BOLD = r"\\textbf\{([^}]{10,80})\}"
MATH = r"\\\(|\\\[|\$"


def strip_markup(text: Column) -> Column:
    """Text without comments, commands and braces; commands leave their argument."""
    t = F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")
    t = F.regexp_replace(t, r"\\(?:begin|end)\{[^}]*\}", " ")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[{}~]", " "), r"[ \t]+", " "))


def sections(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Lines with the path of headings above them (an array): a heading of one level ends deeper ones.

    Headings are Markdown (#) or LaTeX (section, subsection, subsubsection).
    """
    md = F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)
    tex = F.regexp_extract(line, r"^\\((?:sub){0,2})section\*?\{([^}]*)\}", 0)
    level = F.when(md != "", F.length(md)).when(tex != "", F.length(F.regexp_extract(line, r"^\\((?:sub){0,2})section", 1)) / 3 + 1).cast("int")
    title = F.when(md != "", F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)).when(tex != "", F.regexp_extract(line, r"section\*?\{([^}]*)\}", 1))
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("__l", level).withColumn("__t", title)
    for k in range(1, 7):
        out = out.withColumn(f"__at{k}", F.max(F.when(F.col("__l") == k, F.col(pos))).over(w)).withColumn(f"__up{k}", F.max(F.when(F.col("__l") < k, F.col(pos))).over(w)).withColumn(f"__n{k}", F.last(F.when(F.col("__l") == k, F.col("__t")), ignorenulls=True).over(w))
    path = F.array_compact(F.array(*(F.when(F.col(f"__at{k}") > F.coalesce(F.col(f"__up{k}"), F.lit(-1)), F.col(f"__n{k}")) for k in range(1, 7))))
    return out.withColumn("section_path", path).withColumn("is_heading", F.col("__l").isNotNull()).select(*lines.columns, "section_path", "is_heading")


def pack_paragraphs(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs packed into chunks of at most ``most`` characters, each after the first starting with the end of the one before; longer paragraphs are cut."""
    out, now = [], ""
    for paragraph in (p.strip() for p in text.split("\n\n")):
        while paragraph:
            room = most - len(now) - (2 if now else 0)
            if len(paragraph) <= room:
                now += ("\n\n" if now else "") + paragraph
                break
            if now and now != out[-1][-overlap:] if out and overlap else now:
                out.append(now)
                now = now[-overlap:] if overlap else ""
                if len(paragraph) <= most - len(now) - (2 if now else 0):
                    continue
            room = max(1, most - len(now) - (2 if now else 0))
            now += ("\n\n" if now else "") + paragraph[:room]
            paragraph = paragraph[room:]
            out.append(now)
            now = now[-overlap:] if overlap and paragraph else ""
    if now:
        out.append(now)
    return out


def chunk(docs: DataFrame, key: str, text: str, most: int = 1500, overlap: int = 200) -> DataFrame:
    """key, chunk_index, text, char_count, token_estimate (a quarter of the characters)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"]) for i, c in enumerate(pack_paragraphs(t or "", most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk_index int, text string")
    return out.withColumn("char_count", F.length("text")).withColumn("token_estimate", F.floor(F.length("text") / 4).cast("int"))


def structure(df: DataFrame, text: str, most_bold: int | None = None) -> DataFrame:
    """Adds what a LaTeX text states by its marks.

    theorems, definitions, claims: arrays of (type, number), in order;
    citations: keys such as Name2001a, distinct, in order; bold_claims: bold
    phrases of 10 to 80 characters, in order, the first ``most_bold`` if that
    is given; has_math.  All are null for a null text.
    """
    t = F.col(text)
    found = {}
    for name, p in STRUCTURE.items():
        kinds, numbers = (F.regexp_extract_all(t, F.lit(p), F.lit(k)) for k in (1, 2))
        found[name] = F.zip_with(kinds, numbers, lambda k, n: F.struct(k.alias("type"), n.alias("number")))
    keys = F.transform(F.regexp_extract_all(t, F.lit(CITATION), F.lit(1)), lambda c: F.split(c, r",\s*"))
    bold = F.transform(F.regexp_extract_all(t, F.lit(BOLD), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    found |= {"citations": F.array_distinct(F.flatten(keys)), "bold_claims": bold if most_bold is None else F.slice(bold, 1, most_bold), "has_math": t.rlike(MATH)}
    return df.withColumns(found)


def tfidf(docs: DataFrame, key: str, text: str, most_words: int = 3, top: int = 10) -> DataFrame:
    """key, phrase, score, rank: word 1- to 3-grams by (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), the best of each document."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    base = docs.select(key, words.alias("w"))
    grams = [F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i, k=k: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>")) for k in ()]
    del grams
    parts = [base.select(key, F.explode("w").alias("phrase"))]
    for k in range(2, most_words + 1):
        parts.append(base.where(F.size("w") >= k).select(key, F.expr(f"explode(transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' ')))").alias("phrase")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    tf = all_.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(docs.agg(F.countDistinct(key).alias("n")))
    scored = tf.join(df, "phrase").crossJoin(n).withColumn("score", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "phrase", "score", "rank")


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """(key, vector of length one, class) and the centroids: spherical k-means; each round is one aggregation of k sums."""
    base = cut(vectors.select(key, unit(F.col(vector)).alias("v")), "vectors")
    first = base.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).limit(k).select("v").collect()
    centres = np.array([r.v for r in first])
    for _ in range(rounds):
        placed = assign(base, "v", centres)
        width = centres.shape[1]
        sums = {r["class"]: np.array(r.s) for r in placed.groupBy("class").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(width))).alias("s")).collect()}
        new = np.array([sums.get(i, centres[i]) for i in range(len(centres))])
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-6:
            break
    return assign(base, "v", centres), centres


def assign(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Adds ``class``: the centroid with the highest cosine (the least among equals)."""
    lengths = np.linalg.norm(centres, axis=1) + 1e-300
    scores = F.array(*(dot(F.col(vector), F.array(*(F.lit(float(x)) for x in c))) / float(n) for c, n in zip(centres, lengths)))
    return df.withColumn("__s", scores).withColumn("class", (F.array_position("__s", F.array_max("__s")) - 1).cast("int")).drop("__s")


def silhouette(placed: DataFrame, vector: str = "v", label: str = "class") -> DataFrame:
    """Mean cosine silhouette of unit vectors, from sums by class: no pair is formed."""
    width = len(placed.select(vector).first()[0])
    sums = placed.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(vector)[i]) for i in range(width))).alias("s"))
    pairs = placed.select(F.monotonically_increasing_id().alias("id"), vector, F.col(label).alias("own")).crossJoin(F.broadcast(sums))
    d = F.when(F.col("own") == F.col(label), F.when(F.col("n") > 1, 1 - (dot(F.col(vector), F.col("s")) - dot(F.col(vector), F.col(vector))) / (F.col("n") - 1))).otherwise(1 - dot(F.col(vector), F.col("s")) / F.col("n"))
    per = pairs.withColumn("d", d).groupBy("id").agg(F.max(F.when(F.col("own") == F.col(label), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col(label), F.col("d"))).alias("b"))
    return per.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def choose_k(vectors: DataFrame, key: str, vector: str, ks: Sequence[int]) -> DataFrame:
    """k, silhouette; the best first."""
    rows = [(k, silhouette(kmeans(vectors, key, vector, k)[0]).first()[0]) for k in ks]
    return vectors.sparkSession.createDataFrame(sorted(((k, float(s)) for k, s in rows), key=lambda r: (-r[1], r[0])), "k int, silhouette double")


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, n, centroid (mean vector); by position, so no vector list is gathered."""
    long = df.select(label, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(label, F.expr("transform(p, q -> q.m)").alias("centroid"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(c, label)


def memberships(df: DataFrame, key: str, vector: str, label: str, centres: DataFrame, threshold: float = 0.55) -> DataFrame:
    """key, class, score, is_primary: the own class and all whose centroid reaches the threshold (dot product with the unit vector, as centroids are not renormalised)."""
    c = F.broadcast(centres.select(F.col(label).alias("class"), "centroid"))
    out = df.select(key, F.col(label).alias("own"), unit(F.col(vector)).alias("u")).crossJoin(c).withColumn("score", dot(F.col("u"), F.col("centroid")))
    return out.where((F.col("class") == F.col("own")) | (F.col("score") >= threshold)).select(key, "class", "score", (F.col("class") == F.col("own")).alias("is_primary"))


def bridge_pairs(members: DataFrame, key: str) -> DataFrame:
    """class_a, class_b, weight, keys: chunks that belong to both."""
    a, b = members.select(key, F.col("class").alias("class_a")), members.select(key, F.col("class").alias("class_b"))
    return a.join(b, key).where("class_a < class_b").groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_list(key)).alias("keys"))


def class_labels(titles: DataFrame, label: str, title: str, top: int = 3) -> DataFrame:
    """label, words: the commonest words of titles with more than three letters that are no stop words."""
    words = titles.select(label, F.explode(F.split(F.lower(F.col(title)), r"[^\p{L}]+")).alias("w")).where((F.length("w") > 3) & ~F.col("w").isin(*STOP))
    n = words.groupBy(label, "w").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label).orderBy(F.desc("n"), "w")
    best = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return best.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("p")).select(label, F.expr("array_join(transform(p, x -> x.w), ' ')").alias("words"))


def representatives(df: DataFrame, key: str, vector: str, label: str, centres: DataFrame, top: int = 3) -> DataFrame:
    """label, key, score, rank of the members closest to their centroid."""
    s = df.select(key, label, unit(F.col(vector)).alias("u")).join(F.broadcast(centres.select(label, "centroid")), label).withColumn("score", dot(F.col("u"), F.col("centroid")))
    w = Window.partitionBy(label).orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(label, key, "score", "rank")


def cross_manifest(centres: DataFrame, label: str, bridges: DataFrame) -> DataFrame:
    """class_a, class_b, priority (1: bridged), weight (bridge weight, else cosine of centroids), in order."""
    a = centres.select(F.col(label).alias("class_a"), F.col("centroid").alias("ca"))
    b = centres.select(F.col(label).alias("class_b"), F.col("centroid").alias("cb"))
    pairs = a.join(b, F.col("class_a") < F.col("class_b")).join(bridges.select("class_a", "class_b", F.col("weight").cast("double").alias("w")), ["class_a", "class_b"], "left")
    return pairs.select("class_a", "class_b", F.when(F.col("w").isNotNull(), 1).otherwise(2).alias("priority"), F.coalesce("w", cosine(F.col("ca"), F.col("cb"))).alias("weight")).orderBy("priority", F.desc("weight"), "class_a", "class_b")


def score_pairs(reps: DataFrame, vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """class_a, class_b, a, b, cosine of the best representative of each class."""
    one = reps.where("rank = 1").select(label, key).join(vectors.select(key, vector), key)
    a = one.select(F.col(label).alias("class_a"), F.col(key).alias("a"), F.col(vector).alias("va"))
    b = one.select(F.col(label).alias("class_b"), F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("class_a") < F.col("class_b")).select("class_a", "class_b", "a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def collate(members: DataFrame, chunks: DataFrame, key: str, reps: DataFrame, label: str) -> DataFrame:
    """class, representative, n, chunks (key, is_bridge; the representative first, then by key)."""
    n = members.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("is_bridge"))
    best = reps.where("rank = 1").select(F.col(label).alias("class"), F.col(key).alias("representative"))
    joined = members.join(chunks.select(key), key, "left_semi").join(n, key).join(best, "class")
    item = F.struct((F.col(key) != F.col("representative")).alias("later"), F.col(key).alias("key"), "is_bridge")
    return joined.groupBy("class", "representative").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("c")).select("class", "representative", "n", F.expr("transform(c, x -> struct(x.key, x.is_bridge))").alias("chunks"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not yet done, so a stage can be taken up again."""
    return items.join(done.select(key), key, "left_anti")
