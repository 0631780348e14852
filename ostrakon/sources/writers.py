"""Sinks: files, graph snapshots, upserts with provenance, journals.

Files are written by Spark's commit protocol, so readers see whole results or
none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_edges(batch: DataFrame, path: str) -> None:
    """Append to an edge table partitioned by type."""
    batch.write.mode("append").partitionBy("etype").parquet(path)


def merge_edges(current: DataFrame, batch: DataFrame, source: str, now: str | None = None) -> DataFrame:
    """Edges after an upsert by (src, dst, etype).

    A matched edge gets the running mean (value * n + new) / (n + 1) with its
    old number of sources n, one more source, the new time, and is active
    again; others are kept or created.  Several rows of one edge in a batch
    count as their mean.
    """
    t = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    new = batch.groupBy("src", "dst", "etype").agg(F.avg("value").alias("new"))
    joined = current.join(new, ["src", "dst", "etype"], "full_outer")
    hit, fresh = F.col("new").isNotNull() & F.col("created_at").isNotNull(), F.col("created_at").isNull()
    return joined.select(
        "src", "dst", "etype",
        F.when(hit, (F.col("value") * F.col("n_sources") + F.col("new")) / (F.col("n_sources") + 1)).when(fresh, F.col("new")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.col("n_sources") + 1).when(fresh, 1).otherwise(F.col("n_sources")).cast("int").alias("n_sources"),
        F.coalesce("source", F.lit(source)).alias("source"),
        F.coalesce("created_at", t).alias("created_at"), F.when(F.col("new").isNotNull(), t).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(F.col("new").isNotNull(), False).otherwise(F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
    )


def set_node_properties(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with numeric properties set; ``updates`` has id and a map num."""
    side = updates.select("id", F.col("num").alias("__new"))
    old = F.coalesce("num_props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return nodes.join(side, "id", "left").withColumn("num_props", F.when(F.col("__new").isNotNull(), F.map_concat(kept, F.col("__new"))).otherwise(F.col("num_props"))).drop("__new")


def drop_all(spark: SparkSession, path: str) -> None:
    """Delete a stored graph."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def journal(batch: DataFrame, path: str, kind: str, source: str, session: str, now: str) -> None:
    """Append a whole batch, so it can be replayed; one partition a UTC day."""
    t = F.lit(now).cast("timestamp")
    out = batch.select(F.to_json(F.struct(*batch.columns)).alias("entry"), F.lit(kind).alias("rel_type"), F.lit(source).alias("source"), F.lit(session).alias("session_id"), t.alias("timestamp"), F.lit("committed").alias("status"), F.date_format(t, "yyyy-MM-dd").alias("day"))
    out.write.mode("append").partitionBy("day").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry string, rel_type string, source string, session_id string, timestamp timestamp, status string, day string").json(path)


def replay(entries: DataFrame, schema: str, kind: str) -> DataFrame:
    """The rows that a journal's committed batches of one kind held."""
    return entries.where((F.col("status") == "committed") & (F.col("rel_type") == kind)).select(F.from_json("entry", schema).alias("e"), "timestamp").select("e.*", "timestamp")


def compact(entries: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Counts by day, kind and source of segments older than so many days."""
    old = entries.where(F.col("day") < F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))
    return old.groupBy("day", "rel_type", "source").agg(F.count(F.lit(1)).alias("n_edges"))


def snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Write nodes by label and edges by type as JSON lines; returns the manifest (what, name, n) read back."""
    nodes.write.mode("overwrite").partitionBy("label").json(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("etype").json(f"{path}/edges")
    spark = nodes.sparkSession
    n = spark.read.schema(nodes.schema).json(f"{path}/nodes").groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = spark.read.schema(edges.schema).json(f"{path}/edges").groupBy(F.col("etype").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("node").alias("what"), "name", "n").unionByName(e.select(F.lit("edge").alias("what"), "name", "n"))


def write_classes(collated: DataFrame, path: str) -> None:
    """One folder of JSON a class."""
    collated.write.mode("overwrite").partitionBy("class").json(path)


def write_ranges(df: DataFrame, key: str, path: str, files: int) -> None:
    """Files of consecutive ids, sorted within."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_edge_lists(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Integer edge lists by type for tensor libraries: nodes with a dense index within their label, edges by indices."""
    from ..operators.aggregates import global_rank

    numbered = global_rank(nodes.withColumn("__h", F.xxhash64("id")), ["__h", "id"], "index").select("id", "label", (F.col("index") - 1).alias("index"))
    numbered.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    spark = nodes.sparkSession
    at = spark.read.parquet(f"{path}/nodes").select("id", "index")
    out = edges.join(at.select(F.col("id").alias("src"), F.col("index").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("index").alias("d")), "dst").select("s", "d", "etype", "value")
    out.write.mode("overwrite").partitionBy("etype").parquet(f"{path}/edges")
