"""Structured Streaming: windows with watermarks, journals by day, staleness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark; streams need an instant, so local times are read in the session's zone."""
    return (df.withColumn(ts, F.col(ts).cast("timestamp")) if df.isStreaming else df).withWatermark(ts, late)


def windowed(df: DataFrame, ts: str, late: str, size: str, slide: str | None = None, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Tumbling or sliding windows: start, end, keys, n, total.  Works alike on a batch."""
    kept = _timed(df, ts, late)
    return kept.groupBy(F.window(ts, size, slide or size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key, ended by a gap: key, start, end, n."""
    return _timed(df, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def daily_segments(df: DataFrame, ts: str, late: str, kind: str) -> DataFrame:
    """Entries by UTC day and kind."""
    return _timed(df, ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), kind, "n")


def stale_sources(files: DataFrame, built_at: Column) -> DataFrame:
    """Files (path, modificationTime) that changed after a build."""
    return files.where(F.col("modificationTime") > built_at).select("path", "modificationTime")


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new files below a folder: path, modificationTime, length."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").load(path).select("path", "modificationTime", "length")


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there to the end and keep the result in memory; for tests and small results."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to files, exactly once by the checkpoint."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_settled(step, measure, least_gain: float, most_rounds: int) -> list[float]:
    """A feedback loop on the driver: step, measure, stop when the gain falls below a threshold; the measures."""
    out = [float(measure())]
    for _ in range(most_rounds):
        step()
        out.append(float(measure()))
        if out[-1] - out[-2] < least_gain:
            break
    return out


class GraphService:
    """Request and response on cached tables: ping, stats, check_stale, walk_entity, walk_batch, walk_all, rebuild, shutdown."""

    def __init__(self, build, key: str):
        self.build, self.key = build, key
        self.table: DataFrame | None = None

    def handle(self, request: dict) -> dict:
        command = request.get("command")
        if command == "ping":
            return {"ok": True}
        if command == "shutdown":
            if self.table is not None:
                self.table.unpersist()
            self.table = None
            return {"ok": True}
        if command == "rebuild" or self.table is None:
            if self.table is not None:
                self.table.unpersist()
            self.table = self.build().persist()
        if command == "rebuild":
            return {"ok": True}
        if command == "stats":
            return {"ok": True, "rows": self.table.count(), "columns": self.table.columns}
        if command == "check_stale":
            return {"ok": True, "stale": bool(request.get("changed_after_build"))}
        if command == "walk_entity":
            rows = self.table.where(F.col(self.key) == request["id"]).limit(1).collect()
            return {"ok": bool(rows), "row": rows[0].asDict() if rows else None}
        if command == "walk_batch":
            return {"ok": True, "rows": [r.asDict() for r in self.table.where(F.col(self.key).isin(list(request["ids"]))).collect()]}
        if command == "walk_all":
            return {"ok": True, "table": self.table}
        return {"ok": False, "error": f"unknown command {command!r}"}
