"""Sessions and the cutting of lineage."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()


def session(name: str = "ostrakon", **config: str) -> SparkSession:
    """A session with the settings that the operators expect; the cluster's own settings win where it names them."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | config).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that ``spark.checkpoint.dir`` names; a local session may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = (folder or "/tmp/checkpoints").rstrip("/")
    return f"{folder}/{spark.sparkContext.applicationId}/{name}-{next(_serial)}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again, so iterations have short plans and lost executors cost a reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
