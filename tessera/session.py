"""Session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, a new one in local mode, as in tests, and an error on a cluster."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder now: their lineage ends there, and a lost executor loses nothing of them."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for loops: a checkpoint also keeps what is known of its rows' conditions, which grows from round to round."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
