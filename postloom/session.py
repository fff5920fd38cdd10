"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. Sizes of partitions and the number of
# shuffle partitions belong to the cluster; AQE coalesces and splits them at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Time arithmetic in this package is defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files give fewer partitions than there are cores.

    For work that costs far more per row than moving the row, such as long cleanings of a
    few large or gzip files. A table with enough files or row groups is left as it is.
    Meant for scans: asking for the partitions of a frame with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the cluster's checkpoint folder.

    Executors on other machines must see it, so a session on a cluster has to name one in
    spark.checkpoint.dir; a machine-local folder is only made for a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="postloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/postloom/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back: lineage ends there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
