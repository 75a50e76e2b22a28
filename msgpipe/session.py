"""Session settings the jobs rely on, and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone, ANSI), let Spark re-plan at run time
# or bound memory. Other sizes such as shuffle partitions stay with the cluster; AQE coalesces.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bodies vary from bytes to megabytes: bound what one Python batch holds.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}

# Settings only a new session can take: recording a call site for every Column
# costs most of a large plan's set-up time.
BUILDER_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(app_name: str) -> SparkSession.Builder:
    """A session builder with every setting the jobs profit from."""
    chosen = SparkSession.builder.appName(app_name)
    for key, value in {**BUILDER_CONF, **SESSION_CONF}.items():
        chosen = chosen.config(key, value)
    return chosen


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job assumes to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in only in local mode; on a cluster an unset
    folder is an error, because executors could not see a driver-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="msgpipe-staging-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/msgpipe/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder through Spark's own file system layer; False if absent."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    Cuts lineage in a way that survives executor loss, so several consumers can
    use the result of an expensive step (the responder) without re-running it.
    """
    spark = df.sparkSession
    path = new_staging_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
