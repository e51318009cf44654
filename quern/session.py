"""Session builder and the folder that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quern", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and Arrow. ``master`` and ``shuffle`` are for local runs; a cluster sets its own."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b.getOrCreate()


def plain_unions(spark: SparkSession) -> None:
    """Keep unions from zipping the partitions of equally partitioned inputs: AQE may have coalesced one of them, and the
    query then fails with "Can't zip RDDs with unequal numbers of partitions" (seen with Spark 4.1.2)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of Python tasks small, whatever the length of rows: they are limited by rows only otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where it is unset (tests, one machine) a temporary folder is made and set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; call it once the results are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
