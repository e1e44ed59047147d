"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lineara")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LINEARA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests, one machine) a local folder is made and set; on a cluster
    its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineara-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that queries leave in the shared folder, as their results are read from them.
KEPT = ("signed-", "posteriors-", "shard-keys-", "warc-", "pipeline-", "stream-", "lexical-", "align-", "landed-")


def landed(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read from it: compressed, and a later step reads only the columns that it needs."""
    path = f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Remove the folders of queries that began more than ``hours`` ago, whose results nobody reads any more, and return their names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    gone = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith(KEPT) and s.getModificationTime() < oldest and fs.delete(s.getPath(), True):
            gone.append(name)
    return sorted(gone)
