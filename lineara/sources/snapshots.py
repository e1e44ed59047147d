"""Snapshots of tables and a small key-value table, as versioned folders in any store that Spark can write to.

A version is complete when its marker (Spark's _SUCCESS) is there; readers take the newest complete one, so a job lost while
writing leaves the one before in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``, ascending."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def write(df: DataFrame, path: str) -> int:
    """Write the next version and return its number."""
    spark = df.sparkSession
    n = (versions(spark, path) or [-1])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v={n}")
    return n


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version, by default the newest; no rows where there is none yet."""
    have = versions(spark, path)
    if version is None:
        version = have[-1] if have else None
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={version}")


def existing(spark: SparkSession, path: str) -> None:
    """Refuse to start on a store that isn't there."""
    if not versions(spark, path):
        raise FileNotFoundError(f"no complete snapshot below {path}")


KV = "key string, value string"


def put(spark: SparkSession, path: str, pairs: dict[str, str]) -> None:
    """Set keys; the others keep their values."""
    old = read(spark, path, KV)
    new = spark.createDataFrame(list(pairs.items()), KV)
    write(old.join(new.select("key"), "key", "left_anti").unionByName(new), path)


def get(spark: SparkSession, path: str, key: str) -> str | None:
    row = read(spark, path, KV).where(F.col("key") == key).first()
    return row["value"] if row else None
