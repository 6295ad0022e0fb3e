"""Session helpers: shared folders, lineage cuts and sizing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent in a local session (tests) a temporary one is made; a
    cluster has to name its folder, as a machine's own would be seen by that machine alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fluxweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(drop_path, spark, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/fluxweave/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, nothing is local to an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a cut that nothing reads any more, such as a round before the last."""
    drop_path(df.sparkSession, df.cut_path)


def partitions(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
