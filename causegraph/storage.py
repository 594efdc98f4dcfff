"""The folder that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the driver ends.

    Only with a local master, where driver and executors are one process, may the
    setting be absent; a temporary folder serves then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    key = (spark.sparkContext.applicationId, base or "")
    if key not in _ROOTS:
        if not base:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="causegraph-")
        _ROOTS[key] = f"{base.rstrip('/')}/causegraph-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[key])
    return _ROOTS[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and
    lost executors lose nothing."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
