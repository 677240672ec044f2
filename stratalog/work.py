"""The shared work folder, and lineage cuts through written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, since no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="stratalog-")
    return _own[app]


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, under a folder of the application's own, which goes when
    the driver ends."""
    app = spark.sparkContext.applicationId
    own = f"{shared_dir(spark)}/stratalog/{app}"
    if own not in _owned:
        fs, at = _hadoop(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _owned.add(own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of executors, and a plan that uses
    the table several times computes it once.
    """
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        fs, at = _hadoop(df.sparkSession, df._written)
        fs.delete(at, True)
