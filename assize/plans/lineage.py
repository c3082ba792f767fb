"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context); a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="assize-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def clear(spark: SparkSession) -> None:
    """Deletes this application's settled tables; at the end of the process it is done by itself, if the session is still there."""
    folder = f"{shared_dir(spark)}/assize-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # the session has ended: its folder is the cluster's to clear
        pass


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation.

    The table is zstd parquet; it lasts until ``clear`` or the end of the process.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _CLEARED:
        _CLEARED.add(spark.sparkContext.applicationId)
        atexit.register(_clear_at_exit, spark)
    path = f"{shared_dir(spark)}/assize-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
