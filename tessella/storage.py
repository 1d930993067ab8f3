"""Where intermediate tables live: the folder that the cluster shares through spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's intermediate tables and the session that reaches them; removed when the process ends.
_own: dict[str, SparkSession] = {}
_run = uuid.uuid4().hex


def shared_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session, else the folder that was set with setCheckpointDir; only in local
    mode, where neither is set (tests), a folder under the temp folder. On a cluster that is an error: executors see no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines reach")
        root = f"{tempfile.gettempdir()}/tessella-scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(folder: str, spark: SparkSession) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended: its folder can't be reached any more
        pass


def clear() -> None:
    """Remove the intermediate tables that this process has written; results that still read them must have been written elsewhere."""
    for folder, spark in list(_own.items()):
        _remove(folder, spark)
        del _own[folder]


atexit.register(clear)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this process."""
    own = f"{shared_root(spark)}/tessella/{_run}"
    _own[own] = spark
    return f"{own}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
