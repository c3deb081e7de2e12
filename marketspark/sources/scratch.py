"""A folder for what a query writes and reads back.

It is the one that the cluster names in ``spark.checkpoint.dir``, which driver and executors
share. Only in local mode, where they are one process, a temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets; raises on a cluster that names no shared folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-market-"))
        shared = _local[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
