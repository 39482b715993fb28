"""Files that tasks write to and that anyone reads from the shared folder, whatever store it is in."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark import TaskContext
from pyspark.sql import SparkSession

from .common import new_path


def new_folder(spark: SparkSession, label: str) -> str:
    path = new_path(spark, label)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def put(folder: str, name: str, data: bytes) -> str:
    """Writes data as name, in which {} is the number of this attempt: a retried or speculative task never touches another's files. Returns the path.

    Only the paths that successful tasks returned count; files of other attempts may lie beside them.
    """
    name = name.format(TaskContext.get().taskAttemptId())
    part = f".{name}.part"
    if urlparse(folder).scheme in ("", "file"):  # the folder of spark.checkpoint.dir, which all executors share
        base = urlparse(folder).path
        with open(f"{base}/{part}", "wb") as f:
            f.write(data)
        os.replace(f"{base}/{part}", f"{base}/{name}")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{base}/{part}") as f:
            f.write(data)
        store.move(f"{base}/{part}", f"{base}/{name}")
    return f"{folder}/{name}"
