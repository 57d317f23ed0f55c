"""Results that are kept: written to a folder that the driver and all executors share, and read from there.

What is asked for outside (pages, paid records) and what a loop builds on is computed once: a lost executor, or a second
action, reads files and asks no one again.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; all of the application's go when it ends.

    Without that setting a local master gets a temporary folder, and a cluster an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        own = _folders[sc.applicationId] = f"{base.rstrip('/')}/gleaner-kept-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{_folders[sc.applicationId]}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
