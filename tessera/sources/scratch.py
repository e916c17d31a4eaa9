"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}


@cache
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors must reach; where that is unset, a folder of our own
    on a local master and an error on any other, whose executors would each write to their own disk. Removed by `clear` and at exit."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own()
    folder = f"{folder.rstrip('/')}/tessera-{context.applicationId}"
    if folder not in _made:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        _made[folder] = (path.getFileSystem(context._jsc.hadoopConfiguration()), path)
    return folder


def clear() -> None:
    """Removes everything cut so far; frames that read it can't be used afterwards. A long-lived session calls it once its results are written."""
    while _made:
        _, (files, path) = _made.popitem()
        try:
            files.delete(path, True)
        except Exception:  # the JVM is gone; nothing is left to ask
            pass


atexit.register(clear)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends there and no executor's loss undoes it. Written by the
    values of the column `by`, a filter on it reads only those."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    (write.partitionBy(by) if by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
