"""Scratch folders that the driver and all executors share, and small files on any store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir.  Only a local master may leave that
    unset: then it is a temporary folder of this machine; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievefp-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file(spark, path)
    return files.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place at once: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    files, new = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    option = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(new), target, how)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _file(spark, path)
    source = files.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file(spark, path)
    files.delete(where, True)
