"""Calls on the file system that Spark itself uses, so every scheme and credential that Hadoop knows works."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.delete(p, True)


def publish_atomically(spark: SparkSession, staging: str, final: str) -> None:
    """Give a complete staging folder its final name; an existing target is never replaced, nor is
    anything moved into it: the file system itself refuses the rename."""
    fs, source = filesystem(spark, staging)
    _, target = filesystem(spark, final)
    if fs.exists(target):
        raise FileExistsError(final)
    fs.mkdirs(target.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(source), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise FileExistsError(final) from None
        raise OSError(f"could not publish {final}: {e.java_exception.getMessage()}") from None
