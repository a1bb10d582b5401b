"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (as `--py-files` would), so that
    Python tasks can import it on machines without a copy and keep caches between tasks."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="ship-"))
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1), "")


def ascii_lower(col: Column) -> Column:
    """Only A-Z change, unlike `lower`."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive the loss of executors; each
    keeps its columns apart, so later reads take only what they need. `drop` removes all but the
    named ones once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        from tablecloak.session import scratch_path

        self.spark, self.root, self.kept = spark, scratch_path(spark, name), []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.kept)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *but: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame, path in self.kept:
            if not any(frame is b for b in but):
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
