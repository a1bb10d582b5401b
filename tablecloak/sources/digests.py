"""File digests and order-free table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.session import cut_lineage, local_rows
from tablecloak.sources.store import filesystem

READ_BYTES = 8 << 20
# Files up to this size are digested as one value by tasks, which takes some four times the size in memory; larger ones are
# streamed, so many at a time.
WHOLE_BYTES = 64 << 20
STREAMS = 16
NULL_TOKEN = "\\N"


def file_digests(spark: SparkSession, paths: Sequence[str], whole_bytes: int = WHOLE_BYTES, names: str = "*",
                 recursive: bool = True) -> DataFrame:
    """`path, length, sha256` of files or folders. Files are read by Spark's own reader, one task for several, or, above
    `whole_bytes`, piece by piece as one stream each: a digest has no parts that could be taken apart. Both go through the
    file system that Spark uses, so every scheme and credential that Hadoop knows works at every size."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
             .option("pathGlobFilter", names).load(list(paths)))
    small = files.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select("path", "length").collect()
    if not large:
        return small
    with ThreadPoolExecutor(STREAMS) as pool:
        digests = list(pool.map(lambda r: (r.path, r.length, stream_digest(spark, r.path)), large))
    return small.unionByName(local_rows(spark, digests, "path string, length bigint, sha256 string"))


def stream_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read through Hadoop in a buffer."""
    fs, p = filesystem(spark, path)
    stream = fs.open(p, READ_BYTES)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def folder_digests(spark: SparkSession, folder: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """`path, length, sha256` of the Parquet files below a folder."""
    return file_digests(spark, [folder], whole_bytes, "*.parquet")


def digest_status(known: Column, expected: Column, actual: Column) -> Column:
    """`ok`, `mismatch`, `no_meta` (nothing known) or `no_checksum`."""
    return (F.when(known.isNull(), "no_meta").when(expected.isNull(), "no_checksum")
            .when(expected == actual, "ok").otherwise("mismatch"))


def verify_files(files: DataFrame, sidecars: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Recompute digests of listed files and compare them with `sidecars(path, sha256)`. Only
    files that have an expected digest are read; their names, not their contents, pass the driver."""
    known = sidecars.select("path", F.col("sha256").alias("expected"), F.lit(True).alias("_meta"))
    joined = cut_lineage(files.select("path").join(known, "path", "left"))
    read = [r.path for r in joined.filter(F.col("expected").isNotNull()).select("path").distinct().collect()]
    spark = files.sparkSession
    actual = (file_digests(spark, read, whole_bytes).select("path", "sha256") if read
              else local_rows(spark, [], "path string, sha256 string"))
    status = digest_status(F.col("_meta"), F.col("expected"), F.col("sha256"))
    return joined.join(actual, "path", "left").select("path", status.alias("status"), "expected", "sha256")


def content_checksum(df: DataFrame, method: str = "md5") -> DataFrame:
    """Row count and an order-free sum of row hashes; equal for equal multisets of rows.

    `md5` hashes the rows as text, so another engine can repeat it; `xxhash64` hashes the
    stored values and is several times faster.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    if method == "xxhash64":  # a null leaves the hash as it is, so its place is hashed too
        value = F.xxhash64(*[x for c in columns for x in (c.isNull(), c)]).cast("decimal(20,0)")
    elif method == "md5":
        text = F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in columns])
        value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    else:
        raise ValueError("method must be md5 or xxhash64")
    return df.agg(F.count("*").alias("rows"),
                  F.coalesce(F.sum(value).cast("string"), F.lit("0")).alias("checksum"))
