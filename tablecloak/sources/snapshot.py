"""Write, restore, publish and delete snapshots of table sets.

A snapshot is a folder with one Parquet folder per table, `_files` (one row per data file with
its SHA-256) and `_meta` (the sidecar). It is written to a staging path and renamed when
complete; the sidecar is written last, so a snapshot without one is incomplete also on stores
where a rename is no single step.
"""

from __future__ import annotations

import datetime
import json
import logging
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.operators.integrity import cascade_exclusions
from tablecloak.operators.stats import table_stats
from tablecloak.session import local_rows, shared_root, union_all
from tablecloak.sources.audit_log import append_audit
from tablecloak.sources.digests import content_checksum, digest_status, folder_digests
from tablecloak.sources.store import delete_path, exists, filesystem, publish_atomically

log = logging.getLogger("tablecloak")

MODES = ("full", "schema", "data")
META, FILES = "_meta", "_files"
#: Between a snapshot's name and the rest of its staging folder.
PART = ".part-"
META_SCHEMA = """host string, database string, timestamp string, backup_mode string, files bigint, size bigint,
    digest string, scrub_schema string"""
AUDIT_LINE = """timestamp string, action string, outcome string, db_host string, database string, duration_sec string,
    size string, file string, error string"""
WRITERS = 4
#: Deletions at a time.
DELETERS = 16


def folder_of(table: str) -> str:
    """A table's folder: its name, with what is no plain character (and a leading "_" or ".", which
    Spark takes for hidden) as `%XX`."""
    head = f"%{ord(table[0]):02X}" if table[:1] in ("_", ".") else quote(table[:1], safe="")
    return head + quote(table[1:], safe="")


def exclude_data(tables: Mapping[str, DataFrame], names: Sequence[str]) -> dict[str, DataFrame]:
    """Named tables keep their schema and lose their rows; their data is not scanned."""
    return {n: df.limit(0) if n in set(names) else df for n, df in tables.items()}


def captured_schema(tables: Mapping[str, DataFrame]) -> dict:
    return {"tables": {t: {"columns": {
        f.name: {"type": f.dataType.simpleString(), "nullable": f.nullable}
        for f in df.schema.fields}} for t, df in tables.items()}}


def write_tables(tables: Mapping[str, DataFrame], folder: str, workers: int = WRITERS) -> None:
    """Write each table below `folder`. Several jobs run side by side, so the last tasks of one
    table do not leave executors idle; the first failure is raised."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession

    @inheritable_thread_target(spark)
    def write(item: tuple[str, DataFrame]) -> None:
        item[1].write.parquet(f"{folder}/{folder_of(item[0])}")

    with ThreadPoolExecutor(max_workers=workers) as pool:
        list(pool.map(write, tables.items()))


def _table_file(path: str = "path") -> Column:
    """`<table>/<file>` from a file path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))


def sidecar(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame],
            info: Mapping[str, str], with_schema: bool = True) -> DataFrame:
    """Describe the data files below `folder`: writes `_files` (read once for the digests) and
    returns the `_meta` row."""
    (folder_digests(spark, folder).select(_table_file().alias("file"), "length", "sha256")
     .write.mode("overwrite").parquet(f"{folder}/{FILES}"))
    stored = spark.read.parquet(f"{folder}/{FILES}")
    digest = F.sum(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    schema = F.lit(json.dumps(captured_schema(tables)) if with_schema else None).cast("string")
    return stored.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
                      F.coalesce(digest, F.lit("0")).alias("digest")).select(
        *[F.lit(v).alias(k) for k, v in info.items()], "files", "size", "digest",
        schema.alias("scrub_schema"))


def snapshot(tables: Mapping[str, DataFrame], dest: str, *, mode: str = "full",
             exclude: Sequence[str] = (), fk_edges: DataFrame | None = None, host: str = "",
             database: str = "", timestamp: str = "", audit_path: str | None = None) -> str:
    """Write all tables and the sidecar to `dest`.

    `schema` writes structure without rows, `data` rows without the captured schema. Excluded
    tables keep their structure only; with `fk_edges(child, parent)` so do the tables that
    reference them, directly or not. The outcome is appended to the log at `audit_path`.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    spark = next(iter(tables.values())).sparkSession
    if exclude and fk_edges is not None:
        exclude = [*exclude, *dependents(tables, exclude, fk_edges)]
    chosen = exclude_data(tables, list(tables) if mode == "schema" else exclude)
    staging = f"{dest}{PART}{uuid.uuid4().hex}"
    start, outcome, error = time.time(), "failure", None
    try:
        write_tables(chosen, staging)
        info = {"host": host, "database": database, "timestamp": timestamp, "backup_mode": mode}
        meta = sidecar(spark, staging, chosen, info, with_schema=mode != "data")
        meta.write.json(f"{staging}/{META}")
        publish_atomically(spark, staging, dest)
        outcome = "success"
    except Exception as e:
        error = str(e).splitlines()[0] if str(e) else type(e).__name__
        delete_path(spark, staging)
        raise
    finally:
        if audit_path:
            size = spark.read.json(f"{dest}/{META}").first()["size"] if outcome == "success" else None
            append_audit(local_rows(spark, [(
                datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "backup", outcome,
                host, database, str(int(time.time() - start)), None if size is None else str(size), dest, error)],
                AUDIT_LINE), audit_path)
    return dest


def dependents(tables: Mapping[str, DataFrame], names: Sequence[str], fk_edges: DataFrame) -> list[str]:
    """Those of the given tables that reference a named one, directly or not."""
    spark = fk_edges.sparkSession
    added = cascade_exclusions(fk_edges, local_rows(spark, [(n,) for n in names], "table string"))
    own = local_rows(spark, [(n,) for n in tables], "table string")
    return [r["table"] for r in added.join(F.broadcast(own), "table", "left_semi").collect()]


def snapshot_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue rows of the complete snapshots at `<root>/<host>/<database>/<timestamp>`, from their
    sidecars: `host, database, file, path, mtime, size, files, backup_mode`. `mtime` is the time
    in the snapshot's own stamp (`yyyyMMdd_HHmmss`)."""
    meta = spark.read.schema(META_SCHEMA).json(f"{root}/*/*/*/{META}")
    path = F.regexp_replace(F.col("_metadata.file_path"), f"/{META}/[^/]*$", "")
    stamp = F.try_to_timestamp(F.col("timestamp"), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
    return (meta.select("host", "database", F.element_at(F.split(path, "/"), -1).alias("file"), path.alias("path"),
                        stamp.alias("mtime"), "size", "files", "backup_mode")
            .filter(~F.col("file").contains(PART)))


def snapshot_tables(spark: SparkSession, path: str) -> list[str]:
    """Table names of a snapshot, from its folders."""
    fs, p = filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(unquote(n) for n in names if not n.startswith("_"))


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not exists(spark, f"{path}/{META}"):
        raise FileNotFoundError(f"no complete snapshot at {path}")
    return {t: spark.read.parquet(f"{path}/{folder_of(t)}") for t in snapshot_tables(spark, path)}


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Status per data file of a snapshot: `ok`, `mismatch`, `missing` or `no_meta`."""
    expected = spark.read.parquet(f"{path}/{FILES}").select(
        "file", F.col("sha256").alias("expected"), F.lit(True).alias("_meta"))
    # names that start with "_" are no data and are not listed
    actual = folder_digests(spark, path).select(
        _table_file().alias("file"), "sha256", F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").otherwise(
        digest_status(F.col("_meta"), F.col("expected"), F.col("sha256")))
    return expected.join(actual, "file", "full").select(
        F.col("file").alias("path"), status.alias("status"), "expected", "sha256")


def require_intact(spark: SparkSession, path: str) -> None:
    """Raise when a snapshot is incomplete, or a data file is missing, does not match its digest or
    was put there by something else. No table is opened before that."""
    if not exists(spark, f"{path}/{META}"):
        raise FileNotFoundError(f"no complete snapshot at {path}")
    bad = verify_snapshot(spark, path).filter(F.col("status") != "ok").count()
    if bad:
        raise OSError(f"{bad} data file(s) of {path} do not match their digest or have none")


def restore(spark: SparkSession, path: str, target: str, *, verify: bool = True) -> dict[str, DataFrame]:
    """Load a snapshot into a new folder and return its tables; the snapshot stays as it is.

    A digest that does not match stops the restore before anything is written.
    """
    if verify:
        require_intact(spark, path)
    tables = read_snapshot(spark, path)
    staging = f"{target}.part-{uuid.uuid4().hex}"
    try:
        write_tables(tables, staging)
        publish_atomically(spark, staging, target)
    except Exception:
        delete_path(spark, staging)
        raise
    return {t: spark.read.parquet(f"{target}/{folder_of(t)}") for t in tables}


def load_jdbc(tables: Mapping[str, DataFrame], url: str, options: Mapping[str, str] | None = None) -> None:
    """Load tables into a new, empty database; a table that exists already is an error."""
    for name, df in tables.items():
        (df.write.format("jdbc").option("url", url).option("dbtable", name)
         .options(**(options or {})).mode("error").save())


def snapshot_all(spark: SparkSession, databases: Mapping[str, Mapping[str, DataFrame]], dest: str,
                 workers: int = 4, **options) -> DataFrame:
    """Snapshot every database of a host; a failure does not stop the others. One row each."""

    @inheritable_thread_target(spark)
    def one(name: str) -> tuple[str, str, str]:
        try:
            snapshot(databases[name], f"{dest}/{name}", database=name, **options)
            return name, "success", ""
        except Exception as e:
            log.warning("snapshot of %s failed: %s", name, e)
            return name, "failure", str(e).splitlines()[0]

    with ThreadPoolExecutor(max_workers=workers) as pool:
        rows = list(pool.map(one, sorted(databases)))
    return local_rows(spark, rows, "database string, outcome string, error string")


def snapshot_counts(spark: SparkSession, path: str) -> DataFrame:
    return table_stats(read_snapshot(spark, path)).select("table", "rows")


def roundtrip(tables: Mapping[str, DataFrame], copies: Mapping[str, DataFrame],
              method: str = "xxhash64") -> DataFrame:
    """Row counts of tables next to whether their copies hold the same rows."""

    def sums(group: Mapping[str, DataFrame], side: str) -> DataFrame:
        return union_all([content_checksum(df, method).select(
            F.lit(t).alias("table"), F.col("rows").alias(f"{side}_rows"),
            F.col("checksum").alias(f"{side}_checksum")) for t, df in sorted(group.items())])

    both = sums(tables, "source").join(sums(copies, "copy"), "table", "full")
    return both.select("table", F.col("source_rows").alias("rows"),
                       F.col("source_checksum").alias("checksum"),
                       (F.col("source_rows").eqNullSafe(F.col("copy_rows"))
                        & F.col("source_checksum").eqNullSafe(F.col("copy_checksum"))).alias("equal"))


def apply_retention(marked: DataFrame, dry_run: bool = True, journal: str | None = None) -> int:
    """Delete marked snapshots (rows with a `path`) and their sidecars; return how many were marked.

    The marks are written to a journal before anything goes, and taken from it when all are gone, so a
    run that stops half-way is finished by the next one. A snapshot loses its sidecar first: what a stopped run
    leaves counts as incomplete. Deletions go through Hadoop; the journal lies in the shared folder unless
    another is named. A repeated run finds less to do and is safe."""
    spark = marked.sparkSession
    if dry_run:
        return marked.count()
    root = journal or f"{shared_root(spark)}/tablecloak/retention"
    finish_retention(spark, root)
    run = f"{root}/{uuid.uuid4().hex}"
    marked.select("path").write.parquet(run)
    n = spark.read.schema("path string").parquet(run).count()
    finish_retention(spark, root)
    return n


def finish_retention(spark: SparkSession, journal: str) -> int:
    """Delete what open journals name; returns how many journals were closed."""
    fs, folder = filesystem(spark, journal)
    runs = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    runs = [r for r in runs if exists(spark, f"{r}/_SUCCESS")]
    for run in runs:
        names = (r.path for r in spark.read.schema("path string").parquet(run).distinct().toLocalIterator())
        with ThreadPoolExecutor(DELETERS) as pool:
            list(pool.map(lambda path: _delete_snapshot(spark, path), names))
        delete_path(spark, run)
    return len(runs)


def _delete_snapshot(spark: SparkSession, path: str) -> None:
    for part in (f"{path}.meta.json", f"{path}/{META}", path, f"{path}.globals.sql"):
        delete_path(spark, part)
