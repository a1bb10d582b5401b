"""Compare schemas with masking manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecloak.operators.discover import (JSON_TYPES, add_hit, add_match, hit_fields,
                                            manifest_dictionary, suggestion)
from tablecloak.operators.skew import salted_join
from tablecloak.session import local_rows

# Kinds of drift; the last one only warns.
NEW_COLUMN = "new_column"
NEW_TABLE = "new_table"
MISSING = "missing_declared"
JSON_UNDECLARED = "json_undeclared"
WARNING = "no_pii_warning"

MANIFEST_COLUMNS = "database string, table string, column string, strategy string, no_pii boolean"


def manifest_rows(spark: SparkSession, manifest: Mapping, database: str) -> DataFrame:
    """A driver-side manifest as rows; a `no_pii` table is one row without a column."""
    rows = []
    for table, entry in manifest.get("tables", {}).items():
        no_pii = bool(entry.get("no_pii"))
        if no_pii or not entry.get("columns"):
            rows.append((database, table, None, None, no_pii))
        for column, spec in entry.get("columns", {}).items():
            rows.append((database, table, column, spec.get("strategy"), no_pii))
    return local_rows(spark, rows, MANIFEST_COLUMNS)


def _shared_keys(catalog: DataFrame, manifest: DataFrame) -> list[str]:
    """What names a table on both sides. A catalogue of several hosts needs a manifest that names
    them, or equal names of two hosts would be taken for one table."""
    hosts = ["host" in df.columns for df in (catalog, manifest)]
    if any(hosts) and not all(hosts):
        raise ValueError("catalogue and manifest must both name hosts, or neither")
    return [*(["host"] if all(hosts) else []), "database", "table"]


def _scope(drift: DataFrame, *keys: str) -> list[str]:
    return [c for c in ("host", *keys) if c in drift.columns]


def schema_drift(catalog: DataFrame, manifest: DataFrame,
                 dictionary: Sequence[str] | None = None) -> DataFrame:
    """One row per finding: `[host,] database, table, kind, column, type, pattern, suggested`.

    Tables are told apart by host where both sides name hosts. Catalogue and manifest rows meet
    in one union that is shuffled once by table; the per-column merge and the per-table flags
    both reuse that partitioning. A table's columns are few, so no partition key is hot. Names
    are matched before the shuffle, which carries the position of the match only.
    """
    none = F.lit(None)
    keys = _shared_keys(catalog, manifest)
    live = add_hit(catalog, "column", dictionary).select(
        *keys, "column", "type", "hit", F.lit(True).alias("live"),
        F.lit(False).alias("declared"), F.lit(False).alias("no_pii"))
    said = manifest.select(
        *keys, "column", none.cast("string").alias("type"), none.cast("int").alias("hit"),
        F.lit(False).alias("live"), F.lit(True).alias("declared"),
        F.coalesce("no_pii", F.lit(False)).alias("no_pii"))
    per_column = (live.unionByName(said).repartition(*keys)
                  .groupBy(*keys, "column")
                  .agg(F.max("type").alias("type"), F.max("hit").alias("hit"), F.max("live").alias("live"),
                       F.max("declared").alias("declared"), F.max("no_pii").alias("no_pii")))
    w = W.partitionBy(*keys)
    flagged = (per_column
               .withColumn("known", F.max("declared").over(w))
               .withColumn("table_no_pii", F.max("no_pii").over(w))
               .filter(F.col("column").isNotNull())
               .withColumns(hit_fields(dictionary)))
    matched = F.col("pattern").isNotNull()
    is_json = F.col("type").isin(*JSON_TYPES)
    kind = (
        F.when(~F.col("live"), MISSING)
        .when(F.col("table_no_pii"), F.when(matched, WARNING))
        .when(F.col("declared"), F.lit(None))
        .when(is_json, JSON_UNDECLARED)
        .when(matched & F.col("known"), NEW_COLUMN)
        .when(matched, NEW_TABLE))
    named = F.col("kind").isin(NEW_COLUMN, NEW_TABLE)
    return (flagged.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .select(*keys, "kind", "column",
                    F.when(named, F.col("type")).alias("type"),
                    F.when(named | (F.col("kind") == WARNING), F.col("pattern")).alias("pattern"),
                    F.when(named, suggestion("strategy", "param")).alias("suggested")))


def drift_ok(drift: DataFrame) -> DataFrame:
    """True when nothing but warnings was found."""
    return drift.agg(F.coalesce(F.bool_and(F.col("kind") == WARNING), F.lit(True)).alias("ok"))


def drift_ok_by_database(drift: DataFrame, databases: DataFrame) -> DataFrame:
    """The same per database, including those without any finding."""
    keys = _scope(drift, "database")
    per = drift.groupBy(*keys).agg(F.bool_and(F.col("kind") == WARNING).alias("_ok"))
    return databases.select(*keys).distinct().join(per, keys, "left").select(
        *keys, F.coalesce("_ok", F.lit(True)).alias("ok"))


def new_tables_grouped(drift: DataFrame) -> DataFrame:
    """Matches of each new table as a nested array (one table's columns)."""
    return (drift.filter(F.col("kind") == NEW_TABLE).groupBy(*_scope(drift, "database", "table"))
            .agg(F.array_sort(F.collect_list(F.struct("column", "type", "pattern", "suggested")))
                 .alias("matches")))


def check_manifest_drift(catalog: DataFrame, manifest: Mapping, database: str) -> DataFrame:
    """Drift of one dataset against its driver-side manifest."""
    spark = catalog.sparkSession
    return schema_drift(catalog.drop("host").withColumn("database", F.lit(database)),
                        manifest_rows(spark, manifest, database), manifest_dictionary(manifest))


def preflight_drift(snapshots: DataFrame, captured: DataFrame, manifest: DataFrame,
                    dictionary: Sequence[str] | None = None) -> DataFrame:
    """`clean`, `drift` or `deferred` (no captured schema) for every snapshot of a fleet.

    `snapshots(snapshot_id, host)`, `captured(snapshot_id, host, table, column, type)`,
    `manifest(host, table, column, no_pii)`; an optional `has_schema` flag on a snapshot tells
    an empty captured schema from none. A missing declared column shows as a declared
    count that the snapshot does not reach, so no snapshot is multiplied by a manifest.
    """
    declared = (manifest.filter(F.col("column").isNotNull())
                .select("host", "table", "column").distinct())
    per_host = declared.groupBy("host").agg(F.count("*").alias("n_declared"))
    tables = manifest.groupBy("host", "table").agg(
        F.max(F.coalesce("no_pii", F.lit(False))).alias("table_no_pii"))
    named = salted_join(add_match(captured, "column", dictionary),
                        declared.withColumn("is_declared", F.lit(True)),
                        ["host", "table", "column"], ["snapshot_id"], "left")
    rows = salted_join(named, tables, ["host", "table"], ["snapshot_id"], "left")
    undeclared = F.col("is_declared").isNull() & ~F.coalesce("table_no_pii", F.lit(False))
    failing = undeclared & (F.col("type").isin(*JSON_TYPES) | F.col("pattern").isNotNull())
    per_snapshot = rows.groupBy("snapshot_id").agg(
        F.count_if(failing).alias("n_failing"),
        F.count_if(F.col("is_declared")).alias("n_found"))
    has_schema = F.col("has_schema") if "has_schema" in snapshots.columns \
        else F.col("n_failing").isNotNull()
    zero = F.lit(0).cast("bigint")
    checked = snapshots.join(per_snapshot, "snapshot_id", "left")
    return (salted_join(checked, per_host, ["host"], ["snapshot_id"], "left")
            .select("snapshot_id", "host",
                    F.when(~has_schema, "deferred")
                    .when((F.coalesce("n_failing", zero) > 0)
                          | (F.coalesce("n_declared", zero) > F.coalesce("n_found", zero)), "drift")
                    .otherwise("clean").alias("status")))


def manifest_status(hosts: DataFrame, manifests: DataFrame, databases: DataFrame) -> DataFrame:
    """Coverage report: manifest there, required, safety, and the databases of each host."""
    safety = F.when(F.col("safety").isin("prod", "stage", "local"), F.col("safety")) \
        .otherwise("local")
    names = databases.select("host", "database").distinct().groupBy("host").agg(
        F.count("*").alias("database_count"),
        F.min("database").alias("first_database"), F.max("database").alias("last_database"))
    known = manifests.select("host").distinct().withColumn("manifest_exists", F.lit(True))
    return (hosts.join(known, "host", "left").join(names, "host", "left")
            .select("host", "type", safety.alias("safety"),
                    F.coalesce("manifest_exists", F.lit(False)).alias("manifest_exists"),
                    F.coalesce("required", F.lit(False)).alias("scrub_required"),
                    F.coalesce("database_count", F.lit(0).cast("bigint")).alias("database_count"),
                    "first_database", "last_database"))


def host_databases(databases: DataFrame) -> DataFrame:
    """Database names of each host as rows in order (the list form of the coverage report)."""
    return databases.select("host", "database").distinct().orderBy("host", "database")
