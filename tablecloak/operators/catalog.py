"""Snapshot catalogue: listing, newest file, retention, usage, sync, inventory.

Catalogue rows are `host, database, file, path, mtime, size`. `mtime` is a UTC timestamp
without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecloak.functions.scalars import SNAPSHOT_NAME, epoch_seconds, iso_z
from tablecloak.operators.skew import salted_join

PAIR = ("host", "database")
DAY = 86400
SAFETY = ("prod", "stage", "local")


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def list_backups(catalog: DataFrame, host: str | None = None,
                 database: str | None = None) -> DataFrame:
    """Newest name first inside each pair."""
    out = catalog
    if host is not None:
        out = out.filter(F.col("host") == host)
    if database is not None:
        out = out.filter(F.col("database") == database)
    return out.orderBy("host", "database", F.desc("file"))


def count_by_host(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("host").agg(F.count("*").alias("backups"))


def latest_by_mtime(catalog: DataFrame) -> DataFrame:
    """Newest file per pair by modification time; among equal times the first name. Spark
    keeps one row per pair and task before the shuffle."""
    rank = F.row_number().over(
        W.partitionBy(*PAIR).orderBy(F.desc_nulls_last("mtime"), F.asc("file")))
    return (catalog.select(*PAIR, "file", "mtime").withColumn("_rank", rank)
            .filter(F.col("_rank") == 1).drop("_rank"))


def latest_by_name(catalog: DataFrame) -> DataFrame:
    """Highest file name per pair among accepted snapshot names."""
    return (catalog.filter(F.col("file").rlike(SNAPSHOT_NAME)).groupBy(*PAIR)
            .agg(F.max("file").alias("file")))


# Above this many rows per pair Spark does not limit ranks before a shuffle by itself.
RANK_LIMIT = 1000
SALTS = 64


def _newest(catalog: DataFrame, most: int, key: str) -> DataFrame:
    """The newest `most` rows of each pair with their `_rank`; equal times are ordered by `key`.

    A rank limit is applied before the shuffle, so only `most` rows per pair and task travel.
    For larger limits the same is done in two steps: the newest of each pair and salt, then
    the newest of those.
    """
    order = [F.desc_nulls_last("mtime"), F.asc(key)]
    rows = catalog.select(*PAIR, "mtime", key)

    def limited(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= most)

    if most > RANK_LIMIT:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        rows = limited(salted, *PAIR, "_salt").drop("_salt", "_rank")
    return limited(rows, *PAIR)


def _beyond_newest(catalog: DataFrame, keep: DataFrame | int, key: str) -> DataFrame:
    """Rows of each pair after its newest `keep` ones.

    The `keep`-th newest row of a pair is its threshold; all rows are compared with it in a
    salted join. So a pair that holds a third of the catalogue is never sorted in one task.
    """
    if isinstance(keep, int):
        if keep <= 0:
            return catalog
        nth = _newest(catalog, keep, key).filter(F.col("_rank") == keep)
    else:
        keep = keep.filter(F.col("keep").isNotNull()).select(*PAIR, "keep")
        most = keep.agg(F.max("keep")).first()[0] or 0
        nth = _newest(catalog, most, key).join(keep, [*PAIR]).filter(F.col("_rank") == F.col("keep"))
    nth = nth.select(*PAIR, F.col("mtime").alias("_mtime"), F.col(key).alias("_key"))
    older = (F.col("_mtime").isNotNull() & F.col("mtime").isNull()) | (F.col("mtime") < F.col("_mtime"))
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & (F.col(key) > F.col("_key"))
    marked = salted_join(catalog, nth, PAIR, [key]).filter(older | same).select(*catalog.columns)
    if isinstance(keep, int):
        return marked
    none = keep.filter(F.col("keep") <= 0).select(*PAIR)
    return marked.unionByName(catalog.join(none, [*PAIR], "left_semi").select(*catalog.columns))


def retention_keep(catalog: DataFrame, keep: int, key: str = "path") -> DataFrame:
    """Files beyond the newest `keep` of each pair."""
    return _beyond_newest(catalog, keep, key)


def retention_older_than(catalog: DataFrame, days: int, now: str, floor: int = 0,
                         key: str = "path") -> DataFrame:
    """Files whose age in whole days is above `days`, except the newest `floor` of each pair;
    a file of unknown age stays."""
    age = F.floor((epoch_seconds(_now(now)) - epoch_seconds("mtime")) / DAY)
    return _beyond_newest(catalog, floor, key).filter(F.col("mtime").isNotNull() & (age > days))


def retention_preview(catalog: DataFrame, now: str, keep: int | None = None,
                      older_than: int | None = None, key: str = "path") -> DataFrame:
    """Files either rule would delete, in host, database, time order."""
    if keep is None and older_than is None:
        raise ValueError("give keep, older_than or both")
    cutoff = _now(now) - F.make_dt_interval(F.lit(older_than or 0))
    old = catalog.filter(F.col("mtime") < cutoff) if older_than is not None else None
    marked = _beyond_newest(catalog, keep, key) if keep is not None else old
    if keep is not None and old is not None:
        # disjoint parts instead of a distinct over whole rows
        marked = old.unionByName(
            marked.filter(F.col("mtime").isNull() | (F.col("mtime") >= cutoff)))
    return marked.withColumn("timestamp", iso_z("mtime")).orderBy(*PAIR, "timestamp", key)


def retention_scheduled(catalog: DataFrame, schedules: DataFrame, key: str = "path") -> DataFrame:
    """Each pair's own `keep` from its schedule; pairs without one lose nothing. Of several
    schedules of a pair the highest `keep` counts, so no schedule loses what it asks for. A
    disabled schedule does not run and deletes nothing."""
    if "enabled" in schedules.columns:
        schedules = schedules.filter(F.coalesce("enabled", F.lit(True)))
    keep = schedules.groupBy(*PAIR).agg(F.max("keep").alias("keep"))
    return _beyond_newest(catalog, keep, key)


def reclaimable(marked: DataFrame, sidecars: DataFrame, key: str = "path") -> DataFrame:
    """Number of marked files and their bytes with sidecars (sidecars are not counted)."""
    return marked.join(sidecars.select(key, "sidecar_bytes"), key, "left").agg(
        F.count("*").alias("reclaim_count"),
        F.coalesce(F.sum(F.col("size") + F.coalesce("sidecar_bytes", F.lit(0))),
                   F.lit(0)).cast("bigint").alias("reclaim_bytes"))


def storage_usage(catalog: DataFrame) -> DataFrame:
    """Per pair: files, bytes, largest, oldest, newest; biggest pair first."""
    return (catalog.groupBy(*PAIR)
            .agg(F.count("*").alias("count"), F.sum("size").alias("bytes"),
                 F.max("size").alias("largest_bytes"),
                 F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
            .withColumn("oldest", iso_z("oldest")).withColumn("newest", iso_z("newest"))
            .orderBy(F.desc("bytes"), *PAIR))


def storage_totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("total_files"),
                       F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def incomplete_backups(catalog: DataFrame, sidecars: DataFrame, key: str = "path") -> DataFrame:
    """Files without a sidecar: runs that crashed."""
    return catalog.join(sidecars.select(key), key, "left_anti")


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """`push`, `pull`, `same` or `differs` per relative path; sidecars are left out."""

    def files(df: DataFrame, side: str) -> DataFrame:
        return df.filter(~F.col("path").endswith(".meta.json")).select(
            "path", F.col("size").alias(f"{side}_size"), F.lit(True).alias(side))

    both = files(local, "local").join(files(remote, "remote"), "path", "full")
    action = (F.when(F.col("remote").isNull(), "push").when(F.col("local").isNull(), "pull")
              .when(F.col("local_size") != F.col("remote_size"), "differs").otherwise("same"))
    return both.select("path", action.alias("action"), "local_size", "remote_size")


def host_safety(col: Column | str = "safety") -> Column:
    """`prod`, `stage` or `local`; anything else, or nothing, is `local`."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*SAFETY), c).otherwise("local")


def safety_filter(catalog: DataFrame, hosts: DataFrame, external_target: bool = False,
                  allow_prod: bool = False) -> DataFrame:
    """Label snapshots with their host's safety; refuse prod ones for an external target."""
    labels = hosts.select("host", host_safety("safety").alias("safety"))
    out = catalog.join(labels, "host", "left").withColumn(
        "safety", F.coalesce("safety", F.lit("local")))
    refused = (F.col("safety") == "prod") if external_target and not allow_prod else F.lit(False)
    return out.withColumn("refused", refused)


def engine_key(col: Column | str) -> Column:
    """`pg`, `mysql` or NULL from the four configured spellings."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.when(c.isin("postgres", "postgresql"), "pg").when(c.isin("mysql", "mariadb"), "mysql")


def pg_major(number: Column | str) -> Column:
    """Major version from a server version number: 150004 gives 15; no number gives unknown."""
    c = F.col(number) if isinstance(number, str) else number
    value = F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    return F.coalesce(F.floor(value / 10000).cast("string"), F.lit("unknown"))


def mysql_version(text: Column | str) -> Column:
    """`(flavor, major, minor)` from a version text; `unknown, 0, 0` without a leading `X.Y`."""
    c = F.col(text) if isinstance(text, str) else text
    shape = r"^([0-9]+)\.([0-9]+)"
    ok = F.coalesce(c.rlike(shape), F.lit(False))
    flavor = F.when(~ok, "unknown").when(c.contains("MariaDB"), "mariadb").otherwise("mysql")
    return F.struct(flavor.alias("flavor"),
                    F.when(ok, F.regexp_extract(c, shape, 1)).otherwise("0").alias("major"),
                    F.when(ok, F.regexp_extract(c, shape, 2)).otherwise("0").alias("minor"))


def engine_inventory(sidecars: DataFrame) -> DataFrame:
    """Snapshots per engine, flavor, major version and extension.

    Sidecar rows: `type, version, extensions`. A snapshot counts once for each extension it
    carries, or once with an empty extension.
    """
    engine = F.coalesce(engine_key("type"), F.lit("unknown"))
    my = mysql_version("version")
    flavor = F.when(engine == "pg", "postgres").when(engine == "mysql", my["flavor"]) \
        .otherwise("unknown")
    major = F.when(engine == "pg", pg_major("version")).when(engine == "mysql", my["major"]) \
        .otherwise("unknown")
    return (sidecars.select(engine.alias("engine"), flavor.alias("flavor"), major.alias("major"),
                            F.explode_outer(F.array_distinct("extensions")).alias("extension"))
            .withColumn("extension", F.coalesce("extension", F.lit("")))
            .groupBy("engine", "flavor", "major", "extension")
            .agg(F.count("*").alias("snapshots")))


def restore_target_name(base: str, day: str, existing: set[str]) -> str:
    """`<base>_v<N>_<YYYYMMDD>` with the smallest N that is free."""
    n = 1
    while f"{base}_v{n}_{day}" in existing:
        n += 1
    return f"{base}_v{n}_{day}"


def restore_diff(captured: DataFrame, target: DataFrame, target_name: str) -> DataFrame:
    """What a restore would change: `(table, column, change)` between the captured schema and
    the target's, both `(table, column, type)`. `target_action` tells whether the target is
    created or replaced, `target_tables` how many tables it has now."""
    new = captured.select("table", "column", F.col("type").alias("new_type"))
    old = target.select("table", "column", F.col("type").alias("old_type"))
    summary = target.agg(F.count_distinct("table").alias("target_tables"))
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "changed").otherwise("same"))
    rows = new.join(old, ["table", "column"], "full").select(
        "table", "column", "old_type", "new_type", change.alias("change"))
    head = summary.select(
        F.lit("").alias("table"), F.lit("").alias("column"),
        F.col("target_tables").cast("string").alias("old_type"),
        F.lit(target_name).alias("new_type"),
        F.when(F.col("target_tables") > 0, "target_replaced").otherwise("target_created")
        .alias("change"))
    return head.unionByName(rows)

