"""Queries over the snapshot catalogue, the audit log and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecloak.functions import scalars, schedules as sched
from tablecloak.operators import audit as a
from tablecloak.operators import catalog as c
from tablecloak.plans import views as v
from tablecloak.plans.registry import query

KEY = "backup_id"
_RANK = "row_number() OVER (PARTITION BY host, database ORDER BY mtime DESC, backup_id)"


@query("c1_list_backups", """SELECT host, database, file, size, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS date,
    CASE suffix WHEN '.age' THEN 'age' WHEN '.gpg' THEN 'gpg' ELSE 'none' END AS encryption, complete
    FROM backup_files""", "backup_files")
def c1(spark, sf):
    return c.list_backups(v.backup_files(spark, sf)).select(
        "host", "database", "file", "size", scalars.iso_z("mtime").alias("date"),
        scalars.encryption_of("file").alias("encryption"), "complete")


@query("c2_count_by_host", "SELECT host, count(*) AS backups FROM backup_files GROUP BY host", "backup_files")
def c2(spark, sf):
    return c.count_by_host(v.backup_files(spark, sf))


@query("c3_latest_by_mtime", """SELECT host, database, file, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS mtime FROM (
      SELECT *, row_number() OVER (PARTITION BY host, database ORDER BY mtime DESC, file) AS r FROM backup_files)
    WHERE r = 1""", "backup_files")
def c3(spark, sf):
    return c.latest_by_mtime(v.backup_files(spark, sf)).withColumn("mtime", scalars.iso_z("mtime"))


@query("c4_latest_by_name", "SELECT host, database, max(file) AS file FROM backup_files GROUP BY 1, 2",
       "backup_files")
def c4(spark, sf):
    return c.latest_by_name(v.backup_files(spark, sf))


@query("c5_retention_keep", f"""SELECT backup_id, host, database, file FROM (SELECT *, {_RANK} AS r FROM backup_files)
    WHERE r > 3""", "backup_files")
def c5(spark, sf):
    return c.retention_keep(v.backup_files(spark, sf), 3, KEY).select(KEY, "host", "database", "file")


@query("c6_retention_older_than", f"""SELECT backup_id, host, database, file FROM (SELECT *, {_RANK} AS r FROM backup_files)
    WHERE r > 2 AND floor(date_diff('second', mtime, TIMESTAMP '{v.NOW_FILES}') / 86400) > 365""", "backup_files")
def c6(spark, sf):
    marked = c.retention_older_than(v.backup_files(spark, sf), 365, v.NOW_FILES, floor=2, key=KEY)
    return marked.select(KEY, "host", "database", "file")


_PREVIEW = f"""(SELECT * FROM (SELECT *, {_RANK} AS r FROM backup_files)
    WHERE r > 4 OR mtime < TIMESTAMP '{v.NOW_FILES}' - INTERVAL 1000 DAY)"""


@query("c7_retention_preview", f"""SELECT backup_id, host, database, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
    FROM {_PREVIEW}""", "backup_files")
def c7(spark, sf):
    return c.retention_preview(v.backup_files(spark, sf), v.NOW_FILES, keep=4, older_than=1000,
                               key=KEY).select(KEY, "host", "database", "timestamp")


@query("c8_retention_scheduled", f"""SELECT backup_id, b.host, b.database, file FROM (SELECT *, {_RANK} AS r FROM backup_files) b
    JOIN (SELECT host, database, max(keep) AS keep FROM (SELECT * FROM schedules UNION ALL SELECT host, database, "when", true, 4
        FROM schedules WHERE host = 'h1') WHERE enabled GROUP BY 1, 2) s
      ON b.host = s.host AND b.database = s.database WHERE r > s.keep""", "backup_files", "schedules")
def c8(spark, sf):
    """Some pairs have a second schedule, and some schedules are disabled."""
    plan = v.schedules(spark, sf)
    again = plan.filter("host = 'h1'").withColumns({"enabled": F.lit(True), "keep": F.lit(4)})
    marked = c.retention_scheduled(v.backup_files(spark, sf), plan.unionByName(again), KEY)
    return marked.select(KEY, "host", "database", "file")


@query("c9_reclaimable", f"""SELECT count(*) AS reclaim_count,
      sum(p.size + coalesce(s.sidecar_bytes, 0))::BIGINT AS reclaim_bytes
    FROM {_PREVIEW} p LEFT JOIN sidecars s ON p.backup_id = s.backup_id""", "backup_files", "sidecars")
def c9(spark, sf):
    marked = c.retention_preview(v.backup_files(spark, sf), v.NOW_FILES, keep=4, older_than=1000, key=KEY)
    return c.reclaimable(marked.drop("sidecar_bytes"), v.sidecars(spark, sf), KEY)


@query("c10_storage_usage", """SELECT host, database, count(*) AS count, sum(size)::BIGINT AS bytes,
      max(size) AS largest_bytes, strftime(min(mtime), '%Y-%m-%dT%H:%M:%SZ') AS oldest,
      strftime(max(mtime), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM backup_files GROUP BY 1, 2""", "backup_files")
def c10(spark, sf):
    return c.storage_usage(v.backup_files(spark, sf))


@query("c10_storage_totals", "SELECT count(*) AS total_files, sum(size)::BIGINT AS total_bytes FROM backup_files",
       "backup_files")
def c10_totals(spark, sf):
    return c.storage_totals(v.backup_files(spark, sf))


@query("c11_incomplete_backups", "SELECT backup_id, host, database, file FROM backup_files WHERE NOT complete",
       "backup_files")
def c11(spark, sf):
    return c.incomplete_backups(v.backup_files(spark, sf), v.sidecars(spark, sf), KEY).select(
        KEY, "host", "database", "file")


@query("c12_sync_plan", """SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'push'
      WHEN l.path IS NULL THEN 'pull' WHEN l.size <> r.size THEN 'differs' ELSE 'same' END AS action,
      l.size AS local_size, r.size AS remote_size
    FROM backup_files l FULL JOIN remote_files r ON l.path = r.path""", "backup_files", "remote_files")
def c12(spark, sf):
    return c.sync_plan(v.backup_files(spark, sf), v.remote_files(spark, sf))


@query("c13_safety_filter", """SELECT backup_id, b.host, CASE WHEN h.safety IN ('prod', 'stage', 'local') THEN h.safety
      ELSE 'local' END AS safety, coalesce(h.safety = 'prod', false) AS refused
    FROM backup_files b LEFT JOIN hosts h ON b.host = h.host""", "backup_files", "hosts")
def c13(spark, sf):
    labelled = c.safety_filter(v.backup_files(spark, sf), v.hosts(spark, sf), external_target=True)
    return labelled.select(KEY, "host", "safety", "refused")


@query("c14_engine_inventory", r"""SELECT engine, flavor, major, extension, count(*) AS snapshots FROM (
      SELECT engine, CASE engine WHEN 'pg' THEN 'postgres' WHEN 'mysql' THEN
          CASE WHEN NOT regexp_matches(version, '^[0-9]+\.[0-9]+') THEN 'unknown'
            WHEN contains(version, 'MariaDB') THEN 'mariadb' ELSE 'mysql' END ELSE 'unknown' END AS flavor,
        CASE engine WHEN 'pg' THEN CASE WHEN regexp_matches(version, '^[0-9]+$')
            THEN (try_cast(version AS BIGINT) // 10000)::VARCHAR ELSE 'unknown' END
          WHEN 'mysql' THEN CASE WHEN regexp_matches(version, '^[0-9]+\.[0-9]+')
            THEN regexp_extract(version, '^([0-9]+)\.', 1) ELSE '0' END ELSE 'unknown' END AS major,
        unnest(CASE WHEN len(extensions) = 0 THEN [''] ELSE extensions END) AS extension
      FROM (SELECT *, CASE WHEN lower(type) IN ('postgres', 'postgresql') THEN 'pg'
        WHEN lower(type) IN ('mysql', 'mariadb') THEN 'mysql' ELSE 'unknown' END AS engine FROM engine_sidecars))
    GROUP BY 1, 2, 3, 4""", "engine_sidecars")
def c14(spark, sf):
    return c.engine_inventory(v.engine_sidecars(spark, sf))


_A1 = """action = 'backup' AND outcome = 'failure' AND timestamp >= '2024-01-05T00:00:00Z'
    AND timestamp <= '2024-01-25T23:59:59Z' AND db_host = 'h3'"""
_FILTERS = {"action": "backup", "outcome": "failure", "from_ts": "2024-01-05", "to_ts": "2024-01-25",
            "regex": '"db_host": "h3"'}


@query("a1_audit_search", f"SELECT seq, timestamp, action, outcome, db_host, database, error FROM audit "
       f"WHERE {_A1} ORDER BY seq DESC LIMIT 100", "audit")
def a1(spark, sf):
    return a.audit_search(v.audit(spark, sf), limit=100, **_FILTERS).select(
        "seq", "timestamp", "action", "outcome", "db_host", "database", "error")


@query("a1_entry_text", """SELECT seq, '{' || concat_ws(', ', '"account": "' || account || '"', '"action": "' || action || '"',
      '"database": "' || database || '"', '"db_host": "' || db_host || '"', '"duration_sec": "' || duration_sec || '"',
      '"error": "' || error || '"', '"file": "' || file || '"', '"host": "' || host || '"',
      '"into_container": "' || into_container || '"', '"outcome": "' || outcome || '"', '"size": "' || size || '"',
      '"target": "' || target || '"', '"target_db": "' || target_db || '"', '"timestamp": "' || timestamp || '"')
      || '}' AS text FROM audit""", "audit")
def a1_text(spark, sf):
    log = v.audit(spark, sf)
    return log.select("seq", a.entry_text(log).alias("text"))


@query("a2_audit_counts", f"SELECT count(*) AS total, count(*) FILTER (WHERE {_A1}) AS filtered FROM audit",
       "audit")
def a2(spark, sf):
    return a.audit_counts(v.audit(spark, sf), **_FILTERS)


def _baseline(field: str, keys: str, action: str, tail: bool, where: str) -> str:
    bound = "AND seq > (SELECT max(seq) FROM audit) - 500" if tail else ""
    value = f"CASE WHEN regexp_matches({field}, '^[0-9]+$') THEN {field}::BIGINT END"
    pick = f"arg_max(struct_pack(v := {value}), seq).v"
    group = f"GROUP BY {keys}" if keys else "HAVING count(*) > 0"
    return (f"SELECT {keys + ',' if keys else ''} {pick} AS {field} FROM audit WHERE action = '{action}' "
            f"AND outcome = 'success' {bound} AND {where} {group}")


_WHOLE = "regexp_matches(duration_sec, '^[0-9]+$')"


@query("a3_last_duration", _baseline("duration_sec", "db_host, database", "backup", False, _WHOLE), "audit")
def a3(spark, sf):
    return a.last_duration(v.audit(spark, sf), "backup")


@query("a3_last_duration_tail", _baseline("duration_sec", "db_host, database", "backup", True, _WHOLE), "audit")
def a3_tail(spark, sf):
    return a.last_duration(v.audit(spark, sf), "backup", tail_rows=500)


@query("a3_last_duration_restore", _baseline("duration_sec", "", "restore", False, _WHOLE), "audit")
def a3_restore(spark, sf):
    return a.last_duration(v.audit(spark, sf), "restore")


@query("a4_last_size", _baseline("size", "db_host, database", "backup", False, "size IS NOT NULL"), "audit")
def a4(spark, sf):
    return a.last_size(v.audit(spark, sf), "backup")


_RUNS = "(SELECT *, row_number() OVER (PARTITION BY db_host, database{0} ORDER BY timestamp DESC, seq) AS r " \
        "FROM audit WHERE action = 'backup')"


@query("a5_last_outcomes", f"""SELECT p.db_host, p.database, s.timestamp AS success_at, s.size AS success_size,
      s.file AS success_file, f.timestamp AS failure_at, CASE WHEN f.timestamp IS NOT NULL THEN coalesce(f.error, '') END AS failure_error
    FROM (SELECT DISTINCT db_host, database FROM audit WHERE action = 'backup') p
    LEFT JOIN {_RUNS.format(", outcome")} s ON p.db_host = s.db_host AND p.database = s.database AND s.r = 1 AND s.outcome = 'success'
    LEFT JOIN {_RUNS.format(", outcome")} f ON p.db_host = f.db_host AND p.database = f.database AND f.r = 1 AND f.outcome = 'failure'
    """, "audit")
def a5(spark, sf):
    return a.last_outcomes(v.audit(spark, sf)).select(
        "db_host", "database", scalars.iso_z("success_ts").alias("success_at"), "success_size",
        "success_file", scalars.iso_z("failure_ts").alias("failure_at"), "failure_error")


@query("a6_last_run", f"""SELECT db_host, database, timestamp AS last_run_at, outcome AS last_outcome
    FROM {_RUNS.format("")} WHERE r = 1""", "audit")
def a6(spark, sf):
    return a.last_run(v.audit(spark, sf))


@query("a7_secret_last_set", """SELECT account, max(timestamp) AS last_set FROM audit
    WHERE action = 'vault_set' AND outcome = 'success' GROUP BY account""", "audit")
def a7(spark, sf):
    return a.secret_last_set(v.audit(spark, sf))


@query("a8_weekly_trend", f"""SELECT b AS bucket, strftime(TIMESTAMP '{v.NOW_AUDIT}' - to_days((7 * (7 - b))::INTEGER), '%b %d') AS label,
      count(seq) AS backups, coalesce(sum(try_cast(size AS BIGINT)), 0)::BIGINT AS bytes
    FROM (SELECT unnest(range(0, 8)) AS b) LEFT JOIN (SELECT *, 7 - floor(date_diff('second', timestamp::TIMESTAMP,
      TIMESTAMP '{v.NOW_AUDIT}') / 604800)::BIGINT AS bucket FROM (SELECT seq, size, replace(timestamp, 'Z', '') AS timestamp
        FROM audit WHERE action = 'backup' AND outcome = 'success')) ON b = bucket
    GROUP BY b""", "audit")
def a8(spark, sf):
    return a.weekly_trend(v.audit(spark, sf), v.NOW_AUDIT)


_NOW = f"TIMESTAMP '{v.NOW_AUDIT}'"


def _next_sql(when: str, now: str) -> str:
    daily = f"CASE WHEN {when} = 'daily' THEN 2 ELSE try_cast(substr({when}, 7) AS INTEGER) END"
    day = f"CASE WHEN {when} = 'weekly' THEN 0 ELSE try_cast(split_part(substr({when}, 8), ':', 1) AS INTEGER) END"
    hour = f"CASE WHEN {when} = 'weekly' THEN 2 ELSE try_cast(split_part(substr({when}, 8), ':', 2) AS INTEGER) END"
    at = f"(date_trunc('day', {now}) + to_hours({daily}))"
    ahead = f"(({day}) - dayofweek({now}) + 7) % 7"
    wat = f"(date_trunc('day', {now}) + to_days(({ahead})::INTEGER) + to_hours({hour}))"
    nxt = f"""CASE WHEN {when} IS NULL THEN NULL
      WHEN {when} = 'hourly' THEN date_trunc('hour', {now}) + INTERVAL 1 HOUR
      WHEN {when} LIKE 'daily%' THEN CASE WHEN ({daily}) BETWEEN 0 AND 23 THEN
        CASE WHEN {at} <= {now} THEN {at} + INTERVAL 1 DAY ELSE {at} END END
      WHEN {when} LIKE 'weekly%' THEN CASE WHEN ({day}) BETWEEN 0 AND 6 AND ({hour}) BETWEEN 0 AND 23 THEN
        CASE WHEN {wat} <= {now} THEN {wat} + INTERVAL 7 DAY ELSE {wat} END END
      ELSE date_trunc('day', {now}) + INTERVAL 1 DAY END"""
    return f"strftime({nxt}, '%Y-%m-%dT%H:%M:%SZ')"


_CARDS = f"""(SELECT n.host, n.database, strftime(coalesce(s.ts, n.mtime), '%Y-%m-%dT%H:%M:%SZ') AS last_success,
      greatest(0, date_diff('second', coalesce(s.ts, n.mtime), {_NOW})) AS age_seconds,
      CASE WHEN s.ts IS NOT NULL THEN try_cast(s.size AS BIGINT) ELSE n.size END AS last_size,
      coalesce(s.file, n.file) AS last_file,
      CASE WHEN date_diff('second', coalesce(s.ts, n.mtime), {_NOW}) < 86400 THEN 'fresh'
        WHEN date_diff('second', coalesce(s.ts, n.mtime), {_NOW}) < 604800 THEN 'aging' ELSE 'stale' END AS status,
      f.timestamp AS last_failure, CASE WHEN f.timestamp IS NOT NULL THEN coalesce(f.error, '') END AS failure_error,
      p."when", {_next_sql('p."when"', _NOW)} AS next_at, files, bytes
    FROM (SELECT host, database, max(mtime) AS mtime, arg_max(size, (mtime, size, file)) AS size,
        arg_max(file, (mtime, size, file)) AS file, count(*) AS files, sum(size)::BIGINT AS bytes
      FROM backup_files GROUP BY 1, 2) n
    LEFT JOIN (SELECT *, replace(timestamp, 'Z', '')::TIMESTAMP AS ts FROM {_RUNS.format(", outcome")}
      WHERE r = 1 AND outcome = 'success') s ON n.host = s.db_host AND n.database = s.database
    LEFT JOIN (SELECT * FROM {_RUNS.format(", outcome")} WHERE r = 1 AND outcome = 'failure') f
      ON n.host = f.db_host AND n.database = f.database
    LEFT JOIN schedules p ON n.host = p.host AND n.database = p.database)"""


def cards(spark, sf):
    return a.freshness_cards(v.backup_files(spark, sf), v.audit(spark, sf), v.schedules(spark, sf),
                             v.NOW_AUDIT)


query("a9_freshness_cards", f"SELECT * FROM {_CARDS}", "backup_files", "audit", "schedules")(cards)


@query("a10_freshness_summary", f"""SELECT sum(files)::BIGINT AS total_backups, sum(bytes)::BIGINT AS total_bytes,
      count(DISTINCT host) AS hosts, count(*) AS databases, count(*) FILTER (WHERE status = 'fresh') AS fresh,
      count(*) FILTER (WHERE status = 'aging') AS aging, count(*) FILTER (WHERE status = 'stale') AS stale
    FROM {_CARDS}""", "backup_files", "audit", "schedules")
def a10(spark, sf):
    return a.freshness_summary(cards(spark, sf))


@query("a11_bypass_report", """SELECT host, coalesce(target, into_container) AS target, count(*) AS bypasses, max(timestamp) AS last_bypass
    FROM audit WHERE action = 'scrub_bypass' GROUP BY 1, 2""", "audit")
def a11(spark, sf):
    return a.bypass_report(v.audit(spark, sf))


@query("n1_parse_schedule", """SELECT host, database, "when", CASE WHEN "when" = 'hourly' THEN '0 * * * *'
      WHEN "when" = 'daily' THEN '0 2 * * *' WHEN "when" LIKE 'daily@%' THEN '0 ' || substr("when", 7) || ' * * *'
      WHEN "when" LIKE 'weekly@%' THEN '0 ' || split_part(substr("when", 8), ':', 2) || ' * * ' || split_part(substr("when", 8), ':', 1)
      ELSE "when" END AS cron FROM schedules""", "schedules")
def n1(spark, sf):
    return v.schedules(spark, sf).select("host", "database", "when",
                                         sched.parse_schedule("when").alias("cron"))


@query("n2_next_fire", f"""SELECT host, database, "when", {_next_sql('"when"', "TIMESTAMP '2024-01-31 09:30:15'")} AS next_at
    FROM schedules""", "schedules")
def n2(spark, sf):
    now = F.lit("2024-01-31 09:30:15").cast("timestamp_ntz")
    return v.schedules(spark, sf).select("host", "database", "when",
                                         scalars.iso_z(sched.next_fire("when", now)).alias("next_at"))


@query("n3_schedule_sync_plan", """SELECT CASE WHEN i.host IS NULL THEN 'install' WHEN s.host IS NULL THEN 'orphan'
      WHEN s."when" <> i."when" THEN 'update' ELSE 'nochange' END AS action, coalesce(s.host, i.host) AS host,
      coalesce(s.database, i.database) AS database, coalesce(s."when", i."when") AS "when"
    FROM (SELECT * FROM schedules WHERE enabled) s FULL JOIN installed i ON s.host = i.host AND s.database = i.database""",
       "schedules", "installed")
def n3(spark, sf):
    return a.schedule_sync_plan(v.schedules(spark, sf), v.installed(spark, sf))


@query("n4_schedule_upsert", """SELECT coalesce(s.host, i.host) AS host, coalesce(s.database, i.database) AS database,
      coalesce(i."when", s."when") AS "when", enabled, keep
    FROM schedules s FULL JOIN installed i ON s.host = i.host AND s.database = i.database""", "schedules", "installed")
def n4(spark, sf):
    return a.schedule_upsert(v.schedules(spark, sf), v.installed(spark, sf))


@query("n4_schedule_delete", """SELECT host, database, "when", enabled, keep FROM schedules s WHERE NOT EXISTS (
    SELECT 1 FROM installed i WHERE s.host = i.host AND s.database = i.database)""", "schedules", "installed")
def n4_delete(spark, sf):
    return a.schedule_delete(v.schedules(spark, sf), v.installed(spark, sf))


_SIZE = """CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN (n // 1024) || 'KB'
    WHEN n < 1073741824 THEN (n // 1048576) || 'MB' ELSE (n // 1073741824) || 'GB' END"""

NOTIFY_SQL = f"""SELECT seq, action || CASE outcome WHEN 'success' THEN ' ok: ' ELSE ' FAILED: ' END
        || CASE action WHEN 'backup' THEN database ELSE target_db END AS title,
      CASE WHEN action = 'backup' AND outcome = 'success' THEN database || '@' || db_host || ' is stored, ' || {_SIZE}
        WHEN action = 'backup' THEN database || '@' || db_host || ' is not stored. ' || coalesce(error, 'no reason given')
        ELSE target_db || ' is loaded from ' || file END AS message
    FROM (SELECT *, coalesce(try_cast(size AS BIGINT), 0) AS n FROM audit) WHERE action IN ('backup', 'restore')"""


@query("n5_notify_filter", f"SELECT * FROM ({NOTIFY_SQL})", "audit")
def n5(spark, sf):
    return a.notify_filter(v.audit(spark, sf), "all").select("seq", "title", "message")


@query("n5_notify_failures", NOTIFY_SQL + " AND outcome = 'failure'", "audit")
def n5_failures(spark, sf):
    return a.notify_filter(v.audit(spark, sf)).select("seq", "title", "message")


def _duration_sql(n: str) -> str:
    return f"""CASE WHEN {n} < 60 THEN {n} || 's' WHEN {n} < 3600 THEN ({n} // 60) || 'm ' || ({n} % 60) || 's'
      ELSE ({n} // 3600) || 'h ' || ({n} % 3600 // 60) || 'm ' || ({n} % 60) || 's' END"""


@query("f1_format_duration", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '0s' ELSE {_duration_sql("o_orderkey")} END AS text
    FROM orders""")
def f1(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderkey").cast("string"))
    return v.table(spark, sf, "orders").select("o_orderkey", scalars.format_duration(text).alias("text"))


@query("f2_human_size", f"SELECT o_orderkey, {_SIZE} AS text FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS n FROM orders)")
def f2(spark, sf):
    size = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return v.table(spark, sf, "orders").select("o_orderkey", scalars.human_size(size).alias("text"))


@query("f3_parse_backup_timestamp", """SELECT backup_id, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS parsed FROM backup_files
    UNION ALL SELECT -1 - backup_id, '' FROM backup_files""", "backup_files")
def f3(spark, sf):
    files = v.backup_files(spark, sf)
    plain = files.select((F.lit(-1) - F.col("backup_id")).alias("backup_id"), F.col("database").alias("file"))
    return files.select("backup_id", "file").unionByName(plain).select(
        "backup_id", scalars.parse_backup_timestamp("file").alias("parsed"))


@query("f7_coerce_int", "SELECT seq, try_cast(size AS BIGINT) AS size FROM audit", "audit")
def f7(spark, sf):
    return v.audit(spark, sf).select("seq", scalars.coerce_int("size").alias("size"))


@query("f8_parse_iso_utc", """SELECT seq, CASE WHEN outcome = 'failure' THEN NULL WHEN action = 'restore'
      THEN strftime(replace(timestamp, 'Z', '')::TIMESTAMP - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE timestamp END AS parsed
    FROM audit""", "audit")
def f8(spark, sf):
    text = (F.when(F.col("outcome") == "failure", "not a time")
            .when(F.col("action") == "restore", F.replace("timestamp", F.lit("Z"), F.lit("+02:00")))
            .when(F.col("action") == "backup", F.replace("timestamp", F.lit("Z"), F.lit("")))
            .otherwise(F.col("timestamp")))
    return v.audit(spark, sf).select("seq", scalars.iso_z(scalars.parse_iso_utc(text)).alias("parsed"))


@query("f9_encryption_of", """SELECT backup_id, CASE suffix WHEN '.age' THEN 'age' WHEN '.gpg' THEN 'gpg' ELSE 'none' END AS encryption
    FROM backup_files""", "backup_files")
def f9(spark, sf):
    return v.backup_files(spark, sf).select(KEY, scalars.encryption_of("file").alias("encryption"))


@query("f10_valid_names", r"""SELECT "table", "column", regexp_matches("column", '^[A-Za-z_][A-Za-z0-9_]*$') AS ident,
      regexp_matches('$.' || "column", '^\$(\.[A-Za-z_][A-Za-z0-9_]*)+$') AS json_path,
      regexp_matches("column", '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') AS alias FROM fleet_catalog""", "fleet_catalog")
def f10(spark, sf):
    return v.fleet_catalog(spark, sf).select(
        "table", "column", scalars.valid_ident("column").alias("ident"),
        scalars.valid_json_path(F.concat(F.lit("$."), F.col("column"))).alias("json_path"),
        scalars.valid_alias("column").alias("alias"))


@query("f11_parse_name_list", """SELECT p_partkey, 3::INTEGER AS n, 'zonemap|nightly|' || replace(p_name, ' ', '_') AS names FROM part""")
def f11(spark, sf):
    text = F.concat(F.lit(", zonemap,nightly  ,, "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "))
    names = scalars.parse_name_list(text)
    return v.table(spark, sf, "part").select("p_partkey", F.size(names).alias("n"),
                                             F.array_join(names, "|").alias("names"))
