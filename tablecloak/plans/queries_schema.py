"""Queries for discovery, manifests, drift, foreign keys and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecloak.operators import discover, drift, integrity, manifest, masking, stats
from tablecloak.plans import gate
from tablecloak.plans import views as v
from tablecloak.plans.oracle_views import S
from tablecloak.plans.registry import query
from tablecloak.session import local_rows, union_all
from tablecloak.sources import readers
from tablecloak.sources.digests import content_checksum

DICT = discover.DEFAULT_DICTIONARY
_NORMAL = """translate(lower("column"), '_-', '')"""


def _dict_values(entries) -> str:
    rows = []
    for i, e in enumerate(entries):
        pattern, strategy, *rest = e.split(":")
        param = f"'{rest[0]}'" if rest else "NULL"
        rows.append(f"({i}, '{pattern}', '{strategy}', {param})")
    return "(VALUES " + ", ".join(rows) + ") d(ord, pattern, strategy, param)"


def _first_match(source: str) -> str:
    """Rows of `source` with their first dictionary entry; the names are matched once each."""
    return f"""(SELECT s.*, m.pattern, m.strategy, m.param FROM {source} s LEFT JOIN (
      SELECT "column" AS c, arg_min(d.pattern, d.ord) AS pattern, arg_min(d.strategy, d.ord) AS strategy,
        arg_min(coalesce(d.param, ''), d.ord) AS param
      FROM (SELECT DISTINCT "column" FROM {source}) n, {_dict_values(DICT)}
      WHERE contains(translate(lower("column"), '_-', ''), d.pattern) GROUP BY 1) m ON s."column" = m.c)"""


_SUGGEST = """CASE WHEN strategy IS NULL THEN NULL WHEN param <> '' THEN '{"strategy":"' || strategy
    || '","max_days":' || param || '}' ELSE '{"strategy":"' || strategy || '"}' END"""


@query("d1_normalize_name", f"""SELECT database, "table", "column", {_NORMAL} AS normal FROM fleet_catalog""",
       "fleet_catalog")
def d1(spark, sf):
    return v.fleet_catalog(spark, sf).select(
        "database", "table", "column", discover.normalize_name("column").alias("normal"))


@query("d2_effective_dictionary", f"""SELECT host, ord, pattern, strategy, param FROM (
      SELECT host, excludes, d.ord::INTEGER AS ord, d.pattern, d.strategy, d.param::VARCHAR AS param
        FROM hosts, {_dict_values(DICT)}
      UNION ALL SELECT host, excludes, {len(DICT)}, 'loyalty', 'redact', NULL FROM hosts WHERE extends
      UNION ALL SELECT host, excludes, {len(DICT) + 1}, 'nickname', 'redact', NULL FROM hosts WHERE extends)
    WHERE NOT (coalesce(excludes, false) AND pattern IN ('address', 'addr', 'pan'))""", "hosts")
def d2(spark, sf):
    return discover.fleet_dictionary(v.hosts(spark, sf))


@query("d3_match_columns", f"""SELECT database, "table", "column", pattern
    FROM {_first_match("fleet_catalog")}""", "fleet_catalog")
def d3(spark, sf):
    return discover.match_columns(v.fleet_catalog(spark, sf, dealt=True)).select(
        "database", "table", "column", "pattern")


@query("d3_match_columns_by_host", f"""SELECT host, "table", "column", arg_min(pattern, ord) AS pattern FROM (
      SELECT h.host, s."table", s."column", d.ord, d.pattern FROM fleet_catalog s
        JOIN hosts h ON h.host = replace(s.database, 'db', 'h'),
        {_dict_values(DICT + ["loyalty:redact", "nickname:redact"])}
      WHERE contains(translate(lower("column"), '_-', ''), d.pattern)
        AND (d.ord < {len(DICT)} OR h.extends)
        AND NOT (h.excludes AND d.pattern IN ('address', 'addr', 'pan')))
    GROUP BY host, "table", "column" """, "hosts", "fleet_catalog")
def d3_by_host(spark, sf):
    columns = v.fleet_catalog(spark, sf, dealt=True).withColumn(
        "host", F.replace("database", F.lit("db"), F.lit("h")))
    matched = discover.match_columns_by_host(columns, discover.fleet_dictionary(v.hosts(spark, sf)))
    return matched.filter(F.col("pattern").isNotNull()).select("host", "table", "column", "pattern")


@query("d3_long_dictionary", """SELECT 'K' || o_orderkey || '-Ref' AS "column", arg_min(pattern, ord) AS pattern
    FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN (SELECT 'k' || c_custkey AS pattern, c_custkey * 7919 % 100003 AS ord FROM customer)
      ON starts_with('k' || o_orderkey, pattern) GROUP BY o_orderkey""")
def d3_long(spark, sf):
    """A dictionary as long as the table of customers, against as many names as there are orders."""
    entries = v.table(spark, sf, "customer").select(
        F.expr("c_custkey * 7919 % 100003").alias("ord"), F.concat(F.lit("k"), F.col("c_custkey")).alias("pattern"),
        F.lit("redact").alias("strategy"), F.lit(None).cast("string").alias("param"))
    names = v.table(spark, sf, "orders").select("o_orderkey").distinct().select(
        F.concat(F.lit("K"), F.col("o_orderkey"), F.lit("-Ref")).alias("column"))
    first = discover.add_match_indexed(names, "column", entries).filter("pattern IS NOT NULL")
    return first.select("column", "pattern")


@query("d4_suggest_strategy", f"""SELECT database, "table", "column", {_SUGGEST} AS suggested
    FROM {_first_match("fleet_catalog")} WHERE pattern IS NOT NULL""", "fleet_catalog")
def d4(spark, sf):
    matched = discover.match_columns(v.fleet_catalog(spark, sf, dealt=True)).filter("pattern IS NOT NULL")
    return discover.suggest_strategy(matched).select("database", "table", "column", "suggested")


@query("d5_pii_summary", f"""SELECT database, "table", string_agg("column", ',' ORDER BY "column") AS columns
    FROM {_first_match("fleet_catalog")} WHERE pattern IS NOT NULL GROUP BY 1, 2""", "fleet_catalog")
def d5(spark, sf):
    return discover.pii_summary(v.fleet_catalog(spark, sf, dealt=True))


_DRIFT = f"""(SELECT database, "table", "column", kind,
      CASE WHEN kind IN ('new_column', 'new_table') THEN type END AS type,
      CASE WHEN kind IN ('new_column', 'new_table', 'no_pii_warning') THEN pattern END AS pattern,
      CASE WHEN kind IN ('new_column', 'new_table') THEN {_SUGGEST} END AS suggested
    FROM (SELECT c.database, c."table", c."column", c.type, c.pattern, c.strategy, c.param,
        CASE WHEN t.no_pii THEN CASE WHEN c.pattern IS NOT NULL THEN 'no_pii_warning' END
          WHEN m."column" IS NOT NULL THEN NULL
          WHEN c.type IN ('json', 'jsonb') THEN 'json_undeclared'
          WHEN c.pattern IS NULL THEN NULL
          WHEN t."table" IS NOT NULL THEN 'new_column' ELSE 'new_table' END AS kind
      FROM {_first_match("fleet_catalog")} c
      LEFT JOIN (SELECT database, "table", bool_or(no_pii) AS no_pii FROM fleet_manifest GROUP BY 1, 2) t
        ON c.database = t.database AND c."table" = t."table"
      LEFT JOIN fleet_manifest m ON c.database = m.database AND c."table" = m."table" AND c."column" = m."column"
      UNION ALL SELECT m.database, m."table", m."column", NULL, NULL, NULL, NULL, 'missing_declared'
      FROM fleet_manifest m LEFT JOIN fleet_catalog c
        ON c.database = m.database AND c."table" = m."table" AND c."column" = m."column"
      WHERE m."column" IS NOT NULL AND c."column" IS NULL)
    WHERE kind IS NOT NULL)"""


def fleet_drift(spark, sf):
    return drift.schema_drift(v.fleet_catalog(spark, sf), v.fleet_manifest(spark, sf))


query("d6_schema_drift", f"SELECT * FROM {_DRIFT}", "fleet_catalog", "fleet_manifest")(fleet_drift)


@query("d7_drift_ok", f"""SELECT 'all' AS scope, coalesce(bool_and(kind = 'no_pii_warning'), true) AS ok FROM {_DRIFT}
    UNION ALL SELECT 'warnings', coalesce(bool_and(kind = 'no_pii_warning'), true) FROM {_DRIFT}
    WHERE kind = 'no_pii_warning'""", "fleet_catalog", "fleet_manifest")
def d7(spark, sf):
    found = fleet_drift(spark, sf)
    only = found.filter(F.col("kind") == drift.WARNING)
    return drift.drift_ok(found).select(F.lit("all").alias("scope"), "ok").unionByName(
        drift.drift_ok(only).select(F.lit("warnings").alias("scope"), "ok"))


@query("d7_drift_ok_by_database", f"""SELECT c.database, coalesce(d.ok, true) AS ok
    FROM (SELECT DISTINCT database FROM fleet_catalog) c
    LEFT JOIN (SELECT database, bool_and(kind = 'no_pii_warning') AS ok FROM {_DRIFT} GROUP BY 1) d
      ON c.database = d.database""", "fleet_catalog", "fleet_manifest")
def d7_db(spark, sf):
    return drift.drift_ok_by_database(fleet_drift(spark, sf), v.fleet_catalog(spark, sf))


@query("d8_new_tables_grouped", f"""SELECT database, "table",
      string_agg("column" || ':' || type || ':' || pattern || ':' || suggested, ';' ORDER BY "column") AS matches
    FROM {_DRIFT} WHERE kind = 'new_table' GROUP BY 1, 2""", "fleet_catalog", "fleet_manifest")
def d8(spark, sf):
    grouped = drift.new_tables_grouped(fleet_drift(spark, sf))
    text = F.array_join(F.transform("matches", lambda m: F.concat_ws(
        ":", m["column"], m["type"], m["pattern"], m["suggested"])), ";")
    return grouped.withColumn("matches", text)


@query("d9_preflight_drift", """SELECT o_orderkey AS snapshot_id, 'h' || (o_custkey % 7) AS host,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'deferred' WHEN '2-HIGH' THEN 'clean' ELSE 'drift' END AS status
    FROM orders""")
def d9(spark, sf):
    snaps = v.captured(spark, sf)
    columns = readers.explode_captured_schema(snaps, ("snapshot_id", "host"))
    flagged = snaps.select("snapshot_id", "host", F.col("scrub_schema").isNotNull().alias("has_schema"))
    return drift.preflight_drift(flagged, columns, v.host_manifest(spark, sf))


@query("d10_draft_manifest", f"""SELECT database, "table", '{{"columns":{{' || string_agg('"' || "column" || '":' ||
      CASE WHEN type IN ('json', 'jsonb') THEN '{{"strategy":"jsonb_scrub_paths","paths":{{}},"_TODO":"declare paths (JSON column, no suggestion)"}}'
      ELSE {_SUGGEST} END, ',' ORDER BY "column") || '}}}}' AS entry
    FROM {_first_match("fleet_catalog")} WHERE pattern IS NOT NULL OR type IN ('json', 'jsonb')
    GROUP BY 1, 2""", "fleet_catalog")
def d10(spark, sf):
    return discover.draft_manifest(v.fleet_catalog(spark, sf, dealt=True))


_KNOWN = "['fake_email','fake_phone','fake_ip','fake_name','redact','truncate','shift_date','passthrough','jsonb_scrub_paths']"


@query("d11_validate_manifests", f"""WITH docs AS (SELECT manifest_id, json_valid(text) AS good,
        CASE WHEN json_valid(text) THEN text::JSON END AS m FROM manifest_texts),
      tabs AS (SELECT manifest_id, e.key AS t, e.value::JSON AS v FROM docs, json_each(m, '$.tables') e
        WHERE json_type(m, '$.tables') = 'OBJECT'),
      cols AS (SELECT manifest_id, t, e.key AS c, e.value::JSON AS v, json_extract_string(e.value, '$.strategy') AS s
        FROM tabs, json_each(v, '$.columns') e
        WHERE json_type(v, '$.columns') = 'OBJECT' AND coalesce(json_extract_string(v, '$.no_pii'), '') <> 'true'),
      paths AS (SELECT manifest_id, t, c, e.key AS p, trim(e.value::VARCHAR, '"') AS sub
        FROM cols, json_each(v, '$.paths') e WHERE s = 'jsonb_scrub_paths' AND json_type(v, '$.paths') = 'OBJECT')
    SELECT manifest_id, NULL::VARCHAR AS "table", NULL::VARCHAR AS "column", 'json_invalid' AS rule, NULL::VARCHAR AS detail
      FROM docs WHERE NOT good
    UNION ALL SELECT manifest_id, NULL, NULL, 'version_missing', NULL FROM docs
      WHERE good AND coalesce(json_extract_string(m, '$.version'), '') IN ('', 'false')
    UNION ALL SELECT manifest_id, NULL, NULL, 'version_unsupported', json_extract_string(m, '$.version') FROM docs
      WHERE json_extract_string(m, '$.version') NOT IN ('', 'false', '1')
    UNION ALL SELECT manifest_id, NULL, NULL, 'seed_env_empty', NULL FROM docs
      WHERE json_exists(m, '$.seed_env') AND coalesce(json_extract_string(m, '$.seed_env'), '') = ''
    UNION ALL SELECT manifest_id, NULL, NULL, 'seed_env_invalid', json_extract_string(m, '$.seed_env') FROM docs
      WHERE json_extract_string(m, '$.seed_env') <> ''
        AND NOT regexp_matches(json_extract_string(m, '$.seed_env'), '^[A-Z_][A-Z0-9_]*$')
    UNION ALL SELECT manifest_id, NULL, NULL, 'extend_not_array', NULL FROM docs
      WHERE json_type(m, '$.dictionary.extend') <> 'ARRAY'
    UNION ALL SELECT manifest_id, NULL, NULL, 'exclude_not_array', NULL FROM docs
      WHERE json_type(m, '$.dictionary.exclude') <> 'ARRAY'
    UNION ALL SELECT manifest_id, NULL, NULL, 'tables_missing', NULL FROM docs
      WHERE good AND coalesce(json_type(m, '$.tables'), 'NULL') = 'NULL'
    UNION ALL SELECT manifest_id, NULL, NULL, 'tables_not_object', lower(json_type(m, '$.tables')) FROM docs
      WHERE json_type(m, '$.tables') NOT IN ('NULL', 'OBJECT')
    UNION ALL SELECT manifest_id, t, NULL, 'no_pii_without_reason', NULL FROM tabs
      WHERE json_extract_string(v, '$.no_pii') = 'true' AND coalesce(json_extract_string(v, '$.reason'), '') = ''
    UNION ALL SELECT manifest_id, t, NULL, 'no_pii_with_columns', NULL FROM tabs
      WHERE json_extract_string(v, '$.no_pii') = 'true' AND json_exists(v, '$.columns')
    UNION ALL SELECT manifest_id, t, NULL, 'table_without_columns', NULL FROM tabs
      WHERE coalesce(json_extract_string(v, '$.no_pii'), '') <> 'true'
        AND coalesce(len(json_keys(v, '$.columns')), 0) = 0
    UNION ALL SELECT manifest_id, t, c, 'strategy_missing', NULL FROM cols WHERE coalesce(s, '') = ''
    UNION ALL SELECT manifest_id, t, c, 'strategy_unknown', s FROM cols WHERE s <> '' AND NOT list_contains({_KNOWN}, s)
    UNION ALL SELECT manifest_id, t, c, 'truncate_length', NULL FROM cols WHERE s = 'truncate'
      AND NOT regexp_matches(coalesce(json_extract_string(v, '$.length'), ''), '^0*[1-9][0-9]*$')
    UNION ALL SELECT manifest_id, t, c, 'shift_date_max_days', NULL FROM cols WHERE s = 'shift_date'
      AND NOT regexp_matches(coalesce(json_extract_string(v, '$.max_days'), ''), '^0*[1-9][0-9]*$')
    UNION ALL SELECT manifest_id, t, c, 'paths_not_object', NULL FROM cols
      WHERE s = 'jsonb_scrub_paths' AND coalesce(json_type(v, '$.paths'), 'NULL') <> 'OBJECT'
    UNION ALL SELECT manifest_id, t, c, 'paths_empty', NULL FROM cols
      WHERE s = 'jsonb_scrub_paths' AND json_type(v, '$.paths') = 'OBJECT' AND len(json_keys(v, '$.paths')) = 0
    UNION ALL SELECT manifest_id, t, c, 'passthrough_reason', NULL FROM cols
      WHERE s = 'passthrough' AND coalesce(json_extract_string(v, '$.reason'), '') = ''
    UNION ALL SELECT manifest_id, t, c, 'replacement_not_string', NULL FROM cols
      WHERE s = 'redact' AND json_exists(v, '$.replacement') AND json_type(v, '$.replacement') <> 'VARCHAR'
    UNION ALL SELECT manifest_id, t, c, 'path_invalid', p FROM paths
      WHERE NOT regexp_matches(p, '^\\$(\\.[A-Za-z_][A-Za-z0-9_]*)+$')
    UNION ALL SELECT manifest_id, t, c, 'path_strategy_unknown', p FROM paths WHERE NOT list_contains({_KNOWN}, sub)
    UNION ALL SELECT manifest_id, t, c, 'path_strategy_nested', p FROM paths WHERE sub = 'jsonb_scrub_paths'
    UNION ALL SELECT manifest_id, t, c, 'path_strategy_unsupported', p FROM paths WHERE sub IN ('truncate', 'shift_date')
    """, "manifest_texts")
def d11(spark, sf):
    return manifest.validate_manifests(v.manifest_texts(spark, sf))


@query("d12_deep_scan_json", """SELECT 'part' AS "table", 'doc' AS "column", path, category, count(*) AS count FROM (
      SELECT '$.owner.mail' AS path, 'email' AS category FROM part WHERE p_size >= 5
      UNION ALL SELECT '$.owner.keys[*].aws', 'aws_key' FROM part WHERE p_size >= 5
      UNION ALL SELECT '$.owner.keys[*].dsn', 'url_password' FROM part WHERE p_size > 40
      UNION ALL SELECT '$.tags[*]', 'email' FROM part WHERE p_size >= 5 AND p_type = 'PROMO')
    GROUP BY path, category""")
def d12(spark, sf):
    return discover.deep_scan_json(v.part_json(spark, sf), "part", ["doc"])


_NEST = "".join(f".l{i}" for i in range(1, 13))


@query("d12_deep_scan_json_deep", f"""SELECT 'part' AS "table", 'doc' AS "column", path, category, count(*) AS count FROM (
      SELECT '${_NEST}.mail' AS path, 'email' AS category FROM part
      UNION ALL SELECT '${_NEST}.keys[*][*]', 'aws_key' FROM part WHERE p_size > 10
      UNION ALL SELECT '${_NEST}.other', 'email' FROM part WHERE p_type = 'PROMO')
    GROUP BY path, category""")
def d12_deep(spark, sf):
    """Leaves below twelve levels of objects, and arrays in arrays."""
    return discover.deep_scan_json(v.part_json_deep(spark, sf), "part", ["doc"])


_CATEGORY_SQL = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "stripe_key": "sk_live_[0-9A-Za-z]{8,}",
    "aws_key": "AKIA[0-9A-Z]{16}", "slack_token": "xox[abprs]-[0-9A-Za-z-]{8,}",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "url_password": "://[^/:@ \t\r\n]+:[^/@ \t\r\n]+@",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def _scan_sql(name: str, table: str, column: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", '{column}' AS "column", '{cat}' AS category, count(*) AS count
        FROM {table} WHERE regexp_matches({column}, '{rx}') HAVING count(*) > 0"""
        for cat, rx in _CATEGORY_SQL.items())


@query("d13_deep_scan_text", " UNION ALL ".join([
    _scan_sql("documents", "documents", "text"), _scan_sql("pages", "pages", "html"),
    _scan_sql("conversations", "conversations", "text"), _scan_sql("settings", "settings_kv", "value")]),
    "settings_kv")
def d13(spark, sf):
    return (discover.deep_scan_text(v.table(spark, sf, "documents"), "documents", ["text"])
            .unionByName(discover.deep_scan_text(v.table(spark, sf, "pages"), "pages", ["html"]))
            .unionByName(discover.deep_scan_text(v.table(spark, sf, "conversations"), "conversations", ["text"]))
            .unionByName(discover.deep_scan_text(v.settings_kv(spark, sf), "settings", ["value"])))


@query("d14_kv_scan", f"""SELECT key, found_by, finding, count(*) AS count FROM (
      SELECT "column" AS key, 'name' AS found_by, pattern AS finding
        FROM {_first_match('(SELECT name AS "column", value FROM settings_kv)')} WHERE value <> '' AND pattern IS NOT NULL
      """ + " ".join(f"""UNION ALL SELECT name, 'value', '{cat}' FROM settings_kv
        WHERE value <> '' AND regexp_matches(value, '{rx}')""" for cat, rx in _CATEGORY_SQL.items())
       + ") GROUP BY 1, 2, 3", "settings_kv")
def d14(spark, sf):
    return discover.kv_scan(v.settings_kv(spark, sf), "name", "value")


@query("d15_framework_fingerprint", """SELECT database, framework FROM (
      SELECT DISTINCT database, 'alpha' AS framework FROM fleet_catalog c
        WHERE "table" = (SELECT 't' || min(p_partkey) FROM part)
      UNION ALL SELECT database, b FROM (SELECT database, p_brand AS b, count(DISTINCT "table") AS n
        FROM (SELECT DISTINCT 'db' || substr(p_brand, 7, 3) AS database, 't' || p_partkey AS "table", p_brand FROM part)
        GROUP BY 1, 2))""", "fleet_catalog")
def d15(spark, sf):
    """Signatures: every brand's own tables, and one table by itself."""
    part = v.table(spark, sf, "part")
    brands = part.select(F.col("p_brand").alias("framework"),
                         F.concat(F.lit("t"), "p_partkey").alias("table"))
    first = part.agg(F.min("p_partkey").alias("k")).select(
        F.lit("alpha").alias("framework"), F.concat(F.lit("t"), "k").alias("table"))
    return discover.framework_fingerprint(v.fleet_catalog(spark, sf), brands.unionByName(first))


@query("d16_manifest_status", """SELECT h.host, h.type, CASE WHEN safety IN ('prod', 'stage', 'local') THEN safety
      ELSE 'local' END AS safety, m.host IS NOT NULL AS manifest_exists, coalesce(required, false) AS scrub_required,
      coalesce(n, 0) AS database_count, lo AS first_database, hi AS last_database
    FROM hosts h LEFT JOIN manifests m ON h.host = m.host
    LEFT JOIN (SELECT host, count(DISTINCT database) AS n, min(database) AS lo, max(database) AS hi
      FROM backup_files GROUP BY 1) d ON h.host = d.host""", "hosts", "manifests", "backup_files")
def d16(spark, sf):
    return drift.manifest_status(v.hosts(spark, sf), v.manifests(spark, sf), v.backup_files(spark, sf))


@query("d16_host_databases", "SELECT DISTINCT host, database FROM backup_files", "backup_files")
def d16_names(spark, sf):
    return drift.host_databases(v.backup_files(spark, sf))


_CLOSURE = """WITH RECURSIVE closure AS (SELECT "table" FROM excluded_tables
    UNION SELECT e.child FROM fk_edges e JOIN closure c ON e.parent = c."table") """


@query("r1_fk_closure", _CLOSURE + 'SELECT "table" FROM closure', "fk_edges", "excluded_tables")
def r1(spark, sf):
    return integrity.fk_closure(v.fk_edges(spark, sf), v.excluded_tables(spark, sf))


@query("r2_fk_dangling", """SELECT child, parent FROM fk_edges WHERE parent IN (SELECT "table" FROM excluded_tables)
    AND child NOT IN (SELECT "table" FROM excluded_tables)""", "fk_edges", "excluded_tables")
def r2(spark, sf):
    return integrity.fk_dangling(v.fk_edges(spark, sf), v.excluded_tables(spark, sf))


@query("r3_cascade_exclusions", _CLOSURE + """SELECT "table" FROM closure
    WHERE "table" NOT IN (SELECT "table" FROM excluded_tables)""", "fk_edges", "excluded_tables")
def r3(spark, sf):
    return integrity.cascade_exclusions(v.fk_edges(spark, sf), v.excluded_tables(spark, sf))


@query("r4_fk_edges", "SELECT DISTINCT child, parent FROM fk_edges", "fk_edges")
def r4(spark, sf):
    return integrity.fk_edges(v.pg_constraint(spark, sf), v.pg_class(spark, sf))


@query("r5_orphan_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_kept)""", "orders_kept")
def r5(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return integrity.orphan_rows(lines, v.orders_kept(spark, sf), [("l_orderkey", "o_orderkey")])


def _counts(tables, names):
    return union_all([tables[n].agg(F.count("*").alias("rows")).select(
        F.lit(n).alias("table"), "rows") for n in names])


@query("r6_truncate_tables", """SELECT 'region' AS "table", count(*) AS rows FROM region
    UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part
    UNION ALL SELECT 'customer', 0 UNION ALL SELECT 'orders', 0 UNION ALL SELECT 'lineitem', 0
    UNION ALL SELECT 'events', 0""")
def r6(spark, sf):
    names = ("region", "supplier", "part", "customer", "orders", "lineitem", "events")
    edges = local_rows(spark, [(c, p) for c, _, p, _ in v.FK], "child string, parent string")
    return _counts(integrity.truncate_tables(v.tables(spark, sf, *names), ["customer", "events"], edges),
                   names)


@query("r7_keep_recent", """SELECT o_orderkey, o_orderdate::VARCHAR AS day FROM orders
    WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY""")
def r7(spark, sf):
    kept = integrity.keep_recent(v.table(spark, sf, "orders"), "o_orderdate", 90, v.NOW_FILES)
    return kept.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query("r8_prune_cascade", """SELECT 'customer' AS "table", count(*) AS rows, sum(c_custkey)::BIGINT AS keys
      FROM customers_kept
    UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customers_kept)
    UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey IN (
      SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customers_kept))""", "customers_kept")
def r8(spark, sf):
    out = integrity.prune_cascade(v.tables(spark, sf, "customer", "orders", "lineitem"), v.FK,
                                  "customer", F.col("c_acctbal") < 0)
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return union_all([out[t].agg(F.count("*").alias("rows"), F.sum(k).alias("keys")).select(
        F.lit(t).alias("table"), "rows", "keys") for t, k in keys.items()])


@query("r8_prune_self", """WITH RECURSIVE tree AS (SELECT c_custkey, c_custkey // 4 AS referrer FROM customer),
      gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3
        UNION SELECT t.c_custkey FROM tree t JOIN gone g ON t.referrer = g.c_custkey)
    SELECT 'customer' AS "table", count(*) AS rows, sum(c_custkey)::BIGINT AS keys
      FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)""")
def r8_self(spark, sf):
    """Customers refer each other: a customer goes with its referrer, and orders go with customers."""
    found = v.tables(spark, sf, "customer", "orders")
    found["customer"] = found["customer"].withColumn("referrer", F.expr("nullif(c_custkey div 4, 0)"))
    edges = [("customer", "referrer", "customer", "c_custkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    out = integrity.prune_cascade(found, edges, "customer", F.col("c_custkey") % 7 == 3)
    return union_all([out[t].agg(F.count("*").alias("rows"), F.sum(k).alias("keys")).select(
        F.lit(t).alias("table"), "rows", "keys") for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"))])


_CYCLE = """SELECT 'c' AS pk, o_custkey AS pid, 'o' AS kind, o_orderkey AS id FROM orders
    UNION ALL SELECT 'o', c_custkey // 3 * 2, 'c', c_custkey FROM customer WHERE c_custkey % 3 = 0"""


@query("r8_prune_cycle", f"""WITH RECURSIVE refs AS ({_CYCLE}),
      gone AS (SELECT 'c' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 13 = 5
        UNION SELECT r.kind, r.id FROM refs r JOIN gone g ON r.pk = g.kind AND r.pid = g.id)
    SELECT 'customer' AS "table", count(*) AS rows, sum(c_custkey)::BIGINT AS keys
      FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone WHERE kind = 'c')
    UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT
      FROM orders WHERE o_orderkey NOT IN (SELECT id FROM gone WHERE kind = 'o')
    UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT
      FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM gone WHERE kind = 'o')""")
def r8_cycle(spark, sf):
    """Orders belong to customers, and some customers came by an order: two tables in a cycle, and one below."""
    found = v.tables(spark, sf, "customer", "orders", "lineitem")
    found["customer"] = found["customer"].withColumn("came_by", F.expr("IF(c_custkey % 3 = 0, c_custkey div 3 * 2, NULL)"))
    out = integrity.prune_cascade(found, [*v.FK, ("customer", "came_by", "orders", "o_orderkey")], "customer",
                                  F.col("c_custkey") % 13 == 5)
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return union_all([out[t].agg(F.count("*").alias("rows"), F.sum(k).alias("keys")).select(
        F.lit(t).alias("table"), "rows", "keys") for t, k in keys.items()])


@query("r9_subset_then_mask", f"""SELECT o_orderkey, md5({S} || contact_email) || '@masked.test' AS contact_email
    FROM orders_p WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 900 DAY
      AND o_custkey IN (SELECT c_custkey FROM customers_kept)""", "orders_p", "customers_kept")
def r9(spark, sf):
    data = {"people": v.people(spark, sf), "orders_p": v.orders_p(spark, sf)}
    out = gate.subset_then_mask(
        data, v.MANIFEST, v.SEED, recent={"orders_p": ("o_orderdate", 900, v.NOW_FILES)},
        prune=[("people", F.col("balance") < 0)], edges=[("orders_p", "o_custkey", "people", "id")])
    return out["orders_p"].select("o_orderkey", "contact_email")


@query("t1_table_stats", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in v.BASE))
def t1(spark, sf):
    return stats.table_stats(v.tables(spark, sf)).select("table", "rows")


@query("t2_stats_totals", """SELECT count(*) AS tables, sum(rows)::BIGINT AS rows,
    round(sum(size_bytes) / 1048576, 2) AS size_mb FROM stats""", "stats")
def t2(spark, sf):
    return stats.stats_totals(stats.clean_stats(v.table_sizes(spark, sf)))


@query("t3_tag_excluded", """SELECT "table", rows, size_bytes, p_type = 'LARGE' AS excluded FROM stats""", "stats")
def t3(spark, sf):
    return stats.tag_excluded(stats.clean_stats(v.table_sizes(spark, sf)), v.excluded_stats(spark, sf))


@query("t4_exclusion_savings", """SELECT round(sum(size_bytes) / 1048576, 2) AS saved_mb FROM stats
    WHERE p_type = 'LARGE'""", "stats")
def t4(spark, sf):
    return stats.exclusion_savings(stats.clean_stats(v.table_sizes(spark, sf)), v.excluded_stats(spark, sf))


@query("t5_analyze_report", f"""SELECT 'totals' AS section, '' AS name, '{{"tables":' || count(*) || ',"rows":' || sum(rows)
      || ',"size_bytes":' || sum(size_bytes) || '}}' AS record FROM stats
    UNION ALL SELECT 'table', "table", '{{"name":"' || "table" || '","rows":' || rows || ',"size_bytes":' || size_bytes
      || ',"excluded":' || (p_type = 'LARGE') || '}}' FROM stats
    UNION ALL SELECT 'pii', "table", '{{"table":"' || "table" || '","columns":['
      || string_agg('"' || "column" || '"', ',' ORDER BY "column") || ']}}'
      FROM {_first_match("fleet_catalog")} WHERE pattern IS NOT NULL GROUP BY "table" """, "stats", "fleet_catalog")
def t5(spark, sf):
    summary = discover.pii_summary(v.fleet_catalog(spark, sf, dealt=True).drop("database"))
    return stats.analyze_report(stats.clean_stats(v.table_sizes(spark, sf)),
                                v.excluded_stats(spark, sf), summary)


_COLS = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
         "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
         "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
         "documents": ("doc_id", "text", "lang", "source", "n_chars")}


def checksum_sql(table: str) -> str:
    text = " || chr(31) || ".join(f"coalesce({c}::VARCHAR, '\\N')" for c in _COLS[table])
    return f"sum(('0x' || substr(md5({text}), 1, 15))::BIGINT)::VARCHAR"


@query("w4_content_checksum", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS rows, {checksum_sql(t)} AS checksum FROM {t}""" for t in _COLS))
def w4(spark, sf):
    return union_all([content_checksum(df).select(F.lit(t).alias("table"), "rows", "checksum")
                              for t, df in v.tables(spark, sf, *_COLS).items()])


@query("u3_transform", """SELECT doc_id, replace(text, 'a', 'e') AS text FROM documents""")
def u3(spark, sf):
    from tablecloak.operators.hooks import transform

    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return transform(docs, lambda df: masking.text_sanitize(df, "text", [("a", "a", "e")]))
