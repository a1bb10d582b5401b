"""Views over the given tables in the shape the operators expect.

The given tables hold no personal columns, no snapshot catalogue and no audit log, so these
views derive them row by row. Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "seed-12345"
NOW_FILES = "2001-08-02 00:00:00"
NOW_AUDIT = "2024-01-31 00:00:00"

# Column names of the fleet catalogue: every dictionary corner case, and plain names.
NAMES = ("email_address", "backup-phone", "ip_address", "ipv4_src", "passwordHash", "company",
         "hotel_name", "business_unit", "zip_code", "accessToken", "created_at", "prefs_json",
         "settings", "dob", "qty", "status", "Recovery_Email", "ssn", "price", "FullName",
         "iban", "color", "weight", "updated_at")

PEOPLE = {
    "email": {"strategy": "fake_email"},
    "phone": {"strategy": "fake_phone"},
    "ip_addr": {"strategy": "fake_ip"},
    "full_name": {"strategy": "fake_name"},
    "dob": {"strategy": "shift_date", "max_days": 30},
    "ssn": {"strategy": "redact"},
    "notes": {"strategy": "truncate", "length": 8},
    "segment": {"strategy": "redact", "replacement": "hidden"},
    "balance": {"strategy": "passthrough", "reason": "needed for tests of totals"},
    "prefs": {"strategy": "jsonb_scrub_paths",
              "paths": {"$.contact.email": "fake_email", "$.contact.phone": "redact"}},
}
ORDERS_P = {
    "contact_email": {"strategy": "fake_email"},
    "o_orderdate": {"strategy": "shift_date", "max_days": 10, "key_cols": ["o_orderkey"]},
}
MANIFEST = {
    "version": 1, "seed_env": "MASK_SEED",
    "tables": {
        "people": {"columns": PEOPLE},
        "orders_p": {"columns": ORDERS_P},
        "nation": {"no_pii": True, "reason": "reference data"},
    },
}

# Rows of the test database's foreign keys: child, child column, parent, parent column.
FK = (("nation", "n_regionkey", "region", "r_regionkey"),
      ("customer", "c_nationkey", "nation", "n_nationkey"),
      ("supplier", "s_nationkey", "nation", "n_nationkey"),
      ("orders", "o_custkey", "customer", "c_custkey"),
      ("lineitem", "l_orderkey", "orders", "o_orderkey"),
      ("lineitem", "l_partkey", "part", "p_partkey"),
      ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
      ("labels", "doc_id", "documents", "doc_id"))

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names or BASE}


def people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS full_name",
        "concat(lower(replace(c_name, '#', '.')), '@corp.example') AS email",
        "concat('+1999', lpad(cast(c_custkey AS string), 7, '0')) AS phone",
        "concat('10.0.', (c_custkey div 256) % 256, '.', c_custkey % 256) AS ip_addr",
        "date_add(date'1950-01-01', cast(c_custkey % 20000 AS int)) AS dob",
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE lpad(cast(c_custkey AS string), 9, '9') END AS ssn",
        "concat(c_mktsegment, ' / ', cast(c_acctbal AS string)) AS notes",
        "c_mktsegment AS segment",
        "c_acctbal AS balance",
        """CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
                WHEN c_acctbal < 1000 THEN concat('{"contact":{"email":"u', c_custkey,
                     '@corp.example"},"theme":"', c_mktsegment, '"}')
                ELSE concat('{"contact":{"email":"u', c_custkey, '@corp.example","phone":"+1999',
                     c_custkey, '"},"theme":"', c_mktsegment, '"}') END AS prefs""",
    )


def orders_p(spark: SparkSession, sf: str) -> DataFrame:
    contact = people(spark, sf).select(F.col("id").alias("o_custkey"),
                                       F.col("email").alias("contact_email"))
    return (table(spark, sf, "orders").join(contact, "o_custkey")
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "contact_email"))


def people_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"people": people(spark, sf), "orders_p": orders_p(spark, sf),
            "nation": table(spark, sf, "nation")}


def backup_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS backup_id",
        "concat('h', o_custkey % 7) AS host",
        "concat('db', o_custkey) AS database",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS mtime",
        "cast(floor(o_totalprice) AS bigint) AS size",
        "CASE o_orderstatus WHEN 'F' THEN '.age' WHEN 'O' THEN '.gpg' ELSE '' END AS suffix",
        "o_orderpriority <> '5-LOW' AS complete",
        "400 + o_orderkey % 100 AS sidecar_bytes")
    name = F.concat("database", F.lit("_"), F.date_format("mtime", "yyyyMMdd_HHmmss"),
                    F.lit(".sql.zst"), "suffix")
    return rows.withColumn("file", name).withColumn("path", F.concat_ws("/", "host", "database", name))


def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    return backup_files(spark, sf).filter("complete").select("backup_id", "path", "sidecar_bytes")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS timestamp",
        """CASE event_type WHEN 'signup' THEN 'restore' WHEN 'view' THEN 'vault_set'
                WHEN 'click' THEN IF(value < 5, 'scrub_bypass', 'backup') ELSE 'backup' END AS action""",
        "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome",
        "IF(event_type = 'click' AND value < 5, NULL, concat('h', user_id % 7)) AS db_host",
        "IF(event_type = 'click' AND value < 5, NULL, concat('db', user_id)) AS database",
        "IF(event_type = 'click' AND value < 5, concat('h', user_id % 7), NULL) AS host",
        "IF(event_type = 'click' AND value < 5 AND user_id % 2 = 0, concat('db', user_id), NULL) AS target",
        "IF(event_type = 'click' AND value < 5 AND user_id % 2 = 1, concat('box', user_id), NULL) AS into_container",
        "CASE WHEN event_type = 'view' THEN concat('acct', user_id) END AS account",
        "CASE WHEN value < 2 THEN 'n/a' ELSE cast(cast(floor(value * 1000) AS bigint) AS string) END AS size",
        "cast(event_id % 600 AS string) AS duration_sec",
        "CASE WHEN event_type = 'error' THEN concat('exit ', event_id % 5) END AS error",
        "concat('/data/db', user_id, '_', event_id, '.sql.zst') AS file",
        "CASE WHEN event_type = 'signup' THEN concat('db', user_id, '_v1') END AS target_db")


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Declared schedules: one per customer as a host/database pair."""
    return table(spark, sf, "customer").selectExpr(
        "concat('h', c_custkey % 7) AS host",
        "concat('db', c_custkey) AS database",
        """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hourly' WHEN 'BUILDING' THEN 'daily'
                WHEN 'FURNITURE' THEN concat('daily@', c_custkey % 26)
                WHEN 'HOUSEHOLD' THEN concat('weekly@', c_custkey % 8, ':', c_custkey % 24)
                ELSE concat(c_custkey % 60, ' 4 * * 1-5') END AS when""",
        "c_acctbal > 0 AS enabled",
        """CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 10 THEN 3
                WHEN c_nationkey < 15 THEN 5 ELSE 7 END AS keep""")


def installed(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules found on the machines: some gone, some changed, some unknown."""
    known = table(spark, sf, "customer").filter("c_nationkey <> 3").selectExpr(
        "concat('h', c_custkey % 7) AS host", "concat('db', c_custkey) AS database",
        """CASE WHEN c_nationkey = 4 THEN 'daily@1' ELSE
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hourly' WHEN 'BUILDING' THEN 'daily'
                WHEN 'FURNITURE' THEN concat('daily@', c_custkey % 26)
                WHEN 'HOUSEHOLD' THEN concat('weekly@', c_custkey % 8, ':', c_custkey % 24)
                ELSE concat(c_custkey % 60, ' 4 * * 1-5') END END AS when""")
    extra = table(spark, sf, "supplier").selectExpr(
        "'legacy' AS host", "concat('old', s_suppkey) AS database", "'hourly' AS when")
    return known.unionByName(extra)


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts with safety labels (some malformed) and masking requirements."""
    return table(spark, sf, "supplier").selectExpr(
        "concat('h', s_suppkey) AS host",
        "CASE WHEN s_nationkey < 12 THEN 'postgres' ELSE 'mysql' END AS type",
        """CASE WHEN s_nationkey < 6 THEN 'prod' WHEN s_nationkey < 12 THEN 'stage'
                WHEN s_nationkey < 18 THEN 'Prod' WHEN s_nationkey < 22 THEN 'local' END AS safety""",
        "CASE WHEN s_acctbal < 3000 THEN true WHEN s_acctbal < 6000 THEN false END AS required",
        """CASE WHEN s_nationkey > 18 THEN array('staging', 'dev')
                WHEN s_nationkey > 10 THEN cast(array() AS array<string>) END AS required_for""",
        "CASE WHEN s_nationkey > 15 THEN array('loyalty:redact', 'nickname') END AS extend",
        "CASE WHEN s_nationkey < 8 THEN array('address', 'addr', 'pan') END AS exclude")


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts that have a manifest."""
    return table(spark, sf, "supplier").filter("s_acctbal > 500").selectExpr(
        "concat('h', s_suppkey) AS host")


def _slots(spark: SparkSession, sf: str, first: int, last: int, dealt: bool = False) -> DataFrame:
    """`last - first + 1` different names per part, chosen by part and slot. `dealt`: parts are dealt over
    the tasks first, as their file may be a single split."""
    names = F.array(*[F.lit(n) for n in NAMES])
    index = (F.col("p_partkey") + F.col("slot") * 5) % len(NAMES)
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return ((part.repartition("p_partkey") if dealt else part)
            .select("p_partkey", "p_brand", "p_type", "p_size",
                    F.explode(F.sequence(F.lit(first), F.lit(last))).alias("slot"))
            .withColumn("name", F.element_at(names, index.cast("int") + 1)))


def _database() -> Column:
    return F.concat(F.lit("db"), F.substring("p_brand", 7, 3))


def fleet_catalog(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Eight columns per part, a part being a table and its brand a database."""
    kind = (F.when(F.col("name") == "prefs_json", "jsonb").when(F.col("name") == "settings", "json")
            .when(F.col("name").isin("qty", "price", "weight"), "integer")
            .when(F.col("name") == "dob", "date").otherwise("text"))
    return _slots(spark, sf, 0, 7, dealt).select(
        _database().alias("database"), F.concat(F.lit("t"), F.col("p_partkey")).alias("table"),
        F.col("name").alias("column"), kind.alias("type"),
        (F.col("p_size") > 10).alias("nullable"))


def fleet_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations for most tables: half of their columns and some that no longer exist; one
    kind of table is declared free of personal data, one is unknown."""
    cols = _slots(spark, sf, 4, 9).filter("p_type not in ('PROMO', 'SMALL')").select(
        _database().alias("database"), F.concat(F.lit("t"), F.col("p_partkey")).alias("table"),
        F.col("name").alias("column"), F.lit("redact").alias("strategy"), F.lit(False).alias("no_pii"))
    no_pii = table(spark, sf, "part").filter("p_type = 'SMALL'").select(
        _database().alias("database"), F.concat(F.lit("t"), F.col("p_partkey")).alias("table"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("strategy"),
        F.lit(True).alias("no_pii"))
    return cols.unionByName(no_pii)


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot per order with the schema captured for its customer's segment: JSON text as
    sidecars hold it, or none in old snapshots."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS snapshot_id",
        "concat('h', o_custkey % 7) AS host",
        """CASE o_orderpriority
             WHEN '1-URGENT' THEN NULL
             WHEN '2-HIGH' THEN concat('{"tables":{"users":{"columns":{"id":{"type":"integer","nullable":false},',
                  '"email":{"type":"text"}}},"log":{"columns":{"actor_email":{"type":"text"}}}}}')
             WHEN '3-MEDIUM' THEN concat('{"tables":{"users":{"columns":{"id":{"type":"integer"},',
                  '"email":{"type":"text"},"alt_email":{"type":"text","nullable":true}}}}}')
             WHEN '4-NOT SPECIFIED' THEN '{"tables":{"users":{"columns":{"id":{"type":"integer"}}}}}'
             ELSE concat('{"tables":{"users":{"columns":{"email":{"type":"text"}}},',
                  '"meta":{"columns":{"prefs":{"type":"jsonb"}}}}}') END AS scrub_schema""")


def host_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of every host that has snapshots: users.email, and a table without PII."""
    per_host = table(spark, sf, "customer").selectExpr(
        "concat('h', c_custkey % 7) AS host").distinct()
    return per_host.selectExpr(
        "host", "inline(array(struct('users' AS table, 'email' AS column, false AS no_pii), "
        "struct('log' AS table, cast(NULL AS string) AS column, true AS no_pii)))")


def pg_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey + 16384 AS oid", "concat('t', p_partkey) AS relname")


def pg_constraint(spark: SparkSession, sf: str) -> DataFrame:
    """Each table references the table with an eighth of its number; some keys point back, which makes
    cycles; every table also has its own primary key."""
    part = table(spark, sf, "part")
    up = part.selectExpr("'f' AS contype", "p_partkey + 16384 AS conrelid",
                         "p_partkey div 8 + 16384 AS confrelid")
    back = part.filter("p_size = 7").selectExpr(
        "'f' AS contype", "p_partkey div 8 + 16384 AS conrelid", "p_partkey + 16384 AS confrelid")
    own = part.selectExpr("'p' AS contype", "p_partkey + 16384 AS conrelid", "0L AS confrelid")
    return up.unionByName(back).unionByName(own)


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    up = part.selectExpr("concat('t', p_partkey) AS child", "concat('t', p_partkey div 8) AS parent")
    back = part.filter("p_size = 7").selectExpr(
        "concat('t', p_partkey div 8) AS child", "concat('t', p_partkey) AS parent")
    return up.unionByName(back)


def excluded_tables(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_size = 1").selectExpr(
        "concat('t', p_partkey) AS table")


def information_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as a live database's information schema gives them."""
    return _slots(spark, sf, 0, 7).selectExpr(
        "CASE WHEN p_type = 'PROMO' THEN 'internal' ELSE 'public' END AS table_schema",
        "concat('t', p_partkey) AS table_name", "name AS column_name", "'text' AS data_type",
        "CASE WHEN p_size > 10 THEN 'YES' ELSE 'NO' END AS is_nullable",
        "slot + 1 AS ordinal_position")


def target_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of an older clone: shifted by two slots, one kind of column with another type."""
    return _slots(spark, sf, 2, 9).selectExpr(
        "concat('t', p_partkey) AS table", "name AS column",
        "CASE WHEN name IN ('qty', 'price') THEN 'bigint' WHEN name = 'prefs_json' THEN 'jsonb'"
        " WHEN name = 'settings' THEN 'json' WHEN name = 'weight' THEN 'integer'"
        " WHEN name = 'dob' THEN 'date' ELSE 'text' END AS type")


def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listing of a snapshot root: files, sidecars, and partial files that do not count."""
    b = backup_files(spark, sf)
    full = F.concat(F.lit("file:/backups/"), F.col("path"))
    rows = b.select(full.alias("path"), F.col("size").alias("length"),
                    F.col("mtime").alias("modificationTime"), "complete", "suffix")
    cols = ["path", "length", "modificationTime"]
    meta = rows.filter("complete").select(
        F.concat("path", F.lit(".meta.json")).alias("path"), F.lit(400).cast("bigint").alias("length"),
        "modificationTime")
    partial = rows.filter("suffix = ''").select(
        F.concat("path", F.lit(".partial")).alias("path"), "length", "modificationTime")
    bad_host = rows.filter("suffix = '.age'").select(
        F.replace("path", F.lit("/backups/h"), F.lit("/backups/-h")).alias("path"), "length",
        "modificationTime")
    return rows.select(cols).unionByName(meta).unionByName(partial).unionByName(bad_host)


def remote_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a remote store holds: most local files, some of another size, some of its own."""
    b = backup_files(spark, sf)
    kept = b.filter("suffix <> '.gpg'").select(
        "path", F.expr("CASE WHEN complete THEN size ELSE size + 1 END").alias("size"))
    own = table(spark, sf, "customer").selectExpr(
        "concat('h9/db', c_custkey, '/db', c_custkey, '_20000101_000000.sql.zst') AS path",
        "c_custkey AS size")
    meta = own.selectExpr("concat(path, '.meta.json') AS path", "size")
    return kept.unionByName(own).unionByName(meta)


def database_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "CASE p_type WHEN 'PROMO' THEN 'postgres' WHEN 'SMALL' THEN 'template0' WHEN 'LARGE' THEN 'sys'"
        " ELSE concat('db', p_partkey) END AS database")


def excluded_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Excluded names: one kind of table by its full name, another without its schema."""
    return table(spark, sf, "part").filter("p_type in ('LARGE', 'PROMO')").selectExpr(
        "CASE p_type WHEN 'LARGE' THEN concat('public.t', p_partkey)"
        " ELSE concat('t', p_partkey) END AS table")


def stderr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Error output of one run per order."""
    return table(spark, sf, "orders").selectExpr(
        "concat('run', o_custkey) AS file",
        """CASE o_orderpriority
             WHEN '1-URGENT' THEN 'mysqldump: [Warning] Using a password on the command line interface can be insecure.'
             WHEN '2-HIGH' THEN 'Warning: Using a password'
             WHEN '3-MEDIUM' THEN concat('mysqldump: Got error: 1045: ', o_orderkey)
             WHEN '4-NOT SPECIFIED' THEN '' ELSE concat('ERROR 1064 (42000) at line ', o_orderkey) END AS line""")


def hook_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One configured hook per supplier, some malformed."""
    return table(spark, sf, "supplier").selectExpr(
        "concat('h', s_suppkey) AS scope", "cast(s_suppkey AS int) AS idx",
        "CASE WHEN s_nationkey < 10 THEN 'SELECT 1' END AS sql",
        "CASE WHEN s_nationkey > 5 AND s_nationkey < 20 THEN concat('hooks/', s_suppkey, '.sql') END AS file",
        "s_acctbal > 0 AND s_acctbal < 5000 AS file_exists")


def customers_kept(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter("c_acctbal >= 0")


def orders_kept(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'")


def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a dump file: statements, its lines as COPY data that also holds
    statement text, and the lines the MySQL cleaner looks for."""
    head = ["CREATE EXTENSION IF NOT EXISTS \"zonemap\" SCHEMA tools VERSION '1.5';",
            "COPY public.t (body) FROM stdin;"]
    tail = ["CREATE EXTENSION zonemap CASCADE;", "COPY public.t (body) FROM stdin;", "\\.",
            "CREATE EXTENSION zonemap CASCADE;", "CREATE EXTENSION \"zonemap_more\";",
            "COMMENT ON EXTENSION zonemap IS 'tables without bloat';",
            "CREATE DEFINER=`root`@`localhost` TRIGGER tr BEFORE INSERT ON t FOR EACH ROW SET @a = 1;",
            "CREATE TABLE v (a VARCHAR(65000), b VARCHAR(32000), c VARCHAR(255));",
            "mysqldump: [Warning] Using a password on the command line interface can be insecure.",
            "Warning: Using a password on the command line interface can be insecure.",
            "Got error: 1045: Access denied", ""]
    body = F.concat(F.array(*[F.lit(x) for x in head]), F.split("text", "\n"),
                    F.array(*[F.lit(x) for x in tail]))
    return (table(spark, sf, "documents")
            .select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file"),
                    F.posexplode(body).alias("pos", "line"))
            .select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"))


def settings_kv(spark: SparkSession, sf: str) -> DataFrame:
    """A settings table: names with and without dictionary words, some key-shaped values."""
    return table(spark, sf, "part").selectExpr(
        "concat(lower(p_type), '_', CASE p_brand WHEN 'Brand#1' THEN 'apiKey' WHEN 'Brand#2' THEN 'smtp_password'"
        " WHEN 'Brand#3' THEN 'admin-email' ELSE 'option' END) AS name",
        """CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN concat('AKIA', lpad(cast(p_partkey AS string), 16, '0'))
                WHEN p_size = 3 THEN concat('sk_live_', lpad(cast(p_partkey AS string), 12, '0'))
                WHEN p_size = 4 THEN concat('mysql://app:pw', p_partkey, '@db.example/main')
                WHEN p_size = 5 THEN concat('xoxb-', lpad(cast(p_partkey AS string), 10, '0'))
                WHEN p_size = 6 THEN concat('admin', p_partkey, '@shop.example') ELSE p_name END AS value""")


def part_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON with secrets at several depths."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE WHEN p_size < 5 THEN NULL ELSE concat('{"name":"', p_name, '","owner":{"mail":"o', p_partkey,
           '@corp.example","keys":[{"aws":"AKIA', lpad(cast(p_partkey AS string), 16, '0'), '"},{"n":', p_size,
           ',"dsn":"', IF(p_size > 40, 'pg://u:p@h/db', 'none'), '"}]},"tags":["a","',
           IF(p_type = 'PROMO', concat('p', p_partkey, '@promo.example'), 'b'), '"]}') END AS doc""")


def part_json_deep(spark: SparkSession, sf: str) -> DataFrame:
    """JSON whose leaves lie below twelve objects. The parts are dealt over the tasks first."""
    opened, closed = "".join(f'{{"l{i}":' for i in range(1, 13)), "}" * 12
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_type").repartition("p_partkey").selectExpr(
        "p_partkey",
        f"""concat('{opened}{{"mail":"o', p_partkey, '@corp.example","keys":[["',
           IF(p_size > 10, concat('AKIA', lpad(cast(p_partkey AS string), 16, '0')), 'none'), '"]],"other":"',
           IF(p_type = 'PROMO', concat('p', p_partkey, '@promo.example'), 'b'), '"}}{closed}') AS doc""")


def engine_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Engine, version text and extensions of one snapshot per order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS backup_id",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'postgres' WHEN '2-HIGH' THEN 'PostgreSQL'
                WHEN '3-MEDIUM' THEN 'mysql' WHEN '4-NOT SPECIFIED' THEN 'mariadb' ELSE 'oracle' END AS type""",
        """CASE WHEN o_custkey % 11 = 0 THEN 'bad'
                WHEN o_orderpriority < '3' THEN cast(130000 + 10000 * (o_custkey % 4) + 4 AS string)
                WHEN o_orderpriority = '3-MEDIUM' THEN concat('8.', o_custkey % 3, '.35')
                ELSE '10.11.6-MariaDB-1:10.11' END AS version""",
        """CASE o_orderstatus WHEN 'F' THEN array('pg_trgm', 'postgis') WHEN 'O' THEN array('pg_trgm')
                ELSE cast(array() AS array<string>) END AS extensions""")


def dump_heads(spark: SparkSession, sf: str) -> DataFrame:
    """First line of each document as a dump head, with sidecar and host types where known."""
    return table(spark, sf, "documents").selectExpr(
        "concat('doc', doc_id) AS file",
        """CASE lang WHEN 'en' THEN concat('PGDMP', text) WHEN 'de' THEN concat('-- PostgreSQL database dump ', text)
                ELSE text END AS head""",
        "CASE WHEN n_chars < 300 THEN 'mysql' ELSE '' END AS meta_type",
        "CASE WHEN n_chars > 5000 THEN 'postgres' END AS host_type")


def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics text of one table per part, some of it unreadable."""
    return table(spark, sf, "part").selectExpr(
        "concat('public.t', p_partkey) AS table",
        "CASE WHEN p_size = 9 THEN 'n/a' ELSE cast(p_size * 1000 AS string) END AS rows",
        "cast(cast(floor(p_retailprice * 1024) AS bigint) AS string) AS size_bytes")


def manifest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest text per part: valid ones and one for every rule, with the part's own names."""
    texts = F.array(*[F.lit(t) for t in MANIFEST_SAMPLES])
    pick = F.element_at(texts, ((F.col("p_partkey") % len(MANIFEST_SAMPLES)) + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("manifest_id"),
        F.replace(pick, F.lit("T0"), F.concat(F.lit("t"), F.col("p_partkey"))).alias("text"))


def _one(entry: str, head: str = '"version":1') -> str:
    return '{' + head + ',"tables":{"T0":' + entry + '}}'


MANIFEST_SAMPLES = (
    _one('{"columns":{"email":{"strategy":"fake_email"}}}'),
    _one('{"columns":{"a":{"strategy":"truncate","length":8},"b":{"strategy":"shift_date","max_days":3}}}'),
    _one('{"no_pii":true,"reason":"reference data"}', '"version":"1","seed_env":"MASK_SEED"'),
    'not json',
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"v":1'),
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"version":2'),
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"version":1,"seed_env":""'),
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"version":1,"seed_env":"my-seed"'),
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"version":1,"dictionary":{"extend":"x"}'),
    _one('{"columns":{"a":{"strategy":"redact"}}}', '"version":1,"dictionary":{"exclude":{}}'),
    '{"version":1}',
    '{"version":1,"tables":[]}',
    _one('{"no_pii":true}'),
    _one('{"no_pii":true,"reason":"r","columns":{"a":{"strategy":"redact"}}}'),
    _one('{"columns":{}}'),
    _one('{"columns":{"a":{}}}'),
    _one('{"columns":{"a":{"strategy":"scramble"}}}'),
    _one('{"columns":{"a":{"strategy":"truncate"}}}'),
    _one('{"columns":{"a":{"strategy":"truncate","length":0}}}'),
    _one('{"columns":{"a":{"strategy":"shift_date","max_days":"x"}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths"}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths","paths":{}}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths","paths":{"$[0]":"redact"}}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths","paths":{"$.x":"scramble"}}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths","paths":{"$.x":"jsonb_scrub_paths"}}}}'),
    _one('{"columns":{"a":{"strategy":"jsonb_scrub_paths","paths":{"$.x":"truncate"}}}}'),
    _one('{"columns":{"a":{"strategy":"passthrough"}}}'),
    _one('{"columns":{"a":{"strategy":"redact","replacement":null}}}'),
    _one('{"columns":{"a":{"strategy":"redact","replacement":7},"b":{"strategy":"passthrough"}}}'),
)
