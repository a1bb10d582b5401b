"""The same views in DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

from tablecloak.plans.views import MANIFEST_SAMPLES, NAMES, SEED

S = f"'{SEED}'"
_WHEN = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hourly' WHEN 'BUILDING' THEN 'daily'
   WHEN 'FURNITURE' THEN 'daily@' || (c_custkey % 26)
   WHEN 'HOUSEHOLD' THEN 'weekly@' || (c_custkey % 8) || ':' || (c_custkey % 24)
   ELSE (c_custkey % 60) || ' 4 * * 1-5' END"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _slots(first: int, last: int) -> str:
    names = ", ".join(_quote(n) for n in NAMES)
    return (f"SELECT p_partkey, p_brand, p_type, p_size, slot, "
            f"([{names}])[((p_partkey + slot * 5) % {len(NAMES)} + 1)::INTEGER] AS name "
            f"FROM part, (SELECT unnest(range({first}, {last + 1})) AS slot)")


def hash_int(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_HEAD = ["CREATE EXTENSION IF NOT EXISTS \"zonemap\" SCHEMA tools VERSION '1.5';",
         "COPY public.t (body) FROM stdin;"]
_TAIL = ["CREATE EXTENSION zonemap CASCADE;", "COPY public.t (body) FROM stdin;", "\\.",
         "CREATE EXTENSION zonemap CASCADE;", "CREATE EXTENSION \"zonemap_more\";",
         "COMMENT ON EXTENSION zonemap IS 'tables without bloat';",
         "CREATE DEFINER=`root`@`localhost` TRIGGER tr BEFORE INSERT ON t FOR EACH ROW SET @a = 1;",
         "CREATE TABLE v (a VARCHAR(65000), b VARCHAR(32000), c VARCHAR(255));",
         "mysqldump: [Warning] Using a password on the command line interface can be insecure.",
         "Warning: Using a password on the command line interface can be insecure.",
         "Got error: 1045: Access denied", ""]

VIEWS = {
    "people": """SELECT c_custkey AS id, c_name AS full_name,
        lower(replace(c_name, '#', '.')) || '@corp.example' AS email,
        '+1999' || lpad(c_custkey::VARCHAR, 7, '0') AS phone,
        '10.0.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256) AS ip_addr,
        DATE '1950-01-01' + (c_custkey % 20000)::INTEGER AS dob,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE lpad(c_custkey::VARCHAR, 9, '9') END AS ssn,
        c_mktsegment || ' / ' || c_acctbal::VARCHAR AS notes,
        c_mktsegment AS segment, c_acctbal AS balance,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
             WHEN c_acctbal < 1000 THEN '{"contact":{"email":"u' || c_custkey
                  || '@corp.example"},"theme":"' || c_mktsegment || '"}'
             ELSE '{"contact":{"email":"u' || c_custkey || '@corp.example","phone":"+1999'
                  || c_custkey || '"},"theme":"' || c_mktsegment || '"}' END AS prefs
        FROM customer""",
    "orders_p": """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, email AS contact_email
        FROM orders JOIN people ON o_custkey = id""",
    "people_masked": f"""SELECT id, 'Person_' || md5({S} || full_name) AS full_name,
        md5({S} || email) || '@masked.test' AS email,
        '+1555' || substr(md5({S} || phone), 1, 7) AS phone,
        '192.0.2.' || ({hash_int(S + " || ip_addr")} % 255) AS ip_addr,
        dob + ({hash_int(S + " || dob::VARCHAR || id::VARCHAR")} % 61 - 30)::INTEGER AS dob,
        NULL::VARCHAR AS ssn, substr(notes, 1, 8) AS notes, 'hidden' AS segment, balance,
        CASE WHEN prefs IS NULL THEN NULL ELSE
          '{{"contact":{{"email":"' || md5({S} || prefs) || '@masked.test"'
          || CASE WHEN balance < 1000 THEN '' ELSE ',"phone":null' END
          || '}},"theme":"' || segment || '"}}' END AS prefs
        FROM people""",
    "orders_masked": f"""SELECT o_orderkey, o_custkey,
        o_orderdate + to_days(({hash_int(S + " || o_orderdate::VARCHAR || o_orderkey::VARCHAR")} % 21 - 10)::INTEGER)
          AS o_orderdate, o_totalprice, md5({S} || contact_email) || '@masked.test' AS contact_email
        FROM orders_p""",
    # masked for some people only, so that post-conditions are broken by a known number of rows
    "people_mixed": """SELECT p.id, """ + ", ".join(
        f"CASE WHEN p.balance < 5000 THEN m.{c} ELSE p.{c} END AS {c}"
        for c in ("full_name", "email", "phone", "ip_addr", "dob", "ssn", "notes", "segment", "prefs"))
        + """, p.balance FROM people p JOIN people_masked m ON p.id = m.id""",
    "backup_files": """SELECT *, host || '/' || database || '/' || file AS path FROM (
        SELECT *, database || '_' || strftime(mtime, '%Y%m%d_%H%M%S') || '.sql.zst' || suffix AS file FROM (
        SELECT o_orderkey AS backup_id, 'h' || (o_custkey % 7) AS host, 'db' || o_custkey AS database,
        o_orderdate + to_seconds(o_orderkey % 86400) AS mtime, floor(o_totalprice)::BIGINT AS size,
        CASE o_orderstatus WHEN 'F' THEN '.age' WHEN 'O' THEN '.gpg' ELSE '' END AS suffix,
        o_orderpriority <> '5-LOW' AS complete, 400 + o_orderkey % 100 AS sidecar_bytes FROM orders))""",
    "sidecars": "SELECT backup_id, path, sidecar_bytes FROM backup_files WHERE complete",
    "audit": """SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
        CASE event_type WHEN 'signup' THEN 'restore' WHEN 'view' THEN 'vault_set'
          WHEN 'click' THEN CASE WHEN value < 5 THEN 'scrub_bypass' ELSE 'backup' END
          ELSE 'backup' END AS action,
        CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
        CASE WHEN event_type = 'click' AND value < 5 THEN NULL ELSE 'h' || (user_id % 7) END AS db_host,
        CASE WHEN event_type = 'click' AND value < 5 THEN NULL ELSE 'db' || user_id END AS database,
        CASE WHEN event_type = 'click' AND value < 5 THEN 'h' || (user_id % 7) END AS host,
        CASE WHEN event_type = 'click' AND value < 5 AND user_id % 2 = 0 THEN 'db' || user_id END AS target,
        CASE WHEN event_type = 'click' AND value < 5 AND user_id % 2 = 1 THEN 'box' || user_id END AS into_container,
        CASE WHEN event_type = 'view' THEN 'acct' || user_id END AS account,
        CASE WHEN value < 2 THEN 'n/a' ELSE floor(value * 1000)::BIGINT::VARCHAR END AS size,
        (event_id % 600)::VARCHAR AS duration_sec,
        CASE WHEN event_type = 'error' THEN 'exit ' || (event_id % 5) END AS error,
        '/data/db' || user_id || '_' || event_id || '.sql.zst' AS file,
        CASE WHEN event_type = 'signup' THEN 'db' || user_id || '_v1' END AS target_db
        FROM events""",
    "schedules": f"""SELECT 'h' || (c_custkey % 7) AS host, 'db' || c_custkey AS database, {_WHEN} AS "when",
        c_acctbal > 0 AS enabled, CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 10 THEN 3
          WHEN c_nationkey < 15 THEN 5 ELSE 7 END AS keep FROM customer""",
    "installed": f"""SELECT 'h' || (c_custkey % 7) AS host, 'db' || c_custkey AS database,
        CASE WHEN c_nationkey = 4 THEN 'daily@1' ELSE {_WHEN} END AS "when"
        FROM customer WHERE c_nationkey <> 3
        UNION ALL SELECT 'legacy', 'old' || s_suppkey, 'hourly' FROM supplier""",
    "hosts": """SELECT 'h' || s_suppkey AS host,
        CASE WHEN s_nationkey < 12 THEN 'postgres' ELSE 'mysql' END AS type,
        CASE WHEN s_nationkey < 6 THEN 'prod' WHEN s_nationkey < 12 THEN 'stage'
             WHEN s_nationkey < 18 THEN 'Prod' WHEN s_nationkey < 22 THEN 'local' END AS safety,
        CASE WHEN s_acctbal < 3000 THEN true WHEN s_acctbal < 6000 THEN false END AS required,
        CASE WHEN s_nationkey > 18 THEN 2 WHEN s_nationkey > 10 THEN 0 END AS n_required_for,
        s_nationkey > 15 AS extends, s_nationkey < 8 AS excludes FROM supplier""",
    "manifests": "SELECT 'h' || s_suppkey AS host FROM supplier WHERE s_acctbal > 500",
    "slots": _slots(0, 7),
    "target_slots": _slots(2, 9),
    "fleet_catalog": """SELECT 'db' || substr(p_brand, 7, 3) AS database, 't' || p_partkey AS "table",
        name AS "column", CASE WHEN name = 'prefs_json' THEN 'jsonb' WHEN name = 'settings' THEN 'json'
          WHEN name IN ('qty', 'price', 'weight') THEN 'integer' WHEN name = 'dob' THEN 'date'
          ELSE 'text' END AS type, p_size > 10 AS nullable FROM slots""",
    "fleet_manifest": f"""SELECT 'db' || substr(p_brand, 7, 3) AS database, 't' || p_partkey AS "table",
        name AS "column", 'redact' AS strategy, false AS no_pii
        FROM ({_slots(4, 9)}) WHERE p_type NOT IN ('PROMO', 'SMALL')
        UNION ALL SELECT 'db' || substr(p_brand, 7, 3), 't' || p_partkey, NULL, NULL, true
        FROM part WHERE p_type = 'SMALL'""",
    "captured_columns": """SELECT o_orderkey AS snapshot_id, 'h' || (o_custkey % 7) AS host, c.t AS "table",
        c.c AS "column", c.y AS type, c.n AS nullable FROM orders JOIN (VALUES
          ('2-HIGH', 'users', 'id', 'integer', false), ('2-HIGH', 'users', 'email', 'text', true),
          ('2-HIGH', 'log', 'actor_email', 'text', true),
          ('3-MEDIUM', 'users', 'id', 'integer', true), ('3-MEDIUM', 'users', 'email', 'text', true),
          ('3-MEDIUM', 'users', 'alt_email', 'text', true),
          ('4-NOT SPECIFIED', 'users', 'id', 'integer', true),
          ('5-LOW', 'users', 'email', 'text', true), ('5-LOW', 'meta', 'prefs', 'jsonb', true)
        ) c(p, t, c, y, n) ON o_orderpriority = c.p""",
    "fk_edges": """SELECT 't' || p_partkey AS child, 't' || (p_partkey // 8) AS parent FROM part
        UNION ALL SELECT 't' || (p_partkey // 8), 't' || p_partkey FROM part WHERE p_size = 7""",
    "excluded_tables": """SELECT 't' || p_partkey AS "table" FROM part WHERE p_size = 1""",
    "customers_kept": "SELECT * FROM customer WHERE c_acctbal >= 0",
    "orders_kept": "SELECT * FROM orders WHERE o_orderstatus <> 'P'",
    "dump_lines": f"""SELECT file, i AS line_no, parts[i] AS line FROM (
        SELECT file, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT 'doc' || doc_id AS file, [{", ".join(_quote(x) for x in _HEAD)}]
          || string_split(text, chr(10)) || [{", ".join(_quote(x) for x in _TAIL)}] AS parts
        FROM documents))""",
    "settings_kv": """SELECT lower(p_type) || '_' || CASE p_brand WHEN 'Brand#1' THEN 'apiKey'
          WHEN 'Brand#2' THEN 'smtp_password' WHEN 'Brand#3' THEN 'admin-email' ELSE 'option' END AS name,
        CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN 'AKIA' || lpad(p_partkey::VARCHAR, 16, '0')
          WHEN p_size = 3 THEN 'sk_live_' || lpad(p_partkey::VARCHAR, 12, '0')
          WHEN p_size = 4 THEN 'mysql://app:pw' || p_partkey || '@db.example/main'
          WHEN p_size = 5 THEN 'xoxb-' || lpad(p_partkey::VARCHAR, 10, '0')
          WHEN p_size = 6 THEN 'admin' || p_partkey || '@shop.example' ELSE p_name END AS value FROM part""",
    "engine_sidecars": """SELECT o_orderkey AS backup_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'postgres' WHEN '2-HIGH' THEN 'PostgreSQL'
          WHEN '3-MEDIUM' THEN 'mysql' WHEN '4-NOT SPECIFIED' THEN 'mariadb' ELSE 'oracle' END AS type,
        CASE WHEN o_custkey % 11 = 0 THEN 'bad'
          WHEN o_orderpriority < '3' THEN (130000 + 10000 * (o_custkey % 4) + 4)::VARCHAR
          WHEN o_orderpriority = '3-MEDIUM' THEN '8.' || (o_custkey % 3) || '.35'
          ELSE '10.11.6-MariaDB-1:10.11' END AS version,
        CASE o_orderstatus WHEN 'F' THEN ['pg_trgm', 'postgis'] WHEN 'O' THEN ['pg_trgm'] ELSE [] END
          AS extensions FROM orders""",
    "dump_heads": """SELECT 'doc' || doc_id AS file,
        CASE lang WHEN 'en' THEN 'PGDMP' || text WHEN 'de' THEN '-- PostgreSQL database dump ' || text
          ELSE text END AS head,
        CASE WHEN n_chars < 300 THEN 'mysql' ELSE '' END AS meta_type,
        CASE WHEN n_chars > 5000 THEN 'postgres' END AS host_type FROM documents""",
    "stats": """SELECT 'public.t' || p_partkey AS "table", CASE WHEN p_size = 9 THEN 0 ELSE p_size * 1000 END::BIGINT AS rows,
        floor(p_retailprice * 1024)::BIGINT AS size_bytes, p_type, p_partkey FROM part""",
    "remote_files": """SELECT path, CASE WHEN complete THEN size ELSE size + 1 END AS size
        FROM backup_files WHERE suffix <> '.gpg'
        UNION ALL SELECT 'h9/db' || c_custkey || '/db' || c_custkey || '_20000101_000000.sql.zst', c_custkey
        FROM customer""",
    "stderr_lines": """SELECT 'run' || o_custkey AS file, CASE o_orderpriority
          WHEN '1-URGENT' THEN 'mysqldump: [Warning] Using a password on the command line interface can be insecure.'
          WHEN '2-HIGH' THEN 'Warning: Using a password'
          WHEN '3-MEDIUM' THEN 'mysqldump: Got error: 1045: ' || o_orderkey
          WHEN '4-NOT SPECIFIED' THEN '' ELSE 'ERROR 1064 (42000) at line ' || o_orderkey END AS line
        FROM orders""",
    "manifest_texts": f"""SELECT p_partkey AS manifest_id,
        replace(([{", ".join(_quote(t) for t in MANIFEST_SAMPLES)}])[(p_partkey % {len(MANIFEST_SAMPLES)} + 1)::INTEGER],
          'T0', 't' || p_partkey) AS text FROM part""",
}

_NEEDS = {
    "orders_p": ["people"], "people_masked": ["people"], "orders_masked": ["people", "orders_p"],
    "people_mixed": ["people", "people_masked"], "sidecars": ["backup_files"],
    "fleet_catalog": ["slots"], "remote_files": ["backup_files"],
}


def with_views(sql: str, *names: str) -> str:
    """`sql` behind the definitions of the named views and of the views they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, " + sql.lstrip()[len("WITH RECURSIVE"):]
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, " + sql.lstrip()[len("WITH "):]
    return f"WITH {head} {sql}"
