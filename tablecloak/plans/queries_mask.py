"""Queries for the masks and their post-conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.functions import masks
from tablecloak.operators import masking, verify
from tablecloak.plans import gate
from tablecloak.plans import views as v
from tablecloak.plans.oracle_views import S, hash_int
from tablecloak.plans.registry import query
from tablecloak.session import local_rows, scratch_path
from tablecloak.sources import snapshot
from tablecloak.sources.snapshot import roundtrip

KEYED = {"o_orderdate": v.ORDERS_P["o_orderdate"]}


def mixed_people(spark: SparkSession, sf: str) -> DataFrame:
    """People of whom only some are masked."""
    raw = v.people(spark, sf)
    masked = F.col("balance") < 5000
    fields = {f.name: f for f in raw.schema.fields}
    return raw.select(*[
        F.when(masked, masking.mask_column(fields[c], v.PEOPLE[c], v.SEED)).otherwise(F.col(c)).alias(c)
        if c in v.PEOPLE else F.col(c) for c in raw.columns])


@query("m0_seeded_hash", f"SELECT id, md5({S} || email) AS hash FROM people", "people")
def m0(spark, sf):
    return v.people(spark, sf).select("id", masks.seeded_hash("email", v.SEED).alias("hash"))


@query("m1_fake_email", "SELECT id, email FROM people_masked", "people_masked")
def m1(spark, sf):
    return v.people(spark, sf).select("id", masks.fake_email("email", v.SEED).alias("email"))


@query("m2_fake_phone", "SELECT id, phone FROM people_masked", "people_masked")
def m2(spark, sf):
    return v.people(spark, sf).select("id", masks.fake_phone("phone", v.SEED).alias("phone"))


@query("m3_fake_ip", "SELECT id, ip_addr FROM people_masked", "people_masked")
def m3(spark, sf):
    return v.people(spark, sf).select("id", masks.fake_ip("ip_addr", v.SEED).alias("ip_addr"))


@query("m4_fake_name", "SELECT id, full_name FROM people_masked", "people_masked")
def m4(spark, sf):
    return v.people(spark, sf).select("id", masks.fake_name("full_name", v.SEED).alias("full_name"))


@query("m5_redact", "SELECT id, NULL::VARCHAR AS ssn, NULL::DOUBLE AS balance FROM people", "people")
def m5(spark, sf):
    return v.people(spark, sf).select("id", masks.redact().alias("ssn"),
                                      masks.redact("double").alias("balance"))


@query("m6_redact_replacement", "SELECT id, 'hidden' AS ssn FROM people", "people")
def m6(spark, sf):
    return v.people(spark, sf).select("id", masks.redact("string", "hidden").alias("ssn"))


@query("m7_truncate", "SELECT id, substr(notes, 1, 8) AS notes, substr(ssn, 1, 3) AS ssn FROM people",
       "people")
def m7(spark, sf):
    return v.people(spark, sf).select("id", masks.truncate("notes", 8).alias("notes"),
                                      masks.truncate("ssn", 3).alias("ssn"))


@query("m8_shift_date", """SELECT 'people' AS "table", id, dob::VARCHAR AS shifted FROM people_masked
    UNION ALL SELECT 'orders', o_orderkey, o_orderdate::VARCHAR FROM orders_masked""",
       "people_masked", "orders_masked")
def m8(spark, sf):
    people = v.people(spark, sf).select(
        F.lit("people").alias("table"), "id",
        masks.shift_date("dob", v.SEED, 30).cast("string").alias("shifted"))
    moved = masks.shift_date("o_orderdate", v.SEED, 10, ("o_orderkey",), "timestamp_ntz")
    orders = v.table(spark, sf, "orders").select(
        F.lit("orders").alias("table"), F.col("o_orderkey").alias("id"),
        moved.cast("string").alias("shifted"))
    return people.unionByName(orders)


@query("m9_passthrough", "SELECT id, balance FROM people", "people")
def m9(spark, sf):
    return v.people(spark, sf).select("id", masks.passthrough("balance").alias("balance"))


@query("m10_json_scrub_paths", "SELECT id, prefs FROM people_masked", "people_masked")
def m10(spark, sf):
    prefs = masking.json_scrub_paths("prefs", v.PEOPLE["prefs"]["paths"], v.SEED)
    return v.people(spark, sf).select("id", prefs.alias("prefs"))


@query("m10_json_scrub_variant", f"""SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE
    '{{"name":"Person_' || h || '","owner":{{"keys":[{{"aws":"AKIA' || lpad(p_partkey::VARCHAR, 16, '0') || '"}},'
    || '{{"dsn":"' || CASE WHEN p_size > 40 THEN 'pg://u:p@h/db' ELSE 'none' END || '","n":' || p_size
    || '}}],"mail":null}},"tags":["a","' || CASE WHEN p_type = 'PROMO' THEN 'p' || p_partkey || '@promo.example'
    ELSE 'b' END || '"]}}' END AS doc
    FROM (SELECT *, md5({S} || '{{"name":"' || p_name || '","owner":{{"keys":[{{"aws":"AKIA'
    || lpad(p_partkey::VARCHAR, 16, '0') || '"}},{{"dsn":"' || CASE WHEN p_size > 40 THEN 'pg://u:p@h/db' ELSE 'none' END
    || '","n":' || p_size || '}}],"mail":"o' || p_partkey || '@corp.example"}},"tags":["a","'
    || CASE WHEN p_type = 'PROMO' THEN 'p' || p_partkey || '@promo.example' ELSE 'b' END || '"]}}') AS h FROM part)""")
def m10_variant(spark, sf):
    docs = v.part_json(spark, sf).withColumn("doc", F.parse_json("doc"))
    spec = {"doc": {"strategy": "jsonb_scrub_paths",
                    "paths": {"$.name": "fake_name", "$.owner.mail": "redact", "$.none": "fake_ip"}}}
    return masking.mask_table(docs, spec, v.SEED).withColumn("doc", F.to_json("doc"))


_PEOPLE_SQL = """SELECT id, full_name, email, phone, ip_addr, dob::VARCHAR AS dob, ssn, notes, segment,
    balance, prefs FROM people_masked"""


@query("m11_mask_table", _PEOPLE_SQL, "people_masked")
def m11(spark, sf):
    return masking.mask_table(v.people(spark, sf), v.PEOPLE, v.SEED).withColumn(
        "dob", F.col("dob").cast("string"))


@query("m12_mask_dataset", """SELECT 'people' AS "table", id, email AS contact, dob::VARCHAR AS day FROM people_masked
    UNION ALL SELECT 'orders_p', o_orderkey, contact_email, o_orderdate::VARCHAR FROM orders_masked
    UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation""", "people_masked", "orders_masked")
def m12(spark, sf):
    out = masking.mask_dataset(v.people_tables(spark, sf), v.MANIFEST, v.SEED)

    def part(name, key, contact, day):
        return out[name].select(F.lit(name).alias("table"), F.col(key).cast("bigint").alias("id"),
                                F.col(contact).alias("contact"), day.cast("string").alias("day"))

    return (part("people", "id", "email", F.col("dob"))
            .unionByName(part("orders_p", "o_orderkey", "contact_email", F.col("o_orderdate")))
            .unionByName(part("nation", "n_nationkey", "n_name", F.lit(None))))


_SANITIZED = r"""regexp_replace(regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}',
    'redacted@example.com', 'g'), '\+1[0-9]{{10}}', '+15550000000', 'g')"""


@query("m13_text_sanitize", f"""SELECT 'd' || doc_id AS id, {_SANITIZED.format("text")} AS text FROM documents
    UNION ALL SELECT 'p' || page_id, {_SANITIZED.format("html")} FROM pages""")
def m13(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = v.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"),
                                               F.col("html").alias("text"))
    return masking.text_sanitize(docs.unionByName(pages), "text")


@query("m14_redact_literal",
       f"SELECT conv_id, turn, replace(text, '{v.SEED[:2]}', '{masking.SECRET_SENTINEL}') AS text FROM conversations")
def m14(spark, sf):
    df = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return masking.redact_literal(df, "text", v.SEED[:2])


def _sniff(name, col, spec, cond):
    @query(name, f"SELECT count(*) FILTER (WHERE {cond}) AS sniff_count FROM people_mixed", "people_mixed")
    def run(spark, sf):
        return verify.sniff(mixed_people(spark, sf), col, spec)


_sniff("v1_sniff_fake_email", "email", v.PEOPLE["email"],
       "email IS NOT NULL AND email NOT LIKE '%@masked.test'")
_sniff("v2_sniff_fake_phone", "phone", v.PEOPLE["phone"],
       "phone IS NOT NULL AND phone NOT LIKE '+1555%'")
_sniff("v3_sniff_fake_ip", "ip_addr", v.PEOPLE["ip_addr"],
       "ip_addr IS NOT NULL AND ip_addr NOT LIKE '192.0.2.%'")
_sniff("v4_sniff_fake_name", "full_name", v.PEOPLE["full_name"],
       "full_name IS NOT NULL AND full_name NOT LIKE 'Person!_%' ESCAPE '!'")
_sniff("v5_sniff_redact", "ssn", v.PEOPLE["ssn"], "ssn IS NOT NULL")
_sniff("v6_sniff_redact_replacement", "segment", v.PEOPLE["segment"],
       "segment IS NULL OR segment <> 'hidden'")
_sniff("v7_sniff_truncate", "notes", v.PEOPLE["notes"], "length(notes) > 8")
_sniff("v8_sniff_shift_date", "dob", v.PEOPLE["dob"], "false")
_sniff("v8_sniff_passthrough", "balance", v.PEOPLE["balance"], "false")
_LEAVES = """(json_extract_string(prefs, '$.contact.email') IS NOT NULL
    AND json_extract_string(prefs, '$.contact.email') NOT LIKE '%@masked.test')
    OR json_extract_string(prefs, '$.contact.phone') IS NOT NULL"""
_sniff("v9_sniff_json_paths", "prefs", v.PEOPLE["prefs"], _LEAVES)

_CHECKS = (
    ("balance", "passthrough", "false"), ("dob", "shift_date", "false"),
    ("email", "fake_email", "email NOT LIKE '%@masked.test'"),
    ("full_name", "fake_name", "full_name NOT LIKE 'Person!_%' ESCAPE '!'"),
    ("ip_addr", "fake_ip", "ip_addr NOT LIKE '192.0.2.%'"),
    ("notes", "truncate", "length(notes) > 8"), ("phone", "fake_phone", "phone NOT LIKE '+1555%'"),
    ("prefs", "jsonb_scrub_paths", _LEAVES),
    ("segment", "redact", "segment IS NULL OR segment <> 'hidden'"), ("ssn", "redact", "ssn IS NOT NULL"))


def _report_sql(people: str, orders: str) -> str:
    rows = [f"""SELECT 'people' AS "table", '{c}' AS "column", '{s}' AS strategy,
        count(*) FILTER (WHERE {cond}) AS sniff_count FROM {people}""" for c, s, cond in _CHECKS]
    rows.append(f"""SELECT 'orders_p', 'contact_email', 'fake_email',
        count(*) FILTER (WHERE contact_email NOT LIKE '%@masked.test') FROM {orders}""")
    rows.append(f"SELECT 'orders_p', 'o_orderdate', 'shift_date', 0 FROM {orders} LIMIT 1")
    body = " UNION ALL ".join(f"SELECT * FROM ({r})" for r in rows)
    return f'SELECT *, sniff_count = 0 AS "pass" FROM ({body})'


def masked_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: mask the people tables and count what breaks a post-condition."""
    out = masking.mask_dataset(v.people_tables(spark, sf), v.MANIFEST, v.SEED)
    return verify.sniff_report(out, v.MANIFEST)


query("v10_sniff_report", _report_sql("people_masked", "orders_masked"),
      "people_masked", "orders_masked")(masked_report)


@query("v10_sniff_report_mixed", _report_sql("people_mixed", "orders_p"), "people_mixed", "orders_p")
def v10_mixed(spark, sf):
    data = v.people_tables(spark, sf) | {"people": mixed_people(spark, sf)}
    return verify.sniff_report(data, v.MANIFEST)


@query("v10_sniff_errors", """SELECT 'customer' AS "table", 'c_mktsegment' AS "column", -1::BIGINT AS sniff_count
    UNION ALL SELECT 'customer', 'c_name', count(*) FILTER (WHERE length(c_name) > 5) FROM customer
    UNION ALL SELECT 'nation', 'n_name', count(*) FILTER (WHERE length(n_name) > 5) FROM nation
    UNION ALL SELECT 'nowhere', 'x', -1""")
def v10_errors(spark, sf):
    """A column that cannot be read is -1, and so is a table that is not there; the others are counted."""
    short = {"strategy": "truncate", "length": 5}
    data = {"customer": v.table(spark, sf, "customer").withColumn("c_mktsegment", F.raise_error(F.lit("unreadable")).cast("string")),
            "nation": v.table(spark, sf, "nation")}
    m = {"tables": {"customer": {"columns": {"c_name": short, "c_mktsegment": short}}, "nation": {"columns": {"n_name": short}},
                    "nowhere": {"columns": {"x": short}}}}
    return verify.sniff_report(data, m).select("table", "column", "sniff_count")


@query("v11_gate_ok", f"""SELECT 'masked' AS state, bool_and("pass") AS ok
    FROM ({_report_sql("people_masked", "orders_masked")})
    UNION ALL SELECT 'mixed', bool_and("pass") FROM ({_report_sql("people_mixed", "orders_p")})""",
       "people_masked", "orders_masked", "people_mixed")
def v11(spark, sf):
    good = verify.gate_ok(masked_report(spark, sf)).select(F.lit("masked").alias("state"), "ok")
    bad = verify.gate_ok(v10_mixed(spark, sf)).select(F.lit("mixed").alias("state"), "ok")
    return good.unionByName(bad)


_MASKED_COUNTS = """SELECT 'orders_p' AS "table", count(*) AS rows, count(DISTINCT contact_email) AS fakes
    FROM orders_masked UNION ALL SELECT 'people', count(*), count(DISTINCT email) FROM people_masked
    UNION ALL SELECT 'nation', count(*), 0 FROM nation"""


@query("v12_scrub_gate", _MASKED_COUNTS, "people_masked", "orders_masked")
def v12(spark, sf):
    out = scratch_path(spark, "gate")
    return masked_counts(gate.scrub_gate(v.people_tables(spark, sf), v.MANIFEST, f"{out}/final", f"{out}/report",
                                         seed=v.SEED, json_columns=["people.prefs"]))


def masked_counts(done):
    def part(name, fakes):
        return done[name].agg(F.count("*").alias("rows"), fakes.alias("fakes")).select(
            F.lit(name).alias("table"), "rows", "fakes")

    return (part("orders_p", F.count_distinct("contact_email"))
            .unionByName(part("people", F.count_distinct("email")))
            .unionByName(part("nation", F.count_if(F.lit(False)))))


@query("w6_guarded_restore", _MASKED_COUNTS, "people_masked", "orders_masked")
def w6_guarded(spark, sf):
    """The same through a snapshot, its check and its captured schema, a hook and the gate."""
    root = scratch_path(spark, "guarded")
    snapshot.snapshot(v.people_tables(spark, sf), f"{root}/snap", host="h1", database="crm")
    hook = {"sql": "SELECT * FROM nation", "into": "nation"}
    return masked_counts(gate.guarded_restore(
        spark, f"{root}/snap", f"{root}/clone", v.MANIFEST, f"{root}/report", seed=v.SEED, db_hooks=[hook],
        json_columns=["people.prefs"], audit_path=f"{root}/audit"))


@query("v13_gate_active", """SELECT host, type FROM hosts WHERE (coalesce(required, false)
    OR coalesce(n_required_for, 0) > 0) AND host IN (SELECT host FROM manifests)""", "hosts", "manifests")
def v13(spark, sf):
    return verify.gate_active(v.hosts(spark, sf), v.manifests(spark, sf)).select("host", "type")


@query("v15_restore_drill", """SELECT e."table", coalesce(c.rows, 0) AS rows, e.min_rows, e.snapshot_rows,
      CASE WHEN c.rows IS NULL THEN 'missing' WHEN c.rows < e.min_rows THEN 'too_few'
        WHEN c.rows <> e.snapshot_rows THEN 'count_differs' ELSE 'ok' END AS status
    FROM (SELECT 'orders' AS "table", 1::BIGINT AS min_rows, count(*) AS snapshot_rows FROM orders
      UNION ALL SELECT 'customer', 1, count(*) FROM customer
      UNION ALL SELECT 'lineitem', 1, NULL FROM lineitem WHERE false
      UNION ALL SELECT 'labels', 1, NULL) e
    LEFT JOIN (SELECT 'orders' AS "table", count(*) AS rows FROM orders_kept
      UNION ALL SELECT 'customer', count(*) FROM customer) c ON e."table" = c."table" """, "orders_kept")
def v15(spark, sf):
    orders, customer = v.table(spark, sf, "orders"), v.table(spark, sf, "customer")

    def counted(name, df, column):
        return df.agg(F.count("*").alias(column)).select(F.lit(name).alias("table"), column)

    counts = counted("orders", v.orders_kept(spark, sf), "rows").unionByName(
        counted("customer", customer, "rows"))
    expected = counted("orders", orders, "snapshot_rows").unionByName(
        counted("customer", customer, "snapshot_rows")).unionByName(
        local_rows(spark, [("labels", None)], "table string, snapshot_rows bigint"))
    return verify.restore_drill(counts, expected.withColumn("min_rows", F.lit(1).cast("bigint")))


@query("v15_locate_differences", """SELECT c_custkey, CASE WHEN c_custkey < 0 THEN 'added' WHEN c_custkey % 89 = 5 THEN 'lost' ELSE 'changed' END AS difference
    FROM (SELECT c_custkey FROM customer WHERE c_custkey % 89 = 5 OR c_custkey % 97 = 3
      UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey % 101 = 7)""")
def v15_locate(spark, sf):
    """A copy with changed, lost and added rows, told by key."""
    source = v.table(spark, sf, "customer")
    changed = source.filter("c_custkey % 89 != 5").withColumn(
        "c_name", F.when(F.col("c_custkey") % 97 == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    added = source.filter("c_custkey % 101 = 7").withColumn("c_custkey", -F.col("c_custkey"))
    return verify.locate_differences(source, changed.unionByName(added), ["c_custkey"])


@query("v16_mask_stability", """SELECT count(*) AS "values",
      count(*) FILTER (WHERE a.s IS NOT NULL AND b.s IS NOT NULL) AS shared, 0::BIGINT AS unstable
    FROM (SELECT DISTINCT email AS s FROM people) a
    FULL JOIN (SELECT DISTINCT contact_email AS s FROM orders_p) b ON a.s = b.s""", "people", "orders_p")
def v16(spark, sf):
    people = v.people(spark, sf).withColumn("fake", masks.fake_email("email", v.SEED))
    orders = v.orders_p(spark, sf).withColumn("email", F.col("contact_email")).withColumn(
        "fake", masks.fake_email("email", v.SEED))
    return verify.mask_stability(people, orders, "email", "fake")


@query("m12_roundtrip_equal", """SELECT 'people' AS "table", true AS equal UNION ALL SELECT 'orders_p', true""")
def m12_equal(spark, sf):
    """Two maskings of the same data are equal row by row."""
    first = masking.mask_dataset(v.people_tables(spark, sf), v.MANIFEST, v.SEED)
    again = masking.mask_dataset(v.people_tables(spark, sf), v.MANIFEST, v.SEED)
    pick = ("people", "orders_p")
    return roundtrip({t: first[t] for t in pick}, {t: again[t] for t in pick}).select("table", "equal")
