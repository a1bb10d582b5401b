import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tablecloak.functions import masks
from tablecloak.operators import masking, verify
from tablecloak.operators.verify import sniff_report

SEED = "test-salt-12345"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, "tom@corp.example", "+15551234567", "a long biography", "1990-05-01"),
         (2, "alice@example.org", "+19998887766", "short", None),
         (3, None, None, None, "2000-02-29")],
        "id bigint, email string, phone string, bio string, dob string").withColumn(
        "dob", F.to_date("dob"))


COLUMNS = {"email": {"strategy": "fake_email"}, "phone": {"strategy": "fake_phone"},
           "bio": {"strategy": "truncate", "length": 8}, "dob": {"strategy": "shift_date", "max_days": 30}}


def test_hash_is_md5_of_seed_and_text(users):
    got = {r["id"]: r["h"] for r in users.select("id", masks.seeded_hash("email", SEED).alias("h")).collect()}
    assert got == {1: md5(SEED + "tom@corp.example"), 2: md5(SEED + "alice@example.org"), 3: None}


def test_fakes(users):
    r = users.filter("id = 2").select(
        masks.fake_email("email", SEED, "x.test").alias("e"), masks.fake_phone("phone", SEED).alias("p"),
        masks.fake_name("email", SEED).alias("n"), masks.fake_ip("email", SEED).alias("i")).first()
    h = md5(SEED + "alice@example.org")
    assert r["e"] == h + "@x.test"
    assert r["p"] == "+1555" + md5(SEED + "+19998887766")[:7]
    assert r["n"] == "Person_" + h
    assert r["i"] == f"192.0.2.{int(h[:8], 16) % 255}"


def test_same_value_same_fake_across_columns_and_runs(users):
    both = users.select(masks.fake_email("email", SEED).alias("a")).collect()
    again = users.select(masks.fake_email(F.col("email").alias("other"), SEED).alias("a")).collect()
    assert both == again


def test_shift_stays_in_range_and_keeps_null(spark):
    df = spark.range(500).select("id", F.lit("2020-01-01").cast("date").alias("d"))
    out = df.select(F.datediff(masks.shift_date("d", SEED, 3), F.col("d")).alias("n"))
    assert {r["n"] for r in out.distinct().collect()} == set(range(-3, 4))
    empty = df.withColumn("d", F.lit(None).cast("date")).select(masks.shift_date("d", SEED, 3).alias("d"))
    assert empty.filter("d IS NOT NULL").count() == 0


def test_shift_timestamp_keeps_time_of_day(spark):
    df = spark.sql("SELECT 1L AS id, timestamp_ntz'2020-01-01 13:14:15' AS t")
    out = df.select(masks.shift_date("t", SEED, 9, data_type="timestamp_ntz").alias("t"))
    assert out.schema["t"].dataType.simpleString() == "timestamp_ntz"
    assert out.first()["t"].strftime("%H:%M:%S") == "13:14:15"


def test_redact(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, c string")
    assert [r["c"] for r in df.select(masks.redact().alias("c")).collect()] == [None, None]
    assert [r["c"] for r in df.select(masks.redact("string", "z").alias("c")).collect()] == ["z", "z"]


def test_mask_table_keeps_schema_and_uses_original_values(users):
    spec = dict(COLUMNS, id={"strategy": "redact"})
    out = masking.mask_table(users, spec, SEED)
    assert out.columns == users.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in users.schema]
    moved = {r["email"]: r["dob"] for r in out.collect()}
    plain = {r["email"]: r["dob"] for r in masking.mask_table(users, COLUMNS, SEED).collect()}
    assert moved == plain  # the shift saw the unmasked id


def test_mask_table_rejects_unknown_columns_and_types(users):
    with pytest.raises(ValueError, match="gone"):
        masking.mask_table(users, {"gone": {"strategy": "redact"}}, SEED)
    with pytest.raises(TypeError):
        masking.mask_table(users, {"id": {"strategy": "fake_email"}}, SEED)
    with pytest.raises(ValueError, match="unknown"):
        masking.mask_table(users, {"email": {"strategy": "scramble"}}, SEED)


def test_no_pii_and_undeclared_tables_pass(users):
    manifest = {"tables": {"a": {"no_pii": True, "reason": "r"}, "b": {"columns": COLUMNS}}}
    out = masking.mask_dataset({"a": users, "b": users, "c": users}, manifest, SEED)
    assert out["a"] is users and out["c"] is users and out["b"] is not users


def test_sniff_zero_after_and_positive_before(users):
    manifest = {"tables": {"users": {"columns": COLUMNS}}}
    before = {r["column"]: r["sniff_count"] for r in sniff_report({"users": users}, manifest).collect()}
    # the first phone starts like a fake one, so its check passes unmasked
    assert before == {"bio": 1, "dob": 0, "email": 2, "phone": 1}
    masked = masking.mask_dataset({"users": users}, manifest, SEED)
    report = sniff_report(masked, manifest)
    assert all(r["pass"] and r["sniff_count"] == 0 for r in report.collect())
    assert verify.gate_ok(report).first()["ok"]


def test_sniff_fails_closed(users):
    manifest = {"tables": {"users": {"columns": {"gone": {"strategy": "redact"}, "id": {"strategy": "fake_email"}}},
                           "nowhere": {"columns": {"x": {"strategy": "redact"}}}}}
    got = {(r["table"], r["column"]): (r["sniff_count"], r["pass"])
           for r in sniff_report({"users": users}, manifest).collect()}
    assert set(got.values()) == {(-1, False)} and len(got) == 3
    assert sniff_report({"users": users.limit(0)}, manifest).filter("pass").count() == 0


def test_redact_replacement_sniff_counts_null(spark):
    df = spark.createDataFrame([("z",), (None,), ("y",)], "c string")
    assert verify.sniff(df, "c", {"strategy": "redact", "replacement": "z"}).first()[0] == 2
    assert verify.sniff(df, "c", {"strategy": "redact"}).first()[0] == 2


PATHS = {"$.contact.email": "fake_email", "$.contact.phone": "redact", "$.n": "passthrough", "$.gone": "fake_ip"}


def test_json_paths(spark):
    texts = ['{"contact":{"email":"a@b.co","phone":"1"},"n":7,"z":[1,{"q":null}]}', None,
             '{"contact":{"email":null}}', '{"contact":"text"}', '[1,2]', '{"other":{"email":"a@b.co"}}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    out = [r["o"] for r in df.select(masking.json_scrub_paths("j", PATHS, SEED).alias("o")).collect()]
    fake = [f"{md5(SEED + t)}@masked.test" if t else None for t in texts]
    assert json.loads(out[0]) == {"contact": {"email": fake[0], "phone": None}, "n": 7, "z": [1, {"q": None}]}
    assert out[1] is None
    assert json.loads(out[2]) == {"contact": {"email": fake[2]}}
    assert [json.loads(x) for x in out[3:]] == [json.loads(t) for t in texts[3:]]


def test_json_paths_overlap_and_strictness(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"}}',), ("broken",)], "j string")
    good, bad = df.filter("j <> 'broken'"), df.filter("j = 'broken'")
    both = masking.json_scrub_paths("j", {"$.a.b": "fake_name", "$.a": "redact"}, SEED)
    assert good.select(both).first()[0] == '{"a":null}'
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        bad.select(masking.json_scrub_paths("j", {"$.a": "redact"}, SEED)).collect()
    loose = masking.json_scrub_paths("j", {"$.a": "redact"}, SEED, strict=False)
    assert bad.select(loose).first()[0] is None
    with pytest.raises(ValueError):
        masking.json_scrub_paths("j", {"$.a": "truncate"}, SEED)


def test_json_sniff_is_or_over_paths(spark):
    df = spark.createDataFrame([('{"contact":{"email":"a@b.co"}}',), ('{"contact":{"phone":"1"}}',),
                                ('{"contact":{"phone":null}}',), (None,)], "j string")
    spec = {"strategy": "jsonb_scrub_paths", "paths": PATHS}
    assert verify.sniff(df, "j", spec).first()[0] == 2
    assert verify.sniff(df, "j", {"strategy": "jsonb_scrub_paths", "paths": {}}).first()[0] == 0
    odd = spark.createDataFrame([("no json",), ('{"contact":{"email":5}}',), ('{"contact":{"email":{"a":1}}}',),
                                 ('{"contact":"x"}',), ('[]',)], "j string")
    assert verify.sniff(odd, "j", spec).first()[0] == 3
    assert verify.sniff(df.select(F.parse_json("j").alias("j")), "j", spec).first()[0] == 2


def test_text_sanitize_matches_the_plain_patterns(spark):
    texts = ["mail a.b+c@ex-ample.co.uk now", "a@b.com_x@c.org,@d.com", "a@b.co a@b a@@b.co x@y.z1.com",
             "call +15551234567 or +155512345678", "no match", "a@a@a@b.com", "..@..", "é@b.com ü.x@d.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.regexp_replace(F.regexp_replace(
        "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "redacted@example.com"),
        r"\+1[0-9]{10}", "+15550000000")
    want = [r[0] for r in df.orderBy("i").select(plain).collect()]
    got = [r["t"] for r in masking.text_sanitize(df, "t").orderBy("i").collect()]
    assert got == want


def test_text_sanitize_long_run_is_linear(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 300_000), F.lit(" x@y.org")).alias("t"))
    assert masking.text_sanitize(df, "t").first()["t"].endswith(" redacted@example.com")


def test_redact_literal_is_no_pattern(spark):
    secret = "s+e[e]d.with*meta$chars"
    df = spark.createDataFrame([(f"x {secret} y {secret}",), ("seed",)], "t string")
    got = [r["t"] for r in masking.redact_literal(df, "t", secret).collect()]
    assert got == ["x <SCRUB_SEED_REDACTED> y <SCRUB_SEED_REDACTED>", "seed"]
    assert masking.redact_literal(df, "t", "") is df


def test_mask_stability(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string")
    masked = a.withColumn("m", masks.fake_name("s", SEED))
    other = a.withColumn("m", masks.fake_name("s", "another"))
    assert tuple(verify.mask_stability(masked, masked, "s", "m").first()) == (2, 2, 0)
    assert tuple(verify.mask_stability(masked, other, "s", "m").first()) == (2, 2, 2)


def test_gate_active(spark):
    hosts = spark.createDataFrame(
        [("a", True, None), ("b", None, None), ("c", None, ["staging"]), ("d", None, []), ("e", True, None)],
        "host string, required boolean, required_for array<string>")
    manifests = spark.createDataFrame([(h,) for h in "abcd"], "host string")
    assert {r["host"] for r in verify.gate_active(hosts, manifests).collect()} == {"a", "c"}


def test_restore_drill(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 0), ("c", 5)], "table string, rows bigint")
    expected = spark.createDataFrame([("a", 1, 3), ("b", 1, None), ("c", 1, 6), ("d", 1, 1)],
                                     "table string, min_rows bigint, snapshot_rows bigint")
    drill = verify.restore_drill(counts, expected)
    assert {r["table"]: r["status"] for r in drill.collect()} == {
        "a": "ok", "b": "too_few", "c": "count_differs", "d": "missing"}
    assert not verify.drill_passed(drill).first()["ok"]
    assert verify.drill_passed(drill.filter("status = 'ok'")).first()["ok"]
