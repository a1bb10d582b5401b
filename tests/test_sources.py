import gzip
import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablecloak import session
from tablecloak.operators import audit
from tablecloak.plans.queries import QUERIES
from tablecloak.sources import digests, readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, x in keys.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("a.sql", 100), ("b.sql", 1), ("c.sql", 57)):
        texts = [f"{name} line {i}" + "x" * (i % 13) for i in range(n)]
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        want.update({(name, i + 1): t for i, t in enumerate(texts)})
    df = readers.read_dump_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in df.collect()}
    assert got == want


def test_only_newline_ends_a_line_and_bytes_survive(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"one\rstill one\n\xff\xfe bytes\n\nlast")
    with gzip.open(tmp_path / "b.sql.gz", "wb") as f:
        f.write(b"x\ny\n")
    got = readers.read_dump_lines(spark, str(tmp_path)).orderBy("file", "line_no")
    assert [(r["n"], r["h"]) for r in got.select(F.col("line_no").alias("n"), F.hex(F.col("line").cast("binary")).alias("h")).collect()] == [
        (1, b"one\rstill one".hex().upper()), (2, b"\xff\xfe bytes".hex().upper()), (3, ""), (4, b"last".hex().upper()),
        (1, b"x".hex().upper()), (2, b"y".hex().upper())]


def test_catalog_from_files(spark, tmp_path, rows):
    def put(path, body="x"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)

    put("prod/app/app_20240101_000000.sql.zst", "12345")
    put("prod/app/app_20240101_000000.sql.zst.meta.json", '{"host":"prod"}')
    put("prod/app/app_20240102_000000.sql.zst.age")
    put("prod/app/.app_20240103.sql.zst.partial")
    put("-bad/app/app_20240101_000000.sql.zst")
    put("dev/x/x_20240101_000000.sql.zst.gpg")
    hosts = spark.createDataFrame([("prod", "prod")], "host string, safety string")
    df = readers.backup_catalog(readers.list_files(spark, str(tmp_path)), hosts)
    assert rows(df, "host", "database", "file", "size", "complete", "encryption", "safety") == [
        ("dev", "x", "x_20240101_000000.sql.zst.gpg", 1, False, "gpg", "local"),
        ("prod", "app", "app_20240101_000000.sql.zst", 5, True, "none", "prod"),
        ("prod", "app", "app_20240102_000000.sql.zst.age", 1, False, "age", "prod")]


def test_sidecars(spark, tmp_path):
    good = {"host": "h", "database": "d", "size": 5, "checksums": {"sha256": "abc"}, "source_extensions": ["x"],
            "scrub_schema": {"tables": {"t": {"columns": {"a": {"type": "int", "nullable": False}, "b": {"type": "json"}}}}}}
    (tmp_path / "a.meta.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b.meta.json").write_text("{broken")
    (tmp_path / "c.meta.json").write_text('{"timestamp":"t","source_flavor":"postgres"}')
    df = readers.read_sidecars(spark, str(tmp_path))
    got = {r["sidecar_path"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert got["a.meta.json"]["checksums"]["sha256"] == "abc"
    assert got["b.meta.json"]["host"] is None and got["c.meta.json"]["source_flavor"] == "postgres"
    columns = readers.explode_captured_schema(df.filter("host IS NOT NULL"))
    assert sorted(map(tuple, columns.collect())) == [("h", "t", "a", "int", False), ("h", "t", "b", "json", True)]


def test_audit_skips_bad_lines(spark, tmp_path):
    (tmp_path / "audit.log").write_text(
        '{"timestamp":"2026-05-01T10:00:00Z","action":"backup","duration_sec":"42","extra":1}\n\n'
        'this is not json\n[1,2]\n"text"\n{"timestamp":"2026-05-02T10:00:00Z","action":"restore"}\n{"cut\n')
    got = readers.read_audit(spark, str(tmp_path / "audit.log"))
    assert [(r["seq"], r["action"], r["duration_sec"]) for r in got.orderBy("seq").collect()] == [
        (1, "backup", "42"), (6, "restore", None)]


def test_audit_order_runs_through_splits_and_files(spark, tmp_path, small_splits):
    for f in range(3):
        (tmp_path / f"audit.{f}.log").write_text("".join(
            f'{{"timestamp":"2026-05-01T00:00:{i:02d}Z","action":"backup","file":"{f}-{i}"}}\n' for i in range(40)))
    got = readers.read_audit(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["file"] for r in got] == [f"{f}-{i}" for f in range(3) for i in range(40)]
    assert [r["seq"] for r in got] == list(range(1, 121))
    newest = audit.audit_search(readers.read_audit(spark, str(tmp_path)), limit=2).collect()
    assert [r["file"] for r in newest] == ["2-39", "2-38"]


def test_column_catalog(spark, rows):
    t = spark.createDataFrame([], "id int, meta string")
    assert rows(readers.column_catalog({"t": t}, ["t.meta"]), "table", "column", "type", "ordinal") == [
        ("t", "id", "int", 0), ("t", "meta", "json", 1)]


def test_user_databases(spark, rows):
    df = spark.createDataFrame([("postgres",), ("template1",), ("sys",), ("app",), ("app",)], "database string")
    assert rows(readers.list_user_databases(df)) == [("app",)]


def test_scan_prunes_and_pushes(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id", "id * 2 AS twice", "id * 3 AS more").write.parquet(str(tmp_path / "t"))
    readers.scan_table(spark, str(tmp_path), "t").filter("twice > 4").select("id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(twice), GreaterThan(twice,4)]" in plan
    assert "ReadSchema: struct<id:bigint,twice:bigint>" in plan


def test_verify_files(spark, tmp_path):
    for n in "abcd":
        (tmp_path / f"{n}.bin").write_bytes(n.encode() * 1000)
    files = readers.list_files(spark, str(tmp_path))
    sha = hashlib.sha256(b"a" * 1000).hexdigest()
    side = files.select("path", F.element_at(F.split("path", "/"), -1).alias("n")).filter("n <> 'd.bin'").select(
        "path", F.when(F.col("n") == "a.bin", sha).when(F.col("n") == "b.bin", "0" * 64).alias("sha256"))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in digests.verify_files(files, side).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "no_checksum", "d.bin": "no_meta"}


def test_given_files_of_any_size_are_verified(spark, tmp_path):
    """A file longer than Spark reads as one value is digested piece by piece, also for what is expected of it."""
    for t in ("orders", "labels", "pages", "lineitem"):
        (tmp_path / f"{t}.parquet").write_bytes(t.encode() * 1000)
    os.truncate(tmp_path / "lineitem.parquet", digests.WHOLE_BYTES + 1)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "part.parquet").write_bytes(b"part")
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, str(digests.WHOLE_BYTES))
    try:
        got = {r["file"]: r["status"] for r in QUERIES["v14_verify_files"](spark, str(tmp_path)).collect()}
        digest = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in digests.file_digests(spark, [str(tmp_path)], recursive=False).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {"orders.parquet": "ok", "lineitem.parquet": "ok", "labels.parquet": "mismatch", "pages.parquet": "no_meta",
                   "part.parquet": "no_meta"}
    assert set(digest) == set(got) - {"part.parquet"}
    with (tmp_path / "lineitem.parquet").open("rb") as f:
        assert digest["lineitem.parquet"] == hashlib.file_digest(f, "sha256").hexdigest()


def test_large_and_small_files_have_equal_digests(spark, tmp_path, rows):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    whole = digests.folder_digests(spark, str(tmp_path))
    streamed = digests.folder_digests(spark, str(tmp_path), whole_bytes=1)
    assert rows(whole) == rows(streamed) and whole.count() == 3


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_content_checksum(spark, method):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")

    def total(df):
        return tuple(digests.content_checksum(df, method).first())

    assert total(a) == total(a.orderBy(F.desc("i")))
    assert total(a) != total(a.distinct()) and total(a) != total(a.withColumn("s", F.lit("")))
    assert total(a.limit(0)) == (0, "0")


def test_shared_folder_setting(spark):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


class FakeSession:
    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_folder_without_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert session.shared_root(local) == session.shared_root(local)


GATE_RUN = """
import sys
from tablecloak.plans.gate import scrub_gate
from tablecloak.session import build_session
root = sys.argv[1]
spark = build_session(master="local[2]", **{
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{root}/log", "spark.eventLog.compress": "false",
    "spark.checkpoint.dir": f"{root}/scratch", "spark.sql.shuffle.partitions": "2"})
users = spark.range(3).selectExpr("id", "concat('u', id, '@x.org') AS email", "date'2020-01-01' AS dob",
                                  "to_json(named_struct('a', id)) AS prefs")
manifest = {"tables": {"users": {"columns": {
    "email": {"strategy": "fake_email"}, "dob": {"strategy": "shift_date", "max_days": 9},
    "prefs": {"strategy": "jsonb_scrub_paths", "paths": {"$.a": "fake_name"}}}}}}
out = scrub_gate({"users": users}, manifest, f"{root}/clone", f"{root}/report", seed=sys.argv[2],
                 json_columns=["users.prefs"])
print("first", *out["users"].filter("id = 0").select("email", "prefs").first())
spark.stop()
"""


def test_the_seed_is_in_no_plan_and_no_event(tmp_path):
    """A gate in a session of its own with an event log, which must not hold the seed."""
    (tmp_path / "log").mkdir()
    done = subprocess.run([sys.executable, "-c", GATE_RUN, str(tmp_path), "Zeb.ra-77"], capture_output=True,
                          text=True, timeout=300, cwd=Path(__file__).parents[1])
    assert done.returncode == 0, done.stderr[-3000:]
    email, prefs = (hashlib.md5(f"Zeb.ra-77{x}".encode()).hexdigest() for x in ("u0@x.org", '{"a":0}'))
    assert f'first {email}@masked.test {{"a":"Person_{prefs}"}}' in done.stdout
    events = [p for p in (tmp_path / "log").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    text = "".join(p.read_text() for p in events)
    assert "SparkListenerSQLExecutionStart" in text and "Person_" in text
    # the command line of the process is this test's own way to hand the seed over
    lines = [x for x in text.splitlines() if '"SparkListenerEnvironmentUpdate"' not in x]
    assert not [x[:200] for x in lines if "Zeb" in x or "ra-77" in x]


@pytest.mark.parametrize("make", ["cast(pow(id, 3) AS bigint)", "IF(id % 3 = 0, 7, id)", "timestamp_micros(id * id * 1000000)",
                                  "date_add(DATE'2020-01-01', cast(id * id / 1000 AS int))", "cast(NULL AS int)"])
def test_balanced_ranges_hold_every_row_once(spark, make):
    df = spark.range(3000).selectExpr("id", f"IF(id % 50 = 1, NULL, {make}) AS k")
    sizes = [df.filter(p).count() for p in readers.balanced_predicates(df, "k", 6)]
    assert sum(sizes) == 3000
    if "IF" not in make and "NULL" not in make:
        assert len(sizes) == 6 and max(sizes) < 650
    assert readers.balanced_predicates(df.limit(0), "k") == ["1 = 1"]
