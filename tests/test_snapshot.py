import json
import logging
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablecloak.operators import hooks, verify
from tablecloak.plans import gate
from tablecloak.sources import readers
from tablecloak.sources import snapshot as s


@pytest.fixture
def tables(spark):
    return {"t": spark.range(3).selectExpr("cast(id AS int) AS id", "concat('v', id) AS val"),
            "u": spark.range(5).selectExpr("id", "cast(NULL AS string) AS note")}


def counts(spark, path):
    return {r["table"]: r["rows"] for r in s.snapshot_counts(spark, path).collect()}


@pytest.mark.parametrize("mode,want,schema", [("full", {"t": 3, "u": 5}, True), ("schema", {"t": 0, "u": 0}, True),
                                              ("data", {"t": 3, "u": 5}, False)])
def test_modes(spark, tables, tmp_path, mode, want, schema):
    path = s.snapshot(tables, str(tmp_path / "snap"), mode=mode, host="h", database="d")
    assert counts(spark, path) == want
    meta = spark.read.json(f"{path}/_meta").first().asDict()
    assert meta["backup_mode"] == mode and ("scrub_schema" in meta) is schema
    if schema:
        assert json.loads(meta["scrub_schema"])["tables"]["t"]["columns"]["id"]["type"] == "int"
    assert [f.name for f in s.read_snapshot(spark, path)["t"].schema] == ["id", "val"]
    assert not [p for p in tmp_path.iterdir() if ".part-" in p.name]


def test_unknown_mode_and_existing_target(tables, tmp_path):
    with pytest.raises(ValueError):
        s.snapshot(tables, str(tmp_path / "snap"), mode="half")
    s.snapshot(tables, str(tmp_path / "snap"))
    with pytest.raises(FileExistsError):
        s.snapshot(tables, str(tmp_path / "snap"))
    assert [p.name for p in tmp_path.iterdir()] == ["snap"]


def test_exclusions(spark, tables, tmp_path):
    assert counts(spark, s.snapshot(tables, str(tmp_path / "snap"), exclude=["u"])) == {"t": 3, "u": 0}


def test_exclusions_cascade(spark, tables, tmp_path):
    edges = spark.createDataFrame([("t", "u"), ("x", "t")], "child string, parent string")
    path = s.snapshot(tables, str(tmp_path / "snap"), exclude=["u"], fk_edges=edges)
    assert counts(spark, path) == {"t": 0, "u": 0}


def test_publish_never_nests(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(2).write.parquet(f"{tmp_path}/{name}")
    s.publish_atomically(spark, f"{tmp_path}/a", f"{tmp_path}/new/final")
    with pytest.raises(FileExistsError):
        s.publish_atomically(spark, f"{tmp_path}/b", f"{tmp_path}/new/final")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileExistsError):
        s.publish_atomically(spark, f"{tmp_path}/b", f"{tmp_path}/empty")
    with pytest.raises(OSError):
        s.publish_atomically(spark, f"{tmp_path}/nothing", f"{tmp_path}/other")
    assert spark.read.parquet(f"{tmp_path}/new/final").count() == 2
    assert (tmp_path / "b").exists() and not (tmp_path / "a").exists()


def test_snapshots_list_themselves_and_are_logged(spark, tables, tmp_path):
    log = str(tmp_path / "log")
    for stamp in ("20240101_000000", "20240102_000000"):
        s.snapshot(tables, f"{tmp_path}/root/h/d/{stamp}", host="h", database="d", timestamp=stamp, audit_path=log)
    with pytest.raises(FileExistsError):
        s.snapshot(tables, f"{tmp_path}/root/h/d/20240102_000000", host="h", database="d", audit_path=log)
    (tmp_path / "root/h/d/20240103_000000/t").mkdir(parents=True)  # no sidecar: not complete
    rows = s.snapshot_catalog(spark, f"{tmp_path}/root").orderBy("mtime").collect()
    assert [(r["host"], r["database"], r["file"], str(r["mtime"])) for r in rows] == [
        ("h", "d", "20240101_000000", "2024-01-01 00:00:00"), ("h", "d", "20240102_000000", "2024-01-02 00:00:00")]
    assert all(r["size"] > 0 and r["path"].endswith(r["file"]) for r in rows)
    lines = readers.read_audit(spark, log).collect()
    assert sorted((r["action"], r["outcome"], r["db_host"]) for r in lines) == [
        ("backup", "failure", "h"), ("backup", "success", "h"), ("backup", "success", "h")]
    assert [int(r["size"]) for r in lines if r["outcome"] == "success"] == [r["size"] for r in rows]
    assert s.apply_retention(s.snapshot_catalog(spark, f"{tmp_path}/root").filter("file < '20240102'"), False) == 1
    assert [r["file"] for r in s.snapshot_catalog(spark, f"{tmp_path}/root").collect()] == ["20240102_000000"]


def test_a_hook_that_fails_at_run_time_stops_there(spark, users):
    good = {"sql": "SELECT 1 AS one", "into": "made"}
    bad = {"sql": "SELECT raise_error('boom') AS x FROM users", "into": "late"}
    with pytest.raises(hooks.HookError, match=r"hook 1 \(host\)") as e:
        hooks.apply_hooks(spark, users, [good, bad, good], [], {})
    assert set(e.value.tables) == {*users, "made"}
    assert not spark.catalog.tableExists("users")


def test_failed_write_leaves_nothing(spark, tables, tmp_path):
    bad = dict(tables, x=spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x")))
    with pytest.raises(Exception, match="boom"):
        s.snapshot(bad, str(tmp_path / "snap"))
    assert list(tmp_path.iterdir()) == []


def test_restore_is_equal_and_checked(spark, tables, tmp_path):
    path = s.snapshot(tables, str(tmp_path / "snap"))
    copies = s.restore(spark, path, str(tmp_path / "clone"))
    assert all(r["equal"] for r in s.roundtrip(tables, copies).collect())
    assert s.roundtrip(tables, dict(copies, t=copies["u"])).filter("NOT equal").count() == 1
    assert {r["status"] for r in s.verify_snapshot(spark, path).collect()} == {"ok"}
    for part in [p for p in Path(path, "t").iterdir() if p.suffix == ".parquet"]:  # no footer left
        part.write_bytes(part.read_bytes() + b"x")
        Path(path, "t", f".{part.name}.crc").unlink()
    next(p for p in Path(path, "u").iterdir() if p.suffix == ".parquet").unlink()
    got = sorted(r["status"] for r in s.verify_snapshot(spark, path).collect())
    assert "mismatch" in got and "missing" in got
    with pytest.raises(OSError, match="digest"):
        s.restore(spark, path, str(tmp_path / "clone2"))
    assert not Path(tmp_path, "clone2").exists()


def test_incomplete_snapshot_is_refused(spark, tables, tmp_path):
    tables["t"].write.parquet(str(tmp_path / "half" / "t"))
    with pytest.raises(FileNotFoundError):
        s.read_snapshot(spark, str(tmp_path / "half"))


def test_snapshot_all_goes_on(spark, tables, tmp_path):
    bad = {"x": spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))}
    out = s.snapshot_all(spark, {"a": tables, "b": bad, "c": tables}, str(tmp_path))
    assert {r["database"]: r["outcome"] for r in out.collect()} == {"a": "success", "b": "failure", "c": "success"}
    assert out.filter("error LIKE '%boom%'").count() == 1


def test_a_retention_that_stops_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root, journal = tmp_path / "root", str(tmp_path / "journal")
    for n in "abcd":
        (root / n / "t").mkdir(parents=True)
        (root / n / "t" / "f").write_text("x")
        (root / n / s.META).write_text("{}")
    marked = spark.createDataFrame([(f"file://{root}/{n}",) for n in "abc"], "path string")
    real, calls = s.delete_path, []

    def stops(spark_, path):
        calls.append(path)
        if len(calls) == 4:
            raise OSError("the machine is gone")
        return real(spark_, path)

    monkeypatch.setattr(s, "DELETERS", 1)
    monkeypatch.setattr(s, "delete_path", stops)
    with pytest.raises(OSError):
        s.apply_retention(marked, dry_run=False, journal=journal)
    left = [n for n in "abc" if (root / n / "t").exists()]
    assert left and not any((root / n / s.META).exists() and not (root / n / "t").exists() for n in "abc")
    monkeypatch.setattr(s, "delete_path", real)
    assert s.apply_retention(marked.limit(0), dry_run=False, journal=journal) == 0
    assert [p.name for p in sorted(root.iterdir())] == ["d"]
    assert s.finish_retention(spark, journal) == 0


def test_retention_deletes_snapshots_and_sidecars(spark, tmp_path):
    for n in ("a", "b"):
        for suffix in ("", ".meta.json"):
            (tmp_path / f"{n}.sql.zst{suffix}").write_text("x")
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "f").write_text("x")
    marked = spark.createDataFrame([(f"file://{tmp_path}/a.sql.zst",), (f"file://{tmp_path}/dir",),
                                    (f"file://{tmp_path}/gone",)], "path string")
    assert s.apply_retention(marked) == 3 and (tmp_path / "a.sql.zst").exists()
    assert s.apply_retention(marked, dry_run=False) == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.sql.zst", "b.sql.zst.meta.json"]
    assert s.apply_retention(marked, dry_run=False) == 3  # a repeated run is safe


MANIFEST = {"version": 1, "seed_env": "S", "tables": {
    "users": {"columns": {"email": {"strategy": "fake_email"}, "bio": {"strategy": "truncate", "length": 8}}}}}


@pytest.fixture
def users(spark):
    return {"users": spark.createDataFrame([(1, "tom@corp.example", "a long text"), (2, None, None)],
                                           "id int, email string, bio string")}


def report(path):
    return json.loads(next(p for p in Path(path, "scrub_report", "summary").iterdir()
                           if p.suffix == ".txt").read_text())


def names(path):
    return sorted(p.name for p in Path(path).iterdir() if not p.name.startswith("."))


def test_gate_publishes_verified_copies(users, tmp_path):
    out = gate.scrub_gate(users, MANIFEST, f"{tmp_path}/clone", f"{tmp_path}/report", seed="s1", host="h")
    assert out["users"].filter("email = 'tom@corp.example' OR length(bio) > 8").count() == 0
    body = report(f"{tmp_path}/report")
    assert body["ok"] is True and body["host"] == "h"
    assert names(tmp_path) == ["clone", "report"]


def test_gate_stops_on_drift(spark, users, tmp_path):
    users["users"] = users["users"].withColumn("backup_email", F.lit("x"))
    with pytest.raises(gate.GateError, match="drift") as e:
        gate.scrub_gate(users, MANIFEST, f"{tmp_path}/clone", f"{tmp_path}/report", seed="s1")
    assert e.value.phase == "drift" and report(f"{tmp_path}/report") == {"ok": False, "phase": "drift"}
    assert names(tmp_path) == ["report"]
    assert spark.read.json(f"{tmp_path}/report/scrub_report/findings").first()["column"] == "backup_email"


def test_gate_stops_on_a_failing_mask_without_telling_the_seed(users, tmp_path):
    users["users"] = users["users"].withColumn("bio", F.raise_error(F.lit("about s1-secret")).cast("string"))
    with pytest.raises(gate.GateError) as e:
        gate.scrub_gate(users, MANIFEST, f"{tmp_path}/clone", f"{tmp_path}/report", seed="s1-secret")
    assert e.value.phase == "update" and "s1-secret" not in str(e.value)
    assert names(tmp_path) == ["report"]


def test_gate_stops_on_a_broken_post_condition(users, tmp_path, monkeypatch):
    monkeypatch.setattr(gate, "mask_dataset", lambda tables, *a: dict(tables))
    with pytest.raises(gate.GateError) as e:
        gate.scrub_gate(users, MANIFEST, f"{tmp_path}/clone", f"{tmp_path}/report", seed="s1")
    assert e.value.phase == "sniff" and report(f"{tmp_path}/report")["phase"] == "sniff"
    assert names(tmp_path) == ["report"]


def test_seed():
    with pytest.raises(gate.GateError, match="seed"):
        gate.seed_of(MANIFEST, {})
    assert gate.seed_of(MANIFEST, {"S": "x"}) == "x"
    logging.getLogger("tablecloak").setLevel(logging.ERROR)
    assert gate.seed_of({"tables": {}}, {}) == ""


VARS = {"target_db": "clone", "source_host": "h", "source_db": "d", "backup_file": "f",
        "backup_timestamp": "t", "restored_at": "r"}


def test_hooks_run_in_order_with_variables(spark, users, tmp_path):
    (tmp_path / "hook.sql").write_text("SELECT *, :source_db AS db FROM users")
    out = hooks.apply_hooks(spark, users, [{"sql": "SELECT id, email FROM users WHERE id = 1", "into": "users"}],
                            [{"file": "hook.sql", "into": "users"}, {"sql": "SELECT count(*) AS n FROM users", "into": "stats"}],
                            VARS, base_dir=str(tmp_path))
    assert [tuple(r) for r in out["users"].collect()] == [(1, "tom@corp.example", "d")]
    assert out["stats"].first()["n"] == 1


def test_hooks_stop_at_the_first_failure(spark, users):
    good = {"sql": "SELECT id FROM users", "into": "users"}
    bad = {"sql": "SELECT nothing FROM users", "into": "users"}
    with pytest.raises(hooks.HookError, match=r"hook 1 \(db\)") as e:
        hooks.apply_hooks(spark, users, [good], [bad, good], VARS)
    assert e.value.tables["users"].columns == ["id"]
    for entry in ({"into": "x"}, {"sql": "a", "file": "b", "into": "x"}, {"file": "/none.sql", "into": "x"}):
        with pytest.raises(hooks.HookError):
            hooks.apply_hooks(spark, users, [entry], [], VARS)
    with pytest.raises(hooks.HookError, match="prod"):
        hooks.apply_hooks(spark, users, [good], [], VARS, safety="prod")
    assert hooks.apply_hooks(spark, users, [], [], VARS, safety="prod") == users


def test_guarded_restore(spark, users, tmp_path):
    path = s.snapshot(users, f"{tmp_path}/snap")
    out = gate.guarded_restore(spark, path, f"{tmp_path}/clone", MANIFEST, f"{tmp_path}/report", seed="s1",
                               host_hooks=[{"sql": "SELECT * FROM users WHERE id = 1", "into": "users"}])
    assert out["users"].count() == 1
    assert verify.sniff_report(out, MANIFEST).filter("NOT pass").count() == 0


def test_guarded_restore_checks_the_captured_schema_and_keeps_a_log(spark, users, tmp_path, rows):
    log = f"{tmp_path}/audit"
    old = s.snapshot(users, f"{tmp_path}/old", mode="data")
    good = s.snapshot(users, f"{tmp_path}/good")
    bad = s.snapshot({"users": users["users"].withColumn("phone", F.lit("1"))}, f"{tmp_path}/bad")
    assert [gate.preflight(spark, p, MANIFEST) for p in (old, good, bad)] == ["deferred", "clean", "drift"]
    assert gate.preflight(spark, good, {"tables": {}}, ["users.bio"]) == "drift"
    broken = [{"sql": "SELECT nothing FROM users", "into": "users"}]
    with pytest.raises(gate.GateError, match="drift"):  # before any hook runs
        gate.guarded_restore(spark, bad, f"{tmp_path}/c1", MANIFEST, f"{tmp_path}/r", seed="s", host_hooks=broken,
                             audit_path=log)
    gate.guarded_restore(spark, good, f"{tmp_path}/c2", MANIFEST, f"{tmp_path}/r", seed="s", audit_path=log)
    assert rows(readers.read_audit(spark, log), "action", "outcome", "target_db") == [
        ("restore", "failure", f"{tmp_path}/c1"), ("restore", "success", f"{tmp_path}/c2")]


def test_transform(spark, users):
    assert hooks.transform(users["users"], lambda df: df.limit(1)).count() == 1
    with pytest.raises((TypeError, AssertionError)):
        hooks.transform(users["users"], lambda df: None)

    def upper(batches):
        for b in batches:
            yield b.assign(bio=b["bio"].str.upper())[["id", "bio"]]

    out = hooks.transform_batches(users["users"], upper, "id int, bio string")
    assert [r["bio"] for r in out.orderBy("id").collect()] == ["A LONG TEXT", None]
    assert hooks.stamp_provenance(users["users"], VARS).first()["target_db"] == "clone"


def test_hidden_names_come_back(spark, tmp_path, rows):
    tables = {"_migrations": spark.range(3), ".dot": spark.range(2), "a b%c": spark.range(1), "users": spark.range(4)}
    s.snapshot(tables, str(tmp_path / "s"))
    copies = s.restore(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert {t: df.count() for t, df in copies.items()} == {"_migrations": 3, ".dot": 2, "a b%c": 1, "users": 4}


def test_foreign_files_are_refused(spark, tmp_path):
    s.snapshot({"users": spark.range(3)}, str(tmp_path / "s"))
    spark.range(5).write.mode("append").parquet(str(tmp_path / "s" / "users"))
    with pytest.raises(OSError, match="have none"):
        s.restore(spark, str(tmp_path / "s"), str(tmp_path / "t"))


def test_places_of_nulls_count(spark):
    one = spark.createDataFrame([("a", None)], "x string, y string")
    two = spark.createDataFrame([(None, "a")], "x string, y string")
    assert [r["equal"] for r in s.roundtrip({"t": one}, {"t": two}).collect()] == [False]


def test_hooks_leave_the_views_of_the_user(spark):
    users = spark.createDataFrame([(1,), (2,)], "id int")
    spark.createDataFrame([(9,)], "id int").createOrReplaceTempView("users")
    out = hooks.apply_hooks(spark, {"Users": users}, [{"sql": "SELECT * FROM users WHERE id > 1", "into": "big"}], [], {})
    assert [r.id for r in out["big"].collect()] == [2]
    assert [r.id for r in spark.table("users").collect()] == [9]
    spark.catalog.dropTempView("users")
    with pytest.raises(hooks.HookError):
        hooks.apply_hooks(spark, {"users": users}, [{"sql": "SELECT nothing FROM users", "into": "x"}], [], {})
    assert not spark.catalog.tableExists("users")
