import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecloak.functions import scalars, schedules
from tablecloak.operators import audit as a

KEYS = ("seq", "timestamp", "action", "outcome", "db_host", "database", "duration_sec", "size", "file",
        "error", "target_db", "account")
TYPES = ", ".join(f"{k} {'bigint' if k == 'seq' else 'string'}" for k in KEYS)


def log(spark, *entries):
    base = {"action": "backup", "outcome": "success", "db_host": "prod", "database": "myapp"}
    data = []
    for i, e in enumerate(entries):
        full = {**base, "seq": i, "timestamp": f"2026-05-{i + 1:02d}T10:00:00Z", **e}
        data.append(tuple(full.get(k) for k in KEYS))
    return spark.createDataFrame(data, TYPES)


def test_last_duration(spark):
    def duration(*entries, action="backup"):
        r = a.last_duration(log(spark, *entries), action).filter(
            "true" if action != "backup" else "db_host = 'prod' AND database = 'myapp'").first()
        return r["duration_sec"] if r else None

    assert duration({"duration_sec": "60"}, {"duration_sec": "75"}, {"duration_sec": "101"}) == 101
    assert duration({"duration_sec": "60"}, {"duration_sec": "9999", "outcome": "failure"}, {"duration_sec": "75"}) == 75
    assert duration({"duration_sec": "60"}, {"duration_sec": "99", "db_host": "staging"}) == 60
    assert duration({"duration_sec": "60"}, {"duration_sec": "99", "database": "other"}) == 60
    assert duration({"duration_sec": "60"}, {"duration_sec": "soon"}, {}) == 60
    assert duration({"duration_sec": "60", "db_host": "x"}) is None
    assert duration({"duration_sec": "30", "action": "restore", "db_host": None},
                    {"duration_sec": "45", "action": "restore", "db_host": None}, action="restore") == 45


def test_last_size_takes_the_last_row_before_the_check(spark):
    one = a.last_size(log(spark, {"size": "100"}, {"size": "228000000"}, {}), "backup").first()
    assert one["size"] == 228000000
    assert a.last_size(log(spark, {"size": "100"}, {"size": "n/a"}), "backup").first()["size"] is None


def test_tail(spark):
    entries = [{"duration_sec": "5"}] + [{"action": "restore", "seq": 10 + i} for i in range(3)]
    df = log(spark, *entries)
    assert a.last_duration(df, "backup", tail_rows=3).count() == 0
    assert a.last_duration(df, "backup", tail_rows=None).count() == 1
    assert a.last_duration(df.limit(0), "backup").count() == 0


def test_search(spark):
    df = log(spark, {}, {"action": "restore", "target_db": "app_restore"}, {"outcome": "failure", "error": "boom"})
    assert [r["seq"] for r in a.audit_search(df).collect()] == [2, 1, 0]
    assert [r["seq"] for r in a.audit_search(df, limit=1).collect()] == [2]
    assert [r["seq"] for r in a.audit_search(df, action="backup", outcome="success").collect()] == [0]
    assert [r["seq"] for r in a.audit_search(df, from_ts="2026-05-02", to_ts="2026-05-02").collect()] == [1]
    assert [r["seq"] for r in a.audit_search(df, from_ts="2026-05-03T10:00:00Z").collect()] == [2]
    assert a.audit_search(df, from_ts="tomorrow").count() == 3
    assert [r["seq"] for r in a.audit_search(df, from_ts=dt.date(2026, 5, 2)).collect()] == [2, 1]
    assert [r["seq"] for r in a.audit_search(df, to_ts=dt.datetime(2026, 5, 2, 9)).collect()] == [0]
    assert [r["seq"] for r in a.audit_search(df, regex='"error": "bo+m"').collect()] == [2]
    assert [r["seq"] for r in a.audit_search(df, regex="app_restore").collect()] == [1]
    assert tuple(a.audit_counts(df, action="backup").first()) == (3, 2)
    for bad in ({"action": "BOGUS"}, {"outcome": "fail"}):
        with pytest.raises(ValueError):
            a.audit_search(df, **bad)


def test_entry_text_escapes(spark):
    df = log(spark, {"error": 'say "no"\\', "file": None}).select("seq", "timestamp", "action", "error", "file")
    assert df.select(a.entry_text(df)).first()[0] == (
        '{"action": "backup", "error": "say \\"no\\"\\\\", "timestamp": "2026-05-01T10:00:00Z"}')


def test_outcomes_and_runs(spark):
    df = log(spark, {"size": "1", "file": "f0"}, {"outcome": "failure", "error": None},
             {"size": "2", "file": "f2"}, {"size": "3", "file": "f3", "timestamp": "2026-05-03T10:00:00Z"},
             {"timestamp": "garbage"}, {"outcome": "skipped", "timestamp": "2026-06-01T00:00:00Z"})
    r = a.last_outcomes(df).first()
    assert (r["success_size"], r["success_file"], r["failure_error"]) == ("2", "f2", "")  # first of equal times
    assert tuple(a.last_run(df).first())[2:] == ("2026-05-03T10:00:00Z", "success")


def test_weekly_trend(spark):
    now = "2026-05-15 10:00:00"
    df = log(spark, {"timestamp": "2026-05-15T10:00:00Z", "size": "5"}, {"timestamp": "2026-05-08T10:00:00Z", "size": "x"},
             {"timestamp": "2026-05-08T10:00:01Z", "size": "7"}, {"timestamp": "2026-05-15T10:00:01Z"},
             {"timestamp": "2020-01-01T00:00:00Z"}, {"outcome": "failure", "timestamp": "2026-05-15T00:00:00Z"})
    out = a.weekly_trend(df, now).collect()
    assert len(out) == 8 and out[-1]["label"] == "May 15"
    assert [(r["backups"], r["bytes"]) for r in out[-2:]] == [(1, 0), (2, 12)]
    assert sum(r["backups"] for r in out[:-2]) == 0


def files(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('h', 'fresh', 'f1', timestamp_ntz'2026-05-15 08:00:00', 5L),
        ('h', 'stale', 'f2', timestamp_ntz'2026-05-05 08:00:00', 6L),
        ('h', 'seen', 'f3', timestamp_ntz'2020-01-01 00:00:00', 7L) AS t(host, database, file, mtime, size)""")


def test_cards(spark):
    df = log(spark, {"db_host": "h", "database": "seen", "timestamp": "2026-05-13T10:00:00Z", "size": "42", "file": "s"},
             {"db_host": "h", "database": "seen", "outcome": "failure", "error": "boom", "timestamp": "2026-05-14T10:00:00Z"},
             {"db_host": "h", "database": "no_files"})
    plan = spark.createDataFrame([("h", "fresh", "daily@5"), ("h", "stale", "weekly@9:1")],
                                 "host string, database string, when string")
    cards = a.freshness_cards(files(spark), df, plan, "2026-05-15 10:00:00")
    out = cards.collect()
    assert [(r["database"], r["status"]) for r in out] == [("stale", "stale"), ("seen", "aging"), ("fresh", "fresh")]
    seen = out[1]
    assert (seen["last_size"], seen["last_file"], seen["age_seconds"], seen["failure_error"]) == (42, "s", 172800, "boom")
    assert out[2]["next_at"] == "2026-05-16T05:00:00Z" and out[0]["next_at"] is None
    assert tuple(a.freshness_summary(cards).first()) == (3, 18, 1, 3, 1, 1, 1)


def test_secrets_and_bypass(spark, rows):
    df = log(spark, {"action": "vault_set", "account": "x"}, {"action": "vault_set", "account": "x"},
             {"action": "vault_set", "account": "y", "outcome": "failure"}, {"action": "scrub_bypass"})
    assert rows(a.secret_last_set(df)) == [("x", "2026-05-02T10:00:00Z")]
    assert rows(a.bypass_report(df)) == [("prod", "myapp", 1, "2026-05-04T10:00:00Z")]


PAIR = "host string, database string, when string"


def test_sync_plan(spark, rows):
    cfg = spark.createDataFrame([("prod", "app1", "daily@5", None), ("prod", "app2", "daily@7", True),
                                 ("staging", "x", "weekly@1:3", True), ("off", "y", "hourly", False)],
                                PAIR + ", enabled boolean")
    inst = spark.createDataFrame([("prod", "app1", "daily@5"), ("prod", "app2", "daily@5"), ("legacy", "old", "hourly"),
                                  ("off", "y", "hourly")], PAIR)
    assert rows(a.schedule_sync_plan(cfg, inst)) == [
        ("install", "staging", "x", "weekly@1:3"), ("nochange", "prod", "app1", "daily@5"),
        ("orphan", "legacy", "old", "hourly"), ("orphan", "off", "y", "hourly"), ("update", "prod", "app2", "daily@7")]


def test_upsert_and_delete(spark, rows):
    s = spark.createDataFrame([("h", "a", "daily", False, 3)], PAIR + ", enabled boolean, keep int")
    new = spark.createDataFrame([("h", "a", "hourly"), ("h", "b", "weekly")], PAIR)
    assert rows(a.schedule_upsert(s, new)) == [("h", "a", "hourly", False, 3), ("h", "b", "weekly", None, None)]
    assert a.schedule_delete(s, new).count() == 0


@pytest.mark.parametrize("text,cron", [
    ("hourly", "0 * * * *"), ("daily", "0 2 * * *"), ("daily@5", "0 5 * * *"), ("weekly", "0 2 * * 0"),
    ("weekly@3:5", "0 5 * * 3"), ("*/15 4 * * 1-5", "*/15 4 * * 1-5"), ("weekly@3", "0 3 * * 3")])
def test_parse_schedule(spark, text, cron):
    assert spark.range(1).select(schedules.parse_schedule(F.lit(text))).first()[0] == cron


@pytest.mark.parametrize("text,want", [  # 2026-05-13 is a Wednesday
    ("hourly", "2026-05-13T11:00:00Z"), ("daily", "2026-05-14T02:00:00Z"), ("daily@11", "2026-05-13T11:00:00Z"),
    ("daily@10", "2026-05-14T10:00:00Z"), ("daily@24", None), ("daily@x", None), ("weekly", "2026-05-17T02:00:00Z"),
    ("weekly@3:10", "2026-05-20T10:00:00Z"), ("weekly@3:11", "2026-05-13T11:00:00Z"), ("weekly@7:1", None),
    ("weekly@3", None), ("5 4 * * *", "2026-05-14T00:00:00Z"), ("", None), (None, None)])
def test_next_fire(spark, text, want):
    df = spark.range(1).select(F.lit(text).cast("string").alias("w"))
    now = F.lit("2026-05-13 10:00:00").cast("timestamp_ntz")
    assert df.select(scalars.iso_z(schedules.next_fire("w", now))).first()[0] == want


def test_notifications(spark, rows):
    df = log(spark, {"size": "2048"}, {"outcome": "failure"}, {"action": "restore", "target_db": "t", "file": "/x/f"},
             {"action": "restore", "outcome": "failure", "target_db": "t", "file": "/x/f", "error": "e"},
             {"action": "vault_set"})
    assert rows(a.notify_filter(df, "all"), "title", "message") == [
        ("backup FAILED: myapp", "myapp@prod is not stored. no reason given"),
        ("backup ok: myapp", "myapp@prod is stored, 2KB"),
        ("restore FAILED: t", "t is not loaded from f. e"),
        ("restore ok: t", "t is loaded from /x/f")]
    assert a.notify_filter(df).count() == 2 and a.notify_filter(df, "success").count() == 2
    assert a.notify_filter(df, "nonsense").count() == 2


def scalar(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_scalars(spark):
    assert scalar(spark, scalars.format_duration, ["0", "59", "60", "3599", "3600", "3725", "text", "-1", None]) == [
        "0s", "59s", "1m 0s", "59m 59s", "1h 0m 0s", "1h 2m 5s", "0s", "0s", "0s"]
    assert scalar(spark, scalars.human_size, ["0", "1023", "1024", "1048575", "1048576", "1073741824", "5000000000"]) == [
        "0B", "1023B", "1KB", "1023KB", "1MB", "1GB", "4GB"]
    assert scalar(spark, scalars.parse_backup_timestamp, ["app_20260508_103000.dump.zst", "app.sql"]) == [
        "2026-05-08T10:30:00Z", ""]
    assert scalar(spark, scalars.coerce_int, ["5", " 7 ", "", "1.5", "x", None, "99999999999999999999"]) == [
        5, 7, None, None, None, None, None]
    assert scalar(spark, scalars.encryption_of, ["a.sql.zst.age", "a.sql.zst.gpg", "a.sql.zst"]) == ["age", "gpg", "none"]
    assert scalar(spark, scalars.parse_name_list, ["a, b  c", ",, ", "x"]) == [["a", "b", "c"], [], ["x"]]
    assert scalar(spark, scalars.valid_json_path, ["$.a.b_1", "$", "$[0]", "$.a b"]) == [True, False, False, False]


def test_parse_iso(spark):
    def parse(text):
        return scalars.iso_z(scalars.parse_iso_utc(text))

    assert scalar(spark, parse, ["2026-05-01T10:00:00Z", "2026-05-01T10:00:00", "2026-05-01T10:00:00+02:00",
                                 "2026-05-01", "x", "2026-13-01T00:00:00Z", None]) == [
        "2026-05-01T10:00:00Z", "2026-05-01T10:00:00Z", "2026-05-01T08:00:00Z", "2026-05-01T00:00:00Z",
        None, None, None]
