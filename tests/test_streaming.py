import json

from pyspark.sql import functions as F

from tablecloak.functions import masks
from tablecloak.operators import audit
from tablecloak.sources import readers
from tablecloak.streaming import streams

SPEC = {"email": {"strategy": "fake_email"}, "note": {"strategy": "truncate", "length": 3}}


def put(folder, name, *entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) if isinstance(e, dict) else e for e in entries) + "\n")


def entry(day, **extra):
    return {"timestamp": f"2026-05-{day:02d}T10:00:00Z", "action": "backup", "outcome": "success",
            "db_host": "h", "database": "d", **extra}


def test_mask_and_sniff_streams_equal_batch(spark, tmp_path, rows):
    df = spark.range(50).selectExpr("id", "concat('u', id, '@x.org') AS email", "repeat('n', cast(id % 6 AS int)) AS note")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    source = streams.read_table_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=2)
    streams.run_append(streams.mask_stream(source, SPEC, "s"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(streams.mask_stream(df, SPEC, "s"))
    streams.run_latest(streams.sniff_stream(source, SPEC), str(tmp_path / "sniff"), str(tmp_path / "c2"), ["column"])
    got = rows(streams.read_latest(spark, str(tmp_path / "sniff")))
    assert got == [("email", 50), ("note", df.filter("length(note) > 3").count())]
    masked = streams.read_table_stream(spark, str(tmp_path / "out"), df.schema)
    streams.run_latest(streams.sniff_stream(masked, SPEC), str(tmp_path / "sniff2"), str(tmp_path / "c3"), ["column"])
    assert rows(streams.read_latest(spark, str(tmp_path / "sniff2"))) == [("email", 0), ("note", 0)]


def test_restart_continues_where_it_stopped(spark, tmp_path, rows):
    log = tmp_path / "log"
    put(log, "1.json", entry(1), "{broken", entry(2, outcome="failure", error="boom"))

    def run():
        stream = streams.read_audit_stream(spark, str(log))
        streams.run_append(streams.alert_stream(stream), str(tmp_path / "alerts"), str(tmp_path / "c"))
        streams.run_latest(streams.freshness_stream(stream), str(tmp_path / "fresh"), str(tmp_path / "f"),
                           ["db_host", "database"])
        return (rows(spark.read.parquet(str(tmp_path / "alerts")), "message"),
                streams.read_latest(spark, str(tmp_path / "fresh")).first()["last_success"].day)

    assert run() == ([("d@h is not stored. boom",)], 1)
    put(log, "2.json", entry(5), entry(6, outcome="failure"))
    assert run() == ([("d@h is not stored. boom",), ("d@h is not stored. no reason given",)], 5)
    batch = readers.read_audit(spark, str(log))
    assert audit.notify_filter(batch).count() == 2


def test_weekly_windows(spark, tmp_path):
    log = tmp_path / "log"
    put(log, "1.json", entry(7, size="5"), entry(13, size="x"), entry(14, size="7"), entry(14, outcome="failure"))
    stream = streams.read_audit_stream(spark, str(log))
    streams.run_latest(streams.weekly_trend_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"),
                       ["week_start"])
    got = streams.read_latest(spark, str(tmp_path / "out")).orderBy("week_start").collect()
    assert [(r["week_start"].strftime("%Y-%m-%d"), r["backups"], r["bytes"]) for r in got] == [
        ("2026-05-07", 2, 5), ("2026-05-14", 1, 7)]  # weeks start on Thursdays, like the epoch


def test_late_lines_are_dropped_and_results_merged(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"

    def run():
        stream = streams.weekly_trend_stream(streams.read_audit_stream(spark, str(log)))
        streams.run_latest(stream, str(out), str(tmp_path / "c"), ["week_start"], 2)
        rows = streams.read_latest(spark, str(out)).orderBy("week_start").collect()
        return [(r["week_start"].strftime("%m-%d"), r["backups"], r["bytes"]) for r in rows]

    put(log, "1.json", entry(7, size="5"), entry(30, size="7"))
    assert run() == [("05-07", 1, 5), ("05-28", 1, 7)]
    put(log, "2.json", entry(8, size="9"), entry(31, size="1"))  # the week of the 7th is closed
    assert run() == [("05-07", 1, 5), ("05-28", 2, 8)]
    put(log, "3.json", entry(31, size="1", timestamp="2026-06-11T10:00:00Z"))
    assert run() == [("05-07", 1, 5), ("05-28", 2, 8), ("06-11", 1, 1)]
    assert len([p for p in out.iterdir() if p.name.startswith("version=")]) <= 2


def test_null_groups_are_merged(spark, tmp_path, rows):
    log = tmp_path / "log"
    for day in (1, 2):
        put(log, f"{day}.json", entry(day), entry(day, user="u"))
        stream = streams.read_audit_stream(spark, str(log)).groupBy("user").count()
        streams.run_latest(stream, str(tmp_path / "o"), str(tmp_path / "c"), ["user"], 2)
    got = streams.read_latest(spark, str(tmp_path / "o")).collect()
    assert sorted((r["user"] or "", r["count"]) for r in got) == [("", 2), ("u", 2)]


def test_masks_are_the_batch_expression(spark):
    df = spark.createDataFrame([("a@b.co", "n")], "email string, note string")
    assert streams.mask_stream(df, SPEC, "s").first()["email"] == df.select(
        masks.fake_email(F.col("email"), "s")).first()[0]


def test_a_column_is_told_of_once(spark, tmp_path, rows):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run(*notes):
        spark.createDataFrame([("a@masked.test", n) for n in notes], "email string, note string").write.mode("append").parquet(str(source))
        stream = streams.read_table_stream(spark, str(source), "email string, note string")
        streams.run_alerts(streams.violation_alerts(stream, SPEC), out, str(tmp_path / "c"), 2)
        return rows(spark.read.parquet(out), "column", "sniff_count")

    assert run("ok", None) == []
    assert run("too long", "longer", "no") == [("note", 2)]
    assert run("once more") == [("note", 2)]


def test_stale_pairs_recover(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")

    def run():
        stream = streams.staleness_alerts(streams.read_audit_stream(spark, str(log)))
        streams.run_alerts(stream, out, str(tmp_path / "c"), 2)
        return sorted((r["db_host"], r["state"], str(r["last_success"])[:10], str(r["at"])[:10]) for r in spark.read.parquet(out).collect())

    put(log, "1.json", entry(1), entry(1, db_host="h2"), entry(3), entry(2, outcome="failure"))
    assert run() == []
    put(log, "2.json", entry(9, db_host="h2"))  # the 1st + 7 days of h2 has moved, the 3rd + 7 days of h is not reached
    first = run()
    assert first == [] or first == [("h2", "stale", "2026-05-01", "2026-05-08")]
    put(log, "3.json", entry(12, db_host="h2", outcome="failure"))
    assert ("h", "stale", "2026-05-03", "2026-05-10") in run()
    put(log, "4.json", entry(13))
    assert ("h", "recovered", "2026-05-13", "2026-05-13") in run()
    put(log, "5.json", entry(30, db_host="h2"))
    assert ("h", "stale", "2026-05-13", "2026-05-20") in run()


def test_every_line_is_counted_or_kept_apart(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"

    def run():
        streams.run_weekly_trend(streams.read_audit_stream(spark, str(log)), str(out), str(tmp_path / "c"))
        late = spark.read.parquet(str(out / "late")).orderBy("timestamp").collect()
        weeks = streams.read_latest(spark, str(out / "weeks")).orderBy("week_start").collect()
        return [r["timestamp"] for r in late], [(str(r["week_start"])[5:10], r["backups"], r["bytes"]) for r in weeks]

    put(log, "1.json", entry(7, size="5"), entry(30, size="7"), entry(30, outcome="failure"), entry(1, timestamp="soon"))
    assert run() == (["soon"], [("05-07", 1, 5), ("05-28", 1, 7)])
    put(log, "2.json", entry(8, size="9"), entry(31, size="1"), entry(22, size="2"))  # the week of the 7th is closed
    late, weeks = run()
    assert late == ["2026-05-08T10:00:00Z", "soon"] and weeks == [("05-07", 1, 5), ("05-21", 1, 2), ("05-28", 2, 8)]
    assert len(late) + sum(n for _, n, _ in weeks) == 6
