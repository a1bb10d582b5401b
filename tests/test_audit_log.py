"""Logs of many small appends: numbers across files, packing, readers beside it."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablecloak.operators.prefix import running_total
from tablecloak.sources import audit_log, readers


def fill(folder, parts, first=0, lines=2):
    os.makedirs(folder, exist_ok=True)
    for i in range(first, first + parts):
        text = "".join(json.dumps({"timestamp": "2026-05-01T10:00:00Z", "action": "backup", "file": f"{i}-{k}"}) + "\n"
                       for k in range(lines))
        (folder / f"{i:020d}-ab-00000.json").write_text("\n" + text if i % 7 == 0 else text)


def seen(spark, path):
    return [(r["seq"], r["file"]) for r in readers.read_audit(spark, str(path)).orderBy("seq").collect()]


def test_running_totals_over_ranges(spark):
    pick = random.Random(1)
    rows = [(pick.choice("abc"), i, pick.randint(0, 9)) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "a string, b int, n int"), ["a", "b"], "n", "before", 5).collect()
    total, want = 0, {}
    for a, b, n in sorted(rows):
        want[a, b] = total
        total += n
    assert {(r.a, r.b): r.before for r in got} == want
    empty = spark.createDataFrame([], "a string, n int")
    assert running_total(empty, ["a"], "n", "before").count() == 0


def test_numbers_of_five_thousand_files(spark, tmp_path):
    fill(tmp_path / "log", 5000, lines=1)
    df = readers.read_audit(spark, str(tmp_path / "log"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "FileScan text" not in plan  # the one scan of the text is done
    got = df.select("seq", "file").collect()
    blank = lambda i: i // 7 + 1  # noqa: E731  blank lines up to this file
    assert sorted(got) == [(i + 1 + blank(i), f"{i}-0") for i in range(5000)]


def test_two_thousand_appends_become_few_files(spark, tmp_path):
    log = tmp_path / "log"
    fill(log, 2_000, lines=1)
    path = str(log)
    before = [(i + 2 + i // 7, f"{i}-0") for i in range(2_000)]
    size = sum(f.stat().st_size for f in log.iterdir())
    plain = sorted(x for x in os.listdir(log))
    assert audit_log.compact_audit(spark, path, target_bytes=20_000, settled=0) == 2_000
    assert audit_log.log_files(spark, path) <= size // 20_000 + 2
    assert set(plain) <= set(os.listdir(log))  # readers of before still find what they chose
    assert audit_log.vacuum_audit(spark, path, grace=3600) == 0
    assert audit_log.vacuum_audit(spark, path, grace=0) == 2_000
    assert seen(spark, path) == before and not [x for x in os.listdir(log) if x.endswith(".json")]


def test_appends_readers_and_a_second_packing(spark, tmp_path):
    path = str(tmp_path / "log")
    event = "'2026-05-01T10:00:00Z' AS timestamp", "'backup' AS action"
    for i in range(3):
        audit_log.append_audit(spark.range(2).coalesce(1).selectExpr(*event, f"'{i}-' || id AS file"), path)
    before = seen(spark, path)
    assert [f for _, f in before] == [f"{i}-{k}" for i in range(3) for k in range(2)]
    assert audit_log.live_files(spark, path) is None
    assert audit_log.compact_audit(spark, path) == 0  # nothing is old enough
    assert audit_log.compact_audit(spark, path, settled=0) == 3
    held = audit_log.live_files(spark, path)  # a reader that chose its files now
    audit_log.append_audit(spark.range(1).selectExpr(*event, "'late' AS file"), path)
    assert [f for _, f in seen(spark, path)] == [*(f for _, f in before), "late"]
    assert audit_log.compact_audit(spark, path, settled=0) == 2 and audit_log.log_files(spark, path) == 1
    assert sorted(json.loads(r.value)["file"] for r in spark.read.text(held).collect()) == sorted(f for _, f in before)
    assert [f for _, f in seen(spark, path)] == [*(f for _, f in before), "late"]
    audit_log.vacuum_audit(spark, path, grace=0)
    assert [n for n, _ in seen(spark, path)] == list(range(1, 8))
    assert spark.read.schema("action string").json(path).count() == 0  # a stream over the folder never meets a packed file


def test_of_two_compactions_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    fill(tmp_path / "log", 20)
    before, publish = seen(spark, path), audit_log._publish

    def late(*args):
        monkeypatch.setattr(audit_log, "_publish", publish)
        assert audit_log.compact_audit(spark, path, settled=0) == 20
        return publish(*args)

    monkeypatch.setattr(audit_log, "_publish", late)
    assert audit_log.compact_audit(spark, path, settled=0) == 0
    assert seen(spark, path) == before and audit_log.log_files(spark, path) == 1
    assert len(os.listdir(tmp_path / "log" / "_packed")) <= 2


def test_runs_end_at_large_and_young_parts(spark):
    parts = [("a", 4, True), ("b", 4, True), ("c", 90, False), ("d", 4, True), ("e", 5, True), ("f", 4, True), ("g", 9, False), ("h", 1, True)]
    got = audit_log.pack_plan(spark.createDataFrame(parts, "name string, length bigint, small boolean"), 16).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r.name)
    assert sorted(sorted(x) for x in bins.values()) == [["a", "b"], ["d", "e"]] or sorted(map(sorted, bins.values())) == [["a", "b"], ["d", "e", "f"]]
    assert all(len(x) > 1 and "c" not in x and "g" not in x and "h" not in x for x in bins.values())


@pytest.mark.parametrize("broadcast", [0, 10])
def test_lines_are_kept_as_they_are(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(audit_log, "BROADCAST_PARTS", broadcast)
    log = tmp_path / "log"
    log.mkdir()
    texts = [b'{"action":"a"}\r\n\n{broken\n', b"", b'no end {"x":1}', b"\xff\xfe bytes\n", b"z" * 5000 + b"\n"]
    for i, t in enumerate(texts):
        (log / f"{i:020d}-x.json").write_bytes(t)
    assert audit_log.compact_audit(spark, str(log), settled=0) == 5
    (packed,) = [f for f in (log / "_packed").iterdir() if f.name[0] != "."]
    assert packed.read_bytes() == texts[0] + texts[2] + b"\n" + texts[3] + texts[4]
    assert spark.read.text(str(packed)).select(F.count("*")).first()[0] == 6
