import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecloak.operators import catalog as c
from tablecloak.operators.skew import salted_join

NOW = "2024-06-01 00:00:00"
TYPES = "host string, database string, file string, path string, mtime timestamp_ntz, size bigint"


def files(spark, ages, host="h", database="d"):
    """One file per age in days before NOW."""
    now = dt.datetime.fromisoformat(NOW)
    rows = []
    for i, age in enumerate(ages):
        t = None if age is None else now - dt.timedelta(days=age)
        name = f"{database}_{i:03d}.sql.zst"
        rows.append((host, database, name, f"{host}/{database}/{name}", t, 10 + i))
    return spark.createDataFrame(rows, TYPES)


def test_keep(spark):
    assert c.retention_keep(files(spark, range(7)), 3).count() == 4
    assert c.retention_keep(files(spark, range(2)), 3).count() == 0
    assert c.retention_keep(files(spark, range(2)), 0).count() == 2


def test_keep_ties_and_unknown_times(spark, rows):
    df = files(spark, [1, 1, 1, None, 5])
    assert rows(c.retention_keep(df, 2), "file") == [("d_002.sql.zst",), ("d_003.sql.zst",), ("d_004.sql.zst",)]
    assert rows(c.retention_keep(df, 4), "file") == [("d_003.sql.zst",)]


def test_keep_equals_a_plain_rank_on_skewed_pairs(spark, rows):
    df = spark.range(3000).select(
        F.concat(F.lit("h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("host"),
        F.lit("d").alias("database"), F.col("id").cast("string").alias("path"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 7919) % 1000)").alias("mtime"))
    for keep in (1, 7, 900, 2000):
        w = W.partitionBy("host", "database").orderBy(F.desc("mtime"), "path")
        want = rows(df.withColumn("r", F.row_number().over(w)).filter(F.col("r") > keep), "path")
        assert rows(c.retention_keep(df, keep), "path") == want


@pytest.mark.parametrize("ages,days,floor,left", [
    ([30] * 5, 7, 2, 2), ([0] * 5 + [60] * 7, 30, 3, 5), ([30] * 3, 7, 0, 0), ([30] * 3, 7, 10, 3)])
def test_older_than(spark, ages, days, floor, left):
    df = files(spark, ages)
    assert df.count() - c.retention_older_than(df, days, NOW, floor).count() == left


def test_older_than_needs_a_full_extra_day_and_a_time(spark):
    df = files(spark, [7.5, 8, None])
    assert c.retention_older_than(df, 7, NOW).count() == 1


def test_preview(spark):
    df = files(spark, range(5))
    assert c.retention_preview(df, NOW, keep=2).count() == 3
    assert c.retention_preview(df, NOW, older_than=3650).count() == 0
    assert c.retention_preview(df, NOW, keep=2, older_than=1).count() == 3
    assert c.retention_preview(files(spark, [9, 9, 9]), NOW, keep=2, older_than=1).count() == 3
    with pytest.raises(ValueError):
        c.retention_preview(df, NOW)


def test_scheduled(spark, rows):
    df = files(spark, range(4)).unionByName(files(spark, range(4), database="e")).unionByName(
        files(spark, range(4), database="x"))
    s = spark.createDataFrame([("h", "d", 1), ("h", "e", None), ("h", "y", 0)], "host string, database string, keep int")
    assert rows(c.retention_scheduled(df, s).groupBy("database").count()) == [("d", 3)]


def test_reclaimable(spark):
    df = files(spark, range(3))
    side = spark.createDataFrame([("h/d/d_000.sql.zst", 5)], "path string, sidecar_bytes bigint")
    assert tuple(c.reclaimable(df, side).first()) == (3, 38)
    assert tuple(c.reclaimable(df.limit(0), side).first()) == (0, 0)
    assert c.incomplete_backups(df, side).count() == 2


def test_latest(spark):
    df = files(spark, [3, 1, 2])
    assert c.latest_by_mtime(df).first()["file"] == "d_001.sql.zst"
    extra = df.selectExpr("host", "database", "'z.txt' AS file", "path", "mtime", "size")
    assert c.latest_by_name(df.unionByName(extra)).first()["file"] == "d_002.sql.zst"


def test_usage_and_order(spark):
    df = files(spark, [1, 2]).unionByName(files(spark, [1, 2, 3], database="e"))
    out = c.storage_usage(df).collect()
    assert [(r["database"], r["count"], r["bytes"], r["largest_bytes"]) for r in out] == [
        ("e", 3, 33, 12), ("d", 2, 21, 11)]
    assert out[0]["newest"] == "2024-05-31T00:00:00Z" and out[0]["oldest"] == "2024-05-29T00:00:00Z"
    assert tuple(c.storage_totals(df).first()) == (5, 54)
    assert [r["backups"] for r in c.count_by_host(df).collect()] == [5]


def test_listing_newest_name_first(spark):
    df = files(spark, [1, 2]).unionByName(files(spark, [1], host="g"))
    assert [r["file"] for r in c.list_backups(df, "h").collect()] == ["d_001.sql.zst", "d_000.sql.zst"]
    assert c.list_backups(df, "h", "none").count() == 0


def test_sync_plan(spark, rows):
    t = "path string, size bigint"
    local = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a.meta.json", 1)], t)
    remote = spark.createDataFrame([("b", 1), ("c", 2), ("d", 1), ("d.meta.json", 1)], t)
    assert rows(c.sync_plan(local, remote), "path", "action") == [
        ("a", "push"), ("b", "same"), ("c", "differs"), ("d", "pull")]


def test_safety(spark, rows):
    hosts = spark.createDataFrame([("h", "prod"), ("g", "PROD"), ("f", None)], "host string, safety string")
    df = files(spark, [1]).unionByName(files(spark, [1], host="g")).unionByName(files(spark, [1], host="x"))
    assert rows(c.safety_filter(df, hosts, external_target=True), "host", "safety", "refused") == [
        ("g", "local", False), ("h", "prod", True), ("x", "local", False)]
    assert c.safety_filter(df, hosts, external_target=True, allow_prod=True).filter("refused").count() == 0


def test_versions(spark):
    pg = spark.createDataFrame([("130000",), ("150004",), ("",), ("x",), (None,)], "v string")
    assert [r[0] for r in pg.select(c.pg_major("v")).collect()] == ["13", "15", "unknown", "unknown", "unknown"]
    my = spark.createDataFrame([("8.0.35",), ("10.11.6-MariaDB-1:10.11",), ("",), (None,), ("x8.0",)], "v string")
    assert [tuple(r[0]) for r in my.select(c.mysql_version("v")).collect()] == [
        ("mysql", "8", "0"), ("mariadb", "10", "11"), ("unknown", "0", "0"), ("unknown", "0", "0"), ("unknown", "0", "0")]
    e = spark.createDataFrame([("postgres",), ("PostgreSQL",), ("mysql",), ("mariadb",), ("x",)], "t string")
    assert [r[0] for r in e.select(c.engine_key("t")).collect()] == ["pg", "pg", "mysql", "mysql", None]


def test_target_name():
    assert c.restore_target_name("app", "20240601", set()) == "app_v1_20240601"
    assert c.restore_target_name("app", "20240601", {"app_v1_20240601", "app_v2_20240601"}) == "app_v3_20240601"


def test_restore_diff(spark, rows):
    t = "table string, column string, type string"
    new = spark.createDataFrame([("a", "x", "int"), ("a", "y", "int")], t)
    old = spark.createDataFrame([("a", "x", "text"), ("b", "z", "int")], t)
    assert rows(c.restore_diff(new, old, "clone"), "table", "column", "change") == [
        ("", "", "target_replaced"), ("a", "x", "changed"), ("a", "y", "added"), ("b", "z", "removed")]
    assert c.restore_diff(new, old.limit(0), "clone").filter("change = 'target_created'").count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_join(spark, rows, how):
    big = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id % 40) AS k")
    small = spark.range(30).selectExpr("id AS k", "id * 10 AS x")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = salted_join(big, small, ["k"], ["id"], how)
    assert rows(got, "id", "k", "x") == rows(big.join(small, "k", how), "id", "k", "x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], ["id"], "full")
