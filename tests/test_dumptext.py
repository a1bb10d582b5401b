import random

import pytest

from tablecloak.operators import dumptext as d


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts, 1)], "file string, line_no bigint, line string")


def text(df):
    return [r["line"] for r in df.orderBy("file", "line_no").collect()]


def test_drops_statements_of_named_extensions(spark):
    df = lines(spark, 'CREATE EXTENSION IF NOT EXISTS "zonemap" WITH SCHEMA public;', "CREATE EXTENSION zonemap;",
               "COMMENT ON EXTENSION zonemap IS 'x';", "CREATE EXTENSION IF NOT EXISTS pg_trgm;",
               "CREATE EXTENSION zonemap_helper;", "CREATE EXTENSION nightly;", "CREATE TABLE t (id integer);")
    assert text(d.drop_extension_statements(df, ["zonemap", "nightly"])) == [
        "CREATE EXTENSION IF NOT EXISTS pg_trgm;", "CREATE EXTENSION zonemap_helper;", "CREATE TABLE t (id integer);"]
    assert d.drop_extension_statements(df, []) is df


COPY = "COPY public.notes (body) FROM stdin;"
DATA = "CREATE EXTENSION zonemap; -- this is table data"


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_copy_data_passes(spark, chunk):
    df = lines(spark, "CREATE EXTENSION zonemap;", COPY, DATA, "\\.", "CREATE EXTENSION zonemap;")
    assert text(d.drop_extension_statements(df, ["zonemap"], chunk)) == [COPY, DATA, "\\."]


def walk(texts):
    """Line by line: number of the COPY line whose block a line is in."""
    out, open_at = [], None
    for n, t in enumerate(texts, 1):
        out.append(open_at)
        if open_at is not None:
            open_at = None if t == "\\." else open_at
        elif t.startswith("COPY ") and t.endswith(" FROM stdin;"):
            open_at = n
    return out


def test_state_equals_a_line_walk(spark):
    rng = random.Random(7)
    data, want = [], {}
    for f in range(6):
        texts = [rng.choice([COPY, "\\.", "x", "y", "y"]) for _ in range(rng.choice([0, 1, 40, 90]))]
        data += [(f"f{f}", i, t) for i, t in enumerate(texts, 1)]
        want.update({(f"f{f}", i): s for i, s in enumerate(walk(texts), 1)})
    df = spark.createDataFrame(data, "file string, line_no bigint, line string")
    for chunk in (1, 4, 17, 1000):
        got = {(r["file"], r["line_no"]): r["copy_start"] for r in d.copy_state(df, chunk).collect()}
        assert got == want


def test_block_stats(spark, rows):
    df = lines(spark, COPY, "1", "2", COPY, "\\.", "COPY public.empty (x) FROM stdin;", "\\.", "SELECT 1;",
               "COPY cut (x) FROM stdin;", "9")
    assert rows(d.copy_block_stats(df, 3), "copy_start", "table", "rows") == [
        (1, "public.notes", 3), (6, "public.empty", 0), (9, "cut", 1)]


def test_definer(spark):
    df = lines(spark, "CREATE DEFINER=`root`@`%`  TRIGGER a", "x DEFINER=`a b`@`h`")
    assert text(d.strip_definer(df)) == ["CREATE TRIGGER a", "x "]
    assert text(d.strip_definer(df, "current_user")) == ["CREATE DEFINER=CURRENT_USER  TRIGGER a", "x DEFINER=CURRENT_USER"]
    assert d.strip_definer(df, "keep") is df


def test_clean_mysql(spark):
    df = lines(spark, "mysqldump: [Warning] Using", "Warning: Using a password", "a VARCHAR(65000), b VARCHAR(32000), VARCHAR(5)",
               " mysqldump: [Warning] kept", file="f").unionByName(lines(spark, "x", file="g"))
    assert text(d.clean_mysql_dump(df)) == [
        d.FAST_IMPORT, "a TEXT, b TEXT, VARCHAR(5)", " mysqldump: [Warning] kept", d.FAST_IMPORT, "x"]


def test_warnings(spark, rows):
    df = lines(spark, "mysql: [Warning] Using a password on the command line", "Warning: Using a password", "",
               "ERROR 1146: Table not found", "Got error: connection refused")
    assert text(d.dump_warnings(df)) == ["ERROR 1146: Table not found", "Got error: connection refused"]
    noise = lines(spark, "mysqldump: [Warning] Using a password", file="quiet")
    assert rows(d.dump_warning_counts(df.unionByName(noise)), "file", "warnings", "errors", "shown", "report") == [
        ("f", 2, 1, 2, True), ("quiet", 1, 0, 0, False)]


def test_engine(spark, rows):
    df = spark.createDataFrame([
        ("a", "PGDMP\x01", "", None), ("b", "-- PostgreSQL database dump", "", ""), ("c", "-- MySQL dump", "", None),
        ("d", "x" * 100 + "PostgreSQL", "", None), ("e", "PGDMP", "mysql", "postgres"), ("f", "", None, "postgres")],
        "file string, head string, meta_type string, host_type string")
    assert rows(d.detect_engine(df)) == [("a", "postgres"), ("b", "postgres"), ("c", "mysql"), ("d", "mysql"),
                                         ("e", "mysql"), ("f", "postgres")]
