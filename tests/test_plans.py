import re

import pytest

from tablecloak.operators import masking, verify
from tablecloak.plans import views as v
from tablecloak.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def count(text, node):
    return len(re.findall(rf"^\s*[:+\-*| ]*{node}\b", text.split("\n\n\n")[0], re.M))


def test_masking_is_one_projection_without_shuffle(spark):
    text = plan(masking.mask_table(v.people(spark, SF), v.PEOPLE, v.SEED))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_sniff_report_scans_a_table_once(spark):
    people = v.people(spark, SF)
    text = plan(verify.sniff_table(people, "people", v.PEOPLE))
    assert len(re.findall(r"Scan parquet ", text.split("(1)")[0] + "\n")) <= 1
    assert text.count("Location: InMemoryFileIndex") == 1


def test_mask_reads_only_needed_columns(spark):
    text = plan(masking.mask_table(v.people(spark, SF), v.PEOPLE, v.SEED).select("email"))
    assert "ReadSchema: struct<c_name:string>" in text


def test_retention_limits_ranks_before_the_shuffle(spark):
    text = plan(QUERIES["c5_retention_keep"](spark, SF))
    assert re.search(r"WindowGroupLimit[\s\S]*Exchange hashpartitioning|Partial", text)
    assert "WindowGroupLimit" in plan(QUERIES["c3_latest_by_mtime"](spark, SF))


def test_search_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["a1_audit_search"](spark, SF))


def test_recent_rows_are_filtered_in_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan(QUERIES["r7_keep_recent"](spark, SF))


def test_drift_shuffles_once(spark):
    assert len(re.findall(r"^\(\d+\) Exchange", plan(QUERIES["d6_schema_drift"](spark, SF)), re.M)) == 1


LAZY = [n for n in QUERIES if not n.startswith(("w", "z", "s6", "s7", "v12", "r1", "r3", "r6"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "v14_verify_files":
        assert "Python" not in text and "MapInPandas" not in text


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
