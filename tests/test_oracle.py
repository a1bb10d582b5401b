import pytest

from tablecloak.plans.check import compare, duck
from tablecloak.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, con, name):
    assert compare(spark, SF, name, con).split(" ")[0] in ("ok", "rows")
