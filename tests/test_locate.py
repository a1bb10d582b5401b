import random
from collections import Counter

import pytest

from tablecloak.operators import verify

SCHEMA = "a int, b string, v double, w string"


@pytest.mark.parametrize("seed, buckets", [(1, 4096), (2, 1), (3, 3)])
def test_differences_by_key(spark, seed, buckets):
    """Null keys, several rows of a key and moved values, against a comparison of multisets."""
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(30)]), rng.choice([None, "", "x"]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "p"]))
    one = [row() for _ in range(300)]
    two = [r for r in one if rng.random() > 0.03] + [row() for _ in range(8)]
    rng.shuffle(two)
    sides = [{}, {}]
    for side, rows in zip(sides, (one, two)):
        for r in rows:
            side.setdefault(r[:2], Counter())[r[2:]] += 1
    want = {(*k, "lost" if k not in sides[1] else "added" if k not in sides[0] else "changed")
            for k in {*sides[0], *sides[1]} if sides[0].get(k) != sides[1].get(k)}
    got = verify.locate_differences(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), ["a", "b"], buckets)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_equal_tables_differ_nowhere(spark):
    df = spark.createDataFrame([(i, "x", None, None) for i in range(50)], SCHEMA)
    assert verify.locate_differences(df, df.repartition(3), ["a"]).isEmpty()
    with pytest.raises(ValueError):
        verify.locate_differences(df, df.drop("v"), ["a"])
