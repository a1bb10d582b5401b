"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join `big` with `small`, which has at most one row per key (inner or left join).

    Each key of `big` is split into `salts` parts by the columns `spread`, and each row of
    `small` is repeated once per part, so a hot key is worked on by many tasks. This holds also
    where the small side comes out of an aggregate or window on the same key, which keeps
    Spark from splitting the key by itself. A small side below Spark's broadcast limit is
    broadcast as usual.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                salts: int = SALTS) -> DataFrame:
    """A left join as `salted_join` makes it, for a `small` that may have as many rows as `big`.

    A row of `small` is repeated only for the parts that its key has in `big`, so both sides of the join
    together never exceed the rows of `big` twice. No size guessed from files makes Spark send a side to the
    driver: the keys, or `big` itself where a filter on the result turns this into an inner join."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.join(left.select(*on, "_salt").distinct().hint("merge"), list(on))
    return left.hint("merge").join(right, [*on, "_salt"], "left").drop("_salt")
