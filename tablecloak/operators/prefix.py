"""Running totals over an order that no single task could hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecloak.session import cut_lineage

#: Ranges that rows are dealt to by their order; one number for each reaches the driver.
RANGES = 64


def running_total(rows: DataFrame, order: Sequence[Column | str], value: str, into: str, ranges: int = RANGES) -> DataFrame:
    """Rows with `into`: the sum of `value` over all rows that come before them in a total order.

    Rows are dealt to ranges of the order, whose totals give each range its offset; within a range a
    window does the rest. The ranges are written once, as two looks at them must agree."""
    dealt = cut_lineage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = {r["_range"]: r["n"] or 0 for r in dealt.groupBy("_range").agg(F.sum(value).alias("n")).collect()}
    offsets, so_far = [], 0
    for k in range(max(totals, default=0) + 1):
        offsets.append(F.lit(so_far).cast("bigint"))
        so_far += totals.get(k, 0)
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(into, F.get(F.array(*offsets), F.col("_range")) + F.coalesce(
        F.sum(value).over(w), F.lit(0))).drop("_range")
