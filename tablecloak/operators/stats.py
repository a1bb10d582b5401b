"""Table sizes and what excluding tables would save."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.session import union_all

MB = 1024 * 1024


def table_stats(tables: Mapping[str, DataFrame], sizes: DataFrame | None = None) -> DataFrame:
    """`table, rows, size_bytes`, largest first. `sizes(table, size_bytes)` comes from a file
    listing; without it the size is 0."""
    counts = union_all([
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in sorted(tables.items())])
    if sizes is None:
        return counts.withColumn("size_bytes", F.lit(0).cast("bigint")).orderBy(F.desc("rows"), "table")
    return (counts.join(sizes, "table", "left")
            .select("table", "rows", F.coalesce("size_bytes", F.lit(0).cast("bigint")).alias("size_bytes"))
            .orderBy(F.desc("size_bytes"), "table"))


def _megabytes(size: Column) -> Column:
    return F.round(F.coalesce(F.sum(size), F.lit(0)) / MB, 2)


def stats_totals(stats: DataFrame) -> DataFrame:
    """Table count, rows and megabytes (two decimals); zeros for no table at all."""
    return stats.agg(
        F.count("*").alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        _megabytes(F.col("size_bytes")).alias("size_mb"))


def tag_excluded(stats: DataFrame, excluded: DataFrame) -> DataFrame:
    """Flag tables by exact name."""
    names = excluded.select("table").distinct().withColumn("excluded", F.lit(True))
    return stats.join(names, "table", "left").withColumn(
        "excluded", F.coalesce("excluded", F.lit(False)))


def exclusion_savings(stats: DataFrame, selected: DataFrame) -> DataFrame:
    """Megabytes that would not be written if the selected tables were excluded."""
    chosen = stats.join(selected.select("table").distinct(), "table", "left_semi")
    return chosen.agg(_megabytes(F.col("size_bytes")).alias("saved_mb"))


def clean_stats(raw: DataFrame) -> DataFrame:
    """Text statistics `(table, rows, size_bytes)` as numbers; what is no number counts 0."""

    def number(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))

    return raw.filter(F.coalesce(F.col("table"), F.lit("")) != "").select(
        "table", number("rows").alias("rows"), number("size_bytes").alias("size_bytes"))


def analyze_report(stats: DataFrame, excluded: DataFrame, pii: DataFrame) -> DataFrame:
    """The analysis as JSON records `(section, name, record)`: one `totals` row, a `table` row
    per table and a `pii` row per table with matches. Rows, not one nested document, so a
    catalogue of any size stays distributed."""
    totals = stats.agg(F.count("*").alias("tables"),
                       F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                       F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    parts = [
        totals.select(F.lit("totals").alias("section"), F.lit("").alias("name"),
                      F.to_json(F.struct("tables", "rows", "size_bytes")).alias("record")),
        tag_excluded(stats, excluded).select(
            F.lit("table").alias("section"), F.col("table").alias("name"),
            F.to_json(F.struct(F.col("table").alias("name"), "rows", "size_bytes", "excluded"))
            .alias("record")),
        pii.select(F.lit("pii").alias("section"), F.col("table").alias("name"),
                   F.to_json(F.struct("table", F.split("columns", ",").alias("columns")))
                   .alias("record")),
    ]
    return union_all(parts)
