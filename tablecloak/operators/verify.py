"""Post-conditions of the masks: counts of rows that violate them, 0 = pass."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecloak.functions import masks
from tablecloak.operators.masking import LEAF_STRATEGIES, table_columns
from tablecloak.session import cut_lineage, local_rows, union_all

log = logging.getLogger("tablecloak")

#: Buckets of each level of a digest tree, and those that are broadcast.
BUCKETS, BROADCAST_BUCKETS = 4096, 1_000_000
REPORT = "table string, column string, strategy string, sniff_count bigint, pass boolean"


def _fake_violation(c: Column, strategy: str, domain: str) -> Column:
    expected = {
        "fake_email": lambda: c.endswith("@" + domain),
        "fake_phone": lambda: c.startswith(masks.PHONE_PREFIX),
        "fake_ip": lambda: c.startswith(masks.IP_PREFIX),
        "fake_name": lambda: c.startswith(masks.NAME_PREFIX),
    }[strategy]()
    return c.isNotNull() & ~expected


def _leaf_violation(value: Column, path: str, strategy: str, domain: str) -> Column:
    leaf = F.try_variant_get(value, path, "string")  # JSON null reads as NULL
    if strategy == "redact":
        return leaf.isNotNull()
    if strategy == "passthrough":
        return F.lit(False)
    return F.coalesce(_fake_violation(leaf, strategy, domain), F.lit(False))


def _json_violation(c: Column, paths: Mapping[str, str], domain: str, data_type: str) -> Column:
    """Any leaf violates. A value is parsed once for all paths; text that is no JSON cannot be
    checked and counts as a violation."""

    def leaves(value: Column) -> Column:
        broken = [_leaf_violation(value, p, s, domain) for p, s in paths.items()]
        return value.isNull() | reduce(lambda a, b: a | b, broken)

    value = c if data_type == "variant" else F.try_parse_json(c)
    return c.isNotNull() & F.exists(F.array(value), leaves)


def violation(col: Column | str, spec: Mapping, domain: str = masks.DEFAULT_DOMAIN,
              data_type: str = "string") -> Column | None:
    """True where a masked value breaks its post-condition; None when there is none to check."""
    c = F.col(col) if isinstance(col, str) else col
    strategy = spec["strategy"]
    if strategy in ("fake_email", "fake_phone", "fake_ip", "fake_name"):
        return _fake_violation(c, strategy, domain)
    if strategy == "redact":
        if "replacement" not in spec:
            return c.isNotNull()
        return ~c.eqNullSafe(F.lit(spec["replacement"]).cast(data_type))
    if strategy == "truncate":
        return F.char_length(c) > int(spec["length"])
    if strategy == "jsonb_scrub_paths":
        return _json_violation(c, spec["paths"], domain, data_type) if spec["paths"] else None
    if strategy in ("shift_date", "passthrough"):
        return None
    raise ValueError(f"unknown strategy '{strategy}'")


def sniff(df: DataFrame, col: str, spec: Mapping,
          domain: str = masks.DEFAULT_DOMAIN) -> DataFrame:
    """Violations of one column as a one-row table."""
    cond = violation(F.col(col), spec, domain, df.schema[col].dataType.simpleString())
    count = F.count_if(cond) if cond is not None else F.count_if(F.lit(False))
    return df.agg(count.alias("sniff_count"))


def _checkable(field: T.StructField | None, spec: Mapping) -> bool:
    """A column that is absent, or of a type its check cannot read, fails as -1."""
    if field is None:
        return False
    text = isinstance(field.dataType, T.StringType)
    strategy = spec["strategy"]
    if strategy == "jsonb_scrub_paths":
        return (text or field.dataType.simpleString() == "variant") and all(
            s in LEAF_STRATEGIES for s in spec["paths"].values())
    return text or strategy in ("redact", "shift_date", "passthrough")


def sniff_table(df: DataFrame, table: str, columns: Mapping[str, Mapping],
                domain: str = masks.DEFAULT_DOMAIN) -> DataFrame:
    """All counts of a table in one aggregate over one scan, then one row per column."""
    fields = {f.name: f for f in df.schema.fields}
    aggs, entries = [], []
    for i, (name, spec) in enumerate(sorted(columns.items())):
        if _checkable(fields.get(name), spec):
            cond = violation(F.col(f"`{name}`"), spec, domain,
                             fields[name].dataType.simpleString())
            count = F.count_if(cond) if cond is not None else F.count_if(F.lit(False))
        else:
            count = F.max(F.lit(-1).cast("bigint"))
        aggs.append(count.alias(f"n{i}"))
        entries.append(F.struct(
            F.lit(table).alias("table"), F.lit(name).alias("column"),
            F.lit(spec["strategy"]).alias("strategy"),
            F.coalesce(F.col(f"n{i}"), F.lit(-1).cast("bigint")).alias("sniff_count")))
    return (df.agg(*aggs)
            .select(F.explode(F.array(*entries)).alias("r")).select("r.*")
            .withColumn("pass", F.col("sniff_count") == 0))


def sniff_report(tables: Mapping[str, DataFrame], manifest: Mapping,
                 domain: str = masks.DEFAULT_DOMAIN) -> DataFrame:
    """One row per declared column of a dataset; declared tables that are absent fail as -1, as does a column whose
    check stops with an error.

    All counts are taken at once, one scan per table. Only if that stops are tables, and then the columns of
    the one that stops, checked apart. The report has one short row per declared column."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    declared = {t: table_columns(manifest, t) for t in sorted(manifest.get("tables", {}))}
    there = {t: columns for t, columns in declared.items() if columns and t in tables}
    rows = [(t, c, s["strategy"], -1, False) for t, columns in declared.items() if t not in tables
            for c, s in sorted(columns.items())]

    def checked(parts: Sequence[DataFrame]) -> list[tuple] | None:
        try:
            return [tuple(r) for r in union_all(parts).collect()] if parts else []
        except (PySparkException, Py4JJavaError) as e:
            log.warning("a check stopped: %s", type(e).__name__)  # its message may show values
            return None

    found = checked([sniff_table(tables[t], t, columns, domain) for t, columns in there.items()])
    if found is None:
        found = []
        for t, columns in there.items():
            whole = checked([sniff_table(tables[t], t, columns, domain)])
            if whole is None:
                whole = []
                for c, spec in sorted(columns.items()):
                    kept = tables[t].select(f"`{c}`") if c in tables[t].columns else tables[t]
                    one = checked([sniff_table(kept, t, {c: spec}, domain)])
                    whole += [(t, c, spec["strategy"], -1, False)] if one is None else one
            found += whole
    return local_rows(spark, [*found, *rows], REPORT)


def gate_ok(report: DataFrame) -> DataFrame:
    """AND over all passes; an empty report passes."""
    return report.agg(F.coalesce(F.bool_and("pass"), F.lit(True)).alias("ok"))


def gate_active(hosts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Hosts whose copies must pass the gate: a manifest exists and it is required, or at
    least one destination requires it."""
    needed = F.coalesce("required", F.lit(False)) | (
        F.coalesce(F.size("required_for"), F.lit(0)) > 0)
    return hosts.filter(needed).join(manifests.select("host").distinct(), "host", "left_semi")


def restore_drill(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare row counts of a clone (`table, rows`) with expectations (`table, min_rows,
    snapshot_rows`): expected tables must be there, filled, and equal to the snapshot."""
    joined = expected.join(counts, "table", "left")
    rows = F.coalesce("rows", F.lit(0).cast("bigint"))
    return joined.select(
        "table", rows.alias("rows"), "min_rows", "snapshot_rows",
        F.when(F.col("rows").isNull(), "missing")
        .when(rows < F.col("min_rows"), "too_few")
        .when(rows != F.coalesce("snapshot_rows", rows), "count_differs")
        .otherwise("ok").alias("status"))


def locate_differences(source: DataFrame, copy: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """`keys` and `difference`: `lost` (only in the source), `added` (only in the copy), or `changed`.

    A tree of digests of three levels: rows are hashed once and fall into buckets by a hash of their key; buckets
    whose digests agree are done, those that differ are split again, and only rows of parts that still differ are
    shuffled and compared by key. What is written and read on the way are keys and two hashes. Keys may be null;
    of rows that share a key the multisets are compared."""
    columns = [c for c in source.columns if c not in keys]
    if sorted(source.columns) != sorted(copy.columns):
        raise ValueError("the copy has other columns than the source")

    def hashed(df: DataFrame, side: int) -> DataFrame:
        value = F.xxhash64(*[x for c in [*keys, *columns] for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
        key = F.xxhash64(*[x for c in keys for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
        return df.select(*[F.col(f"`{c}`") for c in keys], F.lit(side).alias("_side"), key.alias("_key"), value.alias("_value"))

    rows = cut_lineage(hashed(source, 1).unionByName(hashed(copy, -1)))
    signed = F.sum(F.col("_side") * F.col("_value").cast("decimal(20,0)"))
    differs = (F.sum("_side") != 0) | (signed != 0)
    coarse = F.pmod("_key", F.lit(buckets))
    fine = F.pmod(F.shiftright("_key", 32), F.lit(buckets))
    for level in ((coarse,), (coarse, fine)):
        names = [f"_b{i}" for i in range(len(level))]
        parts = rows.select("_side", "_value", *[b.alias(n) for b, n in zip(level, names)])
        open_ = cut_lineage(parts.groupBy(*names).agg(differs.alias("_d")).filter("_d").select(*names))
        few = open_.count() <= BROADCAST_BUCKETS
        rows = rows.withColumns(dict(zip(names, level))).join(F.broadcast(open_) if few else open_, names, "left_semi").drop(*names)
    mine, theirs = F.count_if(F.col("_side") > 0), F.count_if(F.col("_side") < 0)
    kind = F.when(theirs == 0, "lost").when(mine == 0, "added").otherwise("changed")
    return rows.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(differs.alias("_d"), kind.alias("difference")).filter("_d").drop("_d")


def drill_passed(drill: DataFrame) -> DataFrame:
    """At least one table, and no expectation broken."""
    return drill.agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("status") != "ok").alias("failures"),
    ).withColumn("ok", (F.col("tables") >= 1) & (F.col("failures") == 0))


def mask_stability(a: DataFrame, b: DataFrame, source_col: str,
                   masked_col: str) -> DataFrame:
    """Same source value, same fake, in two masked sets that still carry the source value.

    Each side is reduced to one row per source value before the join, so a value that fills
    a third of a table is combined on the map side and never meets itself pair by pair.
    """

    def values(df: DataFrame, side: str) -> DataFrame:
        return (df.filter(F.col(source_col).isNotNull())
                .groupBy(F.col(source_col).alias("source"))
                .agg(F.min(masked_col).alias(f"{side}_min"), F.max(masked_col).alias(f"{side}_max")))

    both = values(a, "a").join(values(b, "b"), "source", "full")
    unstable = (F.col("a_min") != F.col("a_max")) | (F.col("b_min") != F.col("b_max")) \
        | (F.col("a_min") != F.col("b_min"))
    return both.agg(
        F.count("*").alias("values"),
        F.count_if(F.col("a_min").isNotNull() & F.col("b_min").isNotNull()).alias("shared"),
        F.count_if(unstable).alias("unstable"))

