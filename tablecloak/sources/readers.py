"""Read tables, catalogues, sidecars, audit logs and dump text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecloak.functions.scalars import SNAPSHOT_NAME, encryption_of, valid_alias
from tablecloak.operators.catalog import host_safety
from tablecloak.operators.prefix import running_total
from tablecloak.session import cut_lineage, local_rows
from tablecloak.sources.audit_log import live_files

# Rows of at most about 200 bytes: a file path and three numbers.
BROADCAST_BLOCKS = 400_000

# Databases that belong to the engines.
SYSTEM_DATABASES = ("postgres", "template0", "template1",
                    "mysql", "information_schema", "performance_schema", "sys")

COLUMN_SPEC = "struct<type:string,nullable:boolean>"
SIDECAR = f"""host string, database string, type string, timestamp string, size bigint,
    checksums struct<sha256:string>, encryption string, source_flavor string,
    source_major_version string, source_minor_version string, backup_mode string,
    source_extensions array<string>,
    scrub_schema struct<tables:map<string,struct<columns:map<string,{COLUMN_SPEC}>>>>"""
AUDIT = """seq bigint, timestamp string, action string, outcome string, user string, host string,
    db_host string, database string, duration_sec string, size string, file string,
    error string, target_db string, account string, target string, into_container string"""


def scan_table(spark: SparkSession, source: str, table: str, *, options: Mapping[str, str] | None = None,
               partition_column: str | None = None, lower: int | None = None,
               upper: int | None = None, partitions: int = 8, predicates: Sequence[str] | None = None) -> DataFrame:
    """A table of a database (`jdbc:` URL) or a Parquet folder (`<source>/<table>[.parquet]`).

    Give a JDBC read a numeric partition column with its bounds, or, where its values lie unevenly,
    `predicates` (one task each, see `balanced_predicates`); else one task reads it all.
    """
    if not source.startswith("jdbc:"):
        return spark.read.parquet(f"{source.rstrip('/')}/{table}")
    if predicates is not None:
        return spark.read.jdbc(source, table, predicates=list(predicates), properties=dict(options or {}))
    reader = spark.read.format("jdbc").option("url", source).option("dbtable", table)
    if partition_column is not None:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower),
                                upperBound=str(upper), numPartitions=str(partitions))
    return reader.options(**(options or {})).load()


def balanced_predicates(sample: DataFrame, column: str, partitions: int = 8, accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a table into ranges of about equal numbers of rows, each row in exactly one.

    The bounds are quantiles of the column's values, from a sketch of bounded size that each task builds of its
    rows, so a skewed key gives narrow ranges where rows are many. A value is never split. Rows without a
    value are the first range's. `sample` holds numbers, dates or times: the table itself, an earlier snapshot of it,
    or its keys."""
    kind = sample.schema[column].dataType.simpleString()
    shares = [i / partitions for i in range(1, partitions)]
    values = F.col(f"`{column}`") if kind not in ("date", "timestamp_ntz", "timestamp") else F.unix_micros(
        F.col(f"`{column}`").cast("timestamp"))
    if not shares:
        return ["1 = 1"]
    found = sample.select(values.alias("v")).agg(F.percentile_approx("v", shares, accuracy).alias("q")).first().q or []
    bounds = sorted(set(found))
    if kind in ("date", "timestamp_ntz", "timestamp"):
        texts = sample.sparkSession.range(1).select(*[
            F.date_format(F.timestamp_micros(F.lit(b)), "yyyy-MM-dd HH:mm:ss.SSSSSS") for b in bounds]).first()
        literals = [f"{'DATE' if kind == 'date' else 'TIMESTAMP'} '{t[:10] if kind == 'date' else t}'" for t in texts]
    else:
        literals = [str(b) for b in bounds]
    if not literals:
        return ["1 = 1"]
    first = f"{column} < {literals[0]} OR {column} IS NULL"
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(literals, literals[1:])]
    return [first, *inner, f"{column} >= {literals[-1]}"]


def column_catalog(tables: Mapping[str, DataFrame], json_columns: Sequence[str] = ()) -> DataFrame:
    """One row per column from the schemas alone; nothing is scanned. `json_columns` names
    text columns that hold JSON, as `table.column`."""
    rows = [(t, f.name,
             "json" if f"{t}.{f.name}" in json_columns else f.dataType.simpleString(),
             f.nullable, i)
            for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    return local_rows(
        spark, rows, "table string, column string, type string, nullable boolean, ordinal int")


def information_schema_catalog(columns: DataFrame, schema: str = "public") -> DataFrame:
    """The same from rows of `information_schema.columns` of a live database."""
    return (columns.filter(F.col("table_schema") == schema)
            .select(F.col("table_name").alias("table"), F.col("column_name").alias("column"),
                    F.col("data_type").alias("type"),
                    (F.coalesce("is_nullable", F.lit("YES")) == "YES").alias("nullable"),
                    F.col("ordinal_position").cast("int").alias("ordinal")))


def jdbc_column_catalog(spark: SparkSession, url: str, schema: str = "public",
                        **options: str) -> DataFrame:
    return information_schema_catalog(
        scan_table(spark, url, "information_schema.columns", options=options), schema)


def explode_captured_schema(sidecars: DataFrame, keep: Sequence[str] = ("host",),
                            schema_col: str = "scrub_schema") -> DataFrame:
    """Captured schemas (JSON text or the parsed struct) as catalogue rows; a column that does
    not say so is nullable."""
    c = F.col(schema_col)
    if sidecars.schema[schema_col].dataType.simpleString() == "string":
        c = F.from_json(c, f"tables map<string,struct<columns:map<string,{COLUMN_SPEC}>>>")
    return (sidecars.select(*keep, F.explode(c["tables"]).alias("table", "_t"))
            .select(*keep, "table", F.explode("_t.columns").alias("column", "_c"))
            .select(*keep, "table", "column", F.col("_c.type").alias("type"),
                    F.coalesce("_c.nullable", F.lit(True)).alias("nullable")))


def parse_sidecars(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Sidecar texts as columns; a text that cannot be parsed gives NULLs."""
    keep = [c for c in texts.columns if c != text_col]
    return texts.select(*keep, F.from_json(text_col, SIDECAR).alias("_m")).select(*keep, "_m.*")


def read_sidecars(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All sidecar files of a fleet, one row per file."""
    texts = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("sidecar_path"), F.col("value").alias("text"))
    return parse_sidecars(texts)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """`path, length, modificationTime` of every file; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
            .select("path", "length", "modificationTime"))


def backup_catalog(files: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Catalogue rows from a file listing `(path, length, modificationTime)`.

    Expected layout: `<root>/<host>/<database>/<file>`. Only accepted endings and valid host
    and database names count; a snapshot is complete when its sidecar exists.
    """
    parts = F.split(F.col("path"), "/")
    rows = files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        F.element_at(parts, -1).alias("file"),
        F.try_element_at(parts, F.lit(-2)).alias("database"),
        F.try_element_at(parts, F.lit(-3)).alias("host"))
    snapshots = rows.filter(F.col("file").rlike(SNAPSHOT_NAME) & valid_alias("host")
                            & valid_alias("database"))
    sidecars = (rows.filter(F.col("file").endswith(".meta.json"))
                .select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"),
                        F.lit(True).alias("complete")))
    out = (snapshots.join(sidecars, "path", "left")
           .withColumn("complete", F.coalesce("complete", F.lit(False)))
           .withColumn("encryption", encryption_of("file")))
    if hosts is not None:
        labels = hosts.select("host", host_safety("safety").alias("safety"))
        out = out.join(labels, "host", "left").withColumn(
            "safety", F.coalesce("safety", F.lit("local")))
    return out


def _block_bound(spark: SparkSession, paths: str | Sequence[str]) -> int:
    """Upper bound for the number of splits of a text scan, from the file listing alone."""
    files = spark.read.format("binaryFile").load(paths).agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

    def size(key: str) -> int:
        text = spark.conf.get(key).lower()
        unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        digits = text.rstrip("bkmg")
        return int(digits) * unit[text[len(digits):][:1] or "b"]

    per_core = files[1] // max(spark.sparkContext.defaultParallelism, 1)
    split = min(size("spark.sql.files.maxPartitionBytes"),
                max(size("spark.sql.files.openCostInBytes"), per_core))
    return files[0] + files[1] // max(split, 1)


def number_lines(lines: DataFrame, blocks: int | None = None, across: bool = False) -> DataFrame:
    """Rows `(file, block, pos, ...)` with `line_no` instead of their place, where `pos` grows inside a block;
    with `across` the numbers run through all files in order of their paths.

    A block is one split of a file, read in order by one task. Its lines are numbered from
    the lines of the blocks before it: one short row per block is ordered, never the lines. Across files
    the rows of blocks are summed by ranges, so their number may grow as well.
    With a known small bound on `blocks` those rows are broadcast and no line is shuffled.
    """
    starts = lines.groupBy("file", "block").agg(
        F.min("pos").alias("_first"), F.count("*").alias("_n"))
    if across:
        starts = running_total(starts, ["file", "block"], "_n", "_before")
    else:
        w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    starts = starts.drop("_n")
    if blocks is not None and blocks <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    others = [c for c in lines.columns if c not in ("file", "block", "pos")]
    return lines.join(starts, ["file", "block"]).select(
        "file", (F.col("_before") + F.col("pos") - F.col("_first") + 1).alias("line_no"), *others)


def _placed_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """`(file, block, pos, line)` of text files."""
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").alias("line"))
            .withColumn("pos", F.monotonically_increasing_id()))


def read_dump_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Dump files (`.sql`, `.sql.gz`) as `(file, line_no, line)`.

    Plain files are split into blocks that many tasks read; only `\\n` ends a line, and bytes
    that are no UTF-8 are kept as they are.
    """
    return number_lines(_placed_lines(spark, paths), _block_bound(spark, paths))


def read_audit(spark: SparkSession, paths: str | Sequence[str], schema: str = AUDIT) -> DataFrame:
    """Audit lines with their place in the log as `seq` (unless they carry one); blank, broken
    and non-object lines are skipped. Several files follow each other by path; of a compacted log, by the
    names that its parts had when they were appended. Fields that the schema does not name are kept as
    text in the map `extras`.

    The text is read once: parsed lines are written with their place, and numbered from there."""
    named = T.StructType.fromDDL(schema).names
    extras = F.map_filter(F.from_json("line", "map<string,string>"), lambda k, x: ~k.isin(*named) & x.isNotNull())
    entry = F.from_json("line", f"{schema}, _corrupt string",
                        {"columnNameOfCorruptRecord": "_corrupt"})
    live = live_files(spark, paths) if isinstance(paths, str) else None
    lines = _placed_lines(spark, paths if live is None else live)
    if live is not None:
        lines = lines.withColumn("file", F.element_at(F.split("file", "/"), -1))
    good = F.col("e._corrupt").isNull() & (F.col("e.timestamp").isNotNull() | F.col("e.action").isNotNull())
    parsed = lines.select("file", "block", "pos", entry.alias("e"), extras.alias("extras")).select(
        "file", "block", "pos", F.when(good, F.struct("e.*", "extras")).alias("e"))
    numbered = number_lines(cut_lineage(parsed), _block_bound(spark, paths if live is None else live), across=True)
    rows = numbered.filter(F.col("e").isNotNull()).select("line_no", "e.*")
    return rows.withColumn("seq", F.coalesce("seq", "line_no")).drop("line_no", "_corrupt")


def list_user_databases(names: DataFrame, col: str = "database") -> DataFrame:
    """Database names without those of the engine itself."""
    return names.filter(~F.col(col).isin(*SYSTEM_DATABASES)).select(col).distinct()
