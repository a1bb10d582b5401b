"""Jobs over SQL dump text held as `(file, line_no, line)` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Line shapes of dump text.
COPY_HEAD, COPY_TAIL = "COPY ", " FROM stdin;"
COPY_END = "\\."
DEFINER = "DEFINER=`[^`]+`@`[^`]+`"
PASSWORD_NOISE = r"^(mysqldump: |mysql: )?\[?[Ww]arning\]?.*Using a password"
REAL_ERROR = "^(mysqldump: )?(Got error|Error)"
ANY_WARNING = r"^(mysqldump: )?(Got error|\[?[Ww]arning\]?|Error)"
FAST_IMPORT = "SET foreign_key_checks=0; SET unique_checks=0;"
LONG_VARCHAR = r"VARCHAR\((65000|32000)\)"
PG_MAGIC = "PGDMP"
HEAD_COMMENTS = r"\A(?:\s*--[^\n]*(?:\n|\z))+"
EXTENSION = '^(CREATE EXTENSION( IF NOT EXISTS)?|COMMENT ON EXTENSION) "?({names})"?[ ;]'

CHUNK_LINES = 200_000


def strip_definer(lines: DataFrame, mode: str = "strip") -> DataFrame:
    """Remove DEFINER clauses, or set them to the current user; other modes change nothing."""
    if mode == "strip":
        pattern, new = DEFINER + r"[ \t\r\n\f\x0B]*", ""
    elif mode == "current_user":
        pattern, new = DEFINER, "DEFINER=CURRENT_USER"
    else:
        return lines
    c = F.col("line")
    return lines.withColumn("line", F.when(
        c.contains("DEFINER="), F.regexp_replace(c, F.lit(pattern), F.lit(new))).otherwise(c))


def is_copy_start(line: str = "line") -> Column:
    """`COPY … FROM stdin;` as a whole line; plain text tests, no pattern."""
    c = F.col(line)
    return (c.startswith(COPY_HEAD) & c.endswith(COPY_TAIL)
            & (F.length(c) >= len(COPY_HEAD) + len(COPY_TAIL)))


def _marked(lines: DataFrame, chunk_lines: int) -> DataFrame:
    return (lines.withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines))
            .withColumn("_start", F.when(is_copy_start(), F.col("line_no")))
            .withColumn("_end", F.when(F.col("line") == COPY_END, F.col("line_no"))))


def _carried(marked: DataFrame) -> DataFrame:
    """Per chunk of a file: the line number of the COPY statement still open when it begins.

    One aggregate gives a short row per chunk (its list of COPY lines is bounded by the chunk
    size); only those rows are ordered file-wide.
    """
    chunk = ["file", "_chunk"]
    chunks = marked.groupBy(*chunk).agg(F.max("_end").alias("_chunk_end"),
                                        F.collect_list("_start").alias("_starts"))
    # what a chunk leaves open: its first start after its last end
    after_end = F.filter("_starts", lambda s: s > F.coalesce(F.col("_chunk_end"), F.lit(-1)))
    in_file = W.partitionBy("file").orderBy("_chunk")
    since_end = W.partitionBy("file", "_ends").orderBy("_chunk")
    return (chunks.withColumn("_left_open", F.array_min(after_end))
            .withColumn("_ends", F.count("_chunk_end").over(in_file))
            .withColumn("_open_after", F.min("_left_open").over(since_end))
            .withColumn("_carried", F.lag("_open_after").over(in_file))
            .select(*chunk, "_carried"))


def copy_state(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add `copy_start`: the line number of the COPY statement whose data block a line belongs
    to (its end marker included), or NULL for lines outside any block.

    The first COPY statement after an end marker opens a block; a start inside a block is data,
    an end outside one means nothing. Lines are shuffled once, by chunk of a file, so a huge
    file is spread over many tasks; the block left open by earlier chunks is carried over.
    """
    marked = _marked(lines, chunk_lines)

    def before(*keys: str):
        return W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)

    state = (marked.join(_carried(marked), ["file", "_chunk"])
             .withColumn("_last_end", F.coalesce(F.max("_end").over(before("file", "_chunk")), F.lit(-1)))
             .withColumn("_local", F.min("_start").over(before("file", "_chunk", "_last_end"))))
    opened = F.when(F.col("_last_end") < 0, F.coalesce("_carried", "_local")) \
        .otherwise(F.col("_local"))
    return state.select(*lines.columns, opened.alias("copy_start"))


def drop_extension_statements(lines: DataFrame, names: Sequence[str],
                              chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Drop CREATE and COMMENT statements of the named extensions, never data inside COPY.

    Most lines cannot be such a statement and pass without a shuffle. The state is worked out
    for the others alone: it depends on the COPY and end lines only, which go along.
    """
    if not names:
        return lines
    pattern = EXTENSION.replace("{names}", "|".join(names))
    c = F.col("line")
    statement = ((c.startswith("CREATE EXTENSION") | c.startswith("COMMENT ON EXTENSION"))
                 & c.rlike(pattern))
    relevant = lines.filter(statement | is_copy_start() | (c == COPY_END))
    data = copy_state(relevant, chunk_lines).filter(statement & F.col("copy_start").isNotNull())
    return lines.filter(~F.coalesce(statement, F.lit(False))).unionByName(data.select(*lines.columns))


def copy_block_stats(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Table name and data rows of every COPY block; a block without an end counts as it is.

    Line numbers are dense, so a block's rows are those between its COPY statement and its end. Only
    COPY and end lines are shuffled, and of them no more than the table's name; a block without
    an end runs to the file's last line.
    """
    name = F.regexp_extract("line", r"^COPY ([^ (]+)", 1)
    # the shape that tells a start from an end is all that the state needs of a line
    marks = lines.filter(is_copy_start() | (F.col("line") == COPY_END)).select(
        "file", "line_no", F.when(is_copy_start(), F.concat(F.lit(COPY_HEAD), name, F.lit(COPY_TAIL)))
        .otherwise(F.col("line")).alias("line"))
    state = copy_state(marks, chunk_lines)
    ends = (state.filter((F.col("line") == COPY_END) & F.col("copy_start").isNotNull())
            .select("file", "copy_start", F.col("line_no").alias("_end")))
    opens = state.filter(is_copy_start() & F.col("copy_start").isNull()).select(
        "file", F.col("line_no").alias("copy_start"), F.regexp_extract("line", r"^COPY ([^ (]+)", 1).alias("table"))
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    return (opens.join(ends, ["file", "copy_start"], "left").join(last, "file")
            .select("file", "copy_start", "table",
                    (F.coalesce(F.col("_end") - 1, F.col("_last")) - F.col("copy_start")).alias("rows")))


def clean_mysql_dump(lines: DataFrame) -> DataFrame:
    """Drop the two warning lines, turn over-long VARCHARs into TEXT, and put the statement that
    switches key checks off before each file (line 0)."""
    c = F.col("line")
    kept = lines.filter(~c.startswith("mysqldump: [Warning]") & ~c.startswith("Warning: Using a password"))
    fixed = kept.withColumn("line", F.when(
        c.contains("VARCHAR("), F.regexp_replace(c, F.lit(LONG_VARCHAR), F.lit("TEXT"))).otherwise(c))
    head = lines.select("file").distinct().select(
        "file", F.lit(0).cast(lines.schema["line_no"].dataType).alias("line_no"),
        F.lit(FAST_IMPORT).alias("line"))
    return fixed.select("file", "line_no", "line").unionByName(head)


def dump_warnings(lines: DataFrame) -> DataFrame:
    """Error output worth showing: the cosmetic password warning and blank lines are dropped."""
    c = F.col("line")
    return lines.filter(~c.rlike(PASSWORD_NOISE) & (c != ""))


def dump_warning_counts(lines: DataFrame) -> DataFrame:
    """Per file: warning lines, real errors, and whether there is anything worth showing."""
    c = F.col("line")
    noise = c.rlike(PASSWORD_NOISE)
    return (lines.groupBy("file")
            .agg(F.count_if(c.rlike(ANY_WARNING)).alias("warnings"),
                 F.count_if(c.rlike(REAL_ERROR)).alias("errors"),
                 F.count_if(~noise & (c != "")).alias("shown"))
            .withColumn("report", F.col("shown") > 0))


def engine_of_head(head: Column | str) -> Column:
    """Engine from the beginning of a dump: a binary one starts with its magic, a text one names its
    engine in the comment lines before the first statement, however many they are."""
    c = F.col(head) if isinstance(head, str) else head
    comments = F.regexp_extract(c, HEAD_COMMENTS, 0)
    return F.when(c.startswith(PG_MAGIC) | comments.contains("PostgreSQL"), "postgres") \
        .otherwise("mysql")


def detect_engine(files: DataFrame) -> DataFrame:
    """Engine of `(file, head, meta_type, host_type)` rows: sidecar, then host, then content."""

    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    return files.select("file", F.coalesce(filled("meta_type"), filled("host_type"),
                                           engine_of_head("head")).alias("engine"))
