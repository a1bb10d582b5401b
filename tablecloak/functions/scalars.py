"""Small formatting and parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted snapshot file endings and name rules.
SNAPSHOT_NAME = r"\.sql\.zst(\.age|\.gpg)?$"
IDENT = r"^[A-Za-z_][A-Za-z0-9_]*$"
JSON_PATH = r"^\$(\.[A-Za-z_][A-Za-z0-9_]*)+$"
ALIAS = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_duration(col: Column | str) -> Column:
    """Seconds as `Ns`, `Xm Ys` or `Xh Ym Zs`; anything but a plain number gives `0s`."""
    text = _col(col).cast("string")
    sec = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return (
        F.when(sec.isNull(), F.lit("0s"))
        .when(sec < 60, F.format_string("%ds", sec))
        .when(sec < 3600, F.format_string("%dm %ds", F.floor(sec / 60), sec % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(sec / 3600),
                                   F.floor((sec % 3600) / 60), sec % 60))
    )


def human_size(col: Column | str) -> Column:
    """Bytes as whole B, KB, MB or GB, rounded down."""
    size = _col(col).cast("bigint")

    def unit(factor: int, name: str) -> Column:
        return F.concat(F.shiftright(size, factor).cast("string"), F.lit(name))

    return (
        F.when(size < 1 << 10, unit(0, "B"))
        .when(size < 1 << 20, unit(10, "KB"))
        .when(size < 1 << 30, unit(20, "MB"))
        .otherwise(unit(30, "GB"))
    )


def parse_backup_timestamp(name: Column | str) -> Column:
    """The first `_YYYYMMDD_HHMMSS` in a file name as ISO-8601 text, else an empty string."""
    digits = r"_([0-9]{4})([0-9]{2})([0-9]{2})_([0-9]{2})([0-9]{2})([0-9]{2})"
    g = [F.regexp_extract(_col(name), digits, i) for i in range(1, 7)]
    iso = F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit("T"),
                   g[3], F.lit(":"), g[4], F.lit(":"), g[5], F.lit("Z"))
    return F.when(_col(name).rlike(digits), iso).otherwise(F.lit(""))


def coerce_int(text: Column | str) -> Column:
    """Whole number or NULL, never an error."""
    trimmed = F.trim(_col(text))
    return F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))


def parse_iso_utc(text: Column | str) -> Column:
    """ISO-8601 text as a UTC timestamp without zone; text without an offset counts as UTC."""
    shape = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
             r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$")
    c = _col(text)
    zoned = F.when(c.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    dated = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(zoned)
    parsed = F.when(c.rlike(shape), dated.try_cast("timestamp"))
    return F.to_utc_timestamp(parsed, F.current_timezone()).cast("timestamp_ntz")


def iso_z(ts: Column | str) -> Column:
    """Timestamp as `YYYY-MM-DDTHH:MM:SSZ`."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a UTC timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts))


def encryption_of(name: Column | str) -> Column:
    c = _col(name)
    return F.when(c.endswith(".age"), "age").when(c.endswith(".gpg"), "gpg").otherwise("none")


def valid_ident(name: Column | str) -> Column:
    return _col(name).rlike(IDENT)


def valid_json_path(path: Column | str) -> Column:
    return _col(path).rlike(JSON_PATH)


def valid_alias(name: Column | str) -> Column:
    """Rule for host and database names."""
    return _col(name).rlike(ALIAS)


def parse_name_list(text: Column | str) -> Column:
    """Names split at commas and blanks, without empty ones."""
    return F.filter(F.split(_col(text), "[, \t\n]+"), lambda x: x != "")
