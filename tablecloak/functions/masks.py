"""Masking expressions. Each takes and returns a Column; NULL stays NULL unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the fake values, checked again by the post-conditions.
PHONE_PREFIX = "+1555"
IP_PREFIX = "192.0.2."
NAME_PREFIX = "Person_"
DEFAULT_DOMAIN = "masked.test"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _seed(seed: Column | str) -> Column:
    return F.lit(seed) if isinstance(seed, str) else seed


def seeded_hash(col: Column | str, seed: Column | str) -> Column:
    """md5(seed || text): equal inputs give equal fakes in every table and every run. A seed given as
    text becomes a literal of the plan; `session.secret_column` keeps it out of there."""
    return F.md5(F.concat(_seed(seed), _col(col).cast("string")))


def _hash_int(digest: Column) -> Column:
    """First 32 bits of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def email_from(digest: Column, domain: str = DEFAULT_DOMAIN) -> Column:
    return F.concat(digest, F.lit("@" + domain))


def phone_from(digest: Column) -> Column:
    return F.concat(F.lit(PHONE_PREFIX), F.substring(digest, 1, 7))


def ip_from(digest: Column) -> Column:
    return F.concat(F.lit(IP_PREFIX), (_hash_int(digest) % 255).cast("string"))


def name_from(digest: Column) -> Column:
    return F.concat(F.lit(NAME_PREFIX), digest)


def fake_email(col: Column | str, seed: Column | str, domain: str = DEFAULT_DOMAIN) -> Column:
    return email_from(seeded_hash(col, seed), domain)


def fake_phone(col: Column | str, seed: Column | str) -> Column:
    return phone_from(seeded_hash(col, seed))


def fake_ip(col: Column | str, seed: Column | str) -> Column:
    return ip_from(seeded_hash(col, seed))


def fake_name(col: Column | str, seed: Column | str) -> Column:
    return name_from(seeded_hash(col, seed))


def redact(data_type: str = "string", replacement: str | None = None) -> Column:
    """NULL of the column's type, or a constant that overwrites NULLs too."""
    return F.lit(replacement).cast(data_type)


def truncate(col: Column | str, length: int) -> Column:
    """First `length` characters (not bytes)."""
    return F.substring(_col(col), 1, length)


def day_offset(col: Column | str, seed: Column | str, max_days: int,
               key_cols: Sequence[str] = ("id",)) -> Column:
    """Days in [-max_days, +max_days], fixed by the value and the row key."""
    parts = [_seed(seed), _col(col).cast("string")]
    parts += [F.col(k).cast("string") for k in key_cols]
    return (_hash_int(F.md5(F.concat(*parts))) % (2 * max_days + 1) - max_days).cast("int")


def shift_date(col: Column | str, seed: Column | str, max_days: int,
               key_cols: Sequence[str] = ("id",), data_type: str = "date") -> Column:
    """Move a date or timestamp by `day_offset` whole days."""
    days = day_offset(col, seed, max_days, key_cols)
    if data_type == "date":
        return F.date_add(_col(col), days)
    return (_col(col) + F.make_dt_interval(days)).cast(data_type)


def passthrough(col: Column | str) -> Column:
    return _col(col)
