"""Schedule shorthand: `hourly`, `daily[@H]`, `weekly[@D:H]`, anything else is cron text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_HOUR = 2
DEFAULT_DAY = 0


def parse_schedule(when: Column | str) -> Column:
    """Five-field cron text."""
    s = F.col(when) if isinstance(when, str) else when
    week_tail = F.regexp_extract(s, r"^weekly@(.*)$", 1)
    day = F.when(week_tail.contains(":"), F.regexp_extract(week_tail, r"^(.*):[^:]*$", 1)) \
        .otherwise(week_tail)
    hour = F.when(week_tail.contains(":"), F.regexp_extract(week_tail, r"^[^:]*:(.*)$", 1)) \
        .otherwise(week_tail)
    return (
        F.when(s == "hourly", "0 * * * *")
        .when(s == "daily", f"0 {DEFAULT_HOUR} * * *")
        .when(s.startswith("daily@"),
              F.concat(F.lit("0 "), F.regexp_extract(s, r"^daily@(.*)$", 1), F.lit(" * * *")))
        .when(s == "weekly", f"0 {DEFAULT_HOUR} * * {DEFAULT_DAY}")
        .when(s.startswith("weekly@"), F.concat(F.lit("0 "), hour, F.lit(" * * "), day))
        .otherwise(s)
    )


def _whole(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("int"))


def next_fire(when: Column | str, now: Column) -> Column:
    """Next UTC run after `now` (a timestamp without zone); NULL for an hour or day out of
    range or an empty text; cron text gives the next midnight as a plausible stand-in."""
    raw = F.col(when) if isinstance(when, str) else when
    s = F.trim(raw)
    midnight = F.date_trunc("DAY", now).cast("timestamp_ntz")

    def plus(ts: Column, days: Column | None = None, hours: Column | None = None) -> Column:
        zero = F.lit(0)
        return ts + F.make_dt_interval(zero if days is None else days,
                                       zero if hours is None else hours)

    hourly = plus(F.date_trunc("HOUR", now).cast("timestamp_ntz"), hours=F.lit(1))

    day_hour = F.when(s == "daily", F.lit(DEFAULT_HOUR)) \
        .otherwise(_whole(F.regexp_extract(s, r"^daily@(.*)$", 1)))
    daily_at = plus(midnight, hours=day_hour)
    daily = F.when(day_hour.between(0, 23),
                   F.when(daily_at <= now, plus(daily_at, days=F.lit(1))).otherwise(daily_at))

    tail = F.regexp_extract(s, r"^weekly@(.*)$", 1)
    week_day = F.when(s == "weekly", F.lit(DEFAULT_DAY)) \
        .otherwise(_whole(F.regexp_extract(tail, r"^([^:]*):.*$", 1)))
    week_hour = F.when(s == "weekly", F.lit(DEFAULT_HOUR)) \
        .otherwise(_whole(F.regexp_extract(tail, r"^[^:]*:(.*)$", 1)))
    # dayofweek: 1 = Sunday, schedule day: 0 = Sunday
    ahead = F.pmod(week_day - (F.dayofweek(now) - 1), F.lit(7)).cast("int")
    weekly_at = plus(midnight, days=ahead, hours=week_hour)
    weekly = F.when(week_day.between(0, 6) & week_hour.between(0, 23),
                    F.when(weekly_at <= now, plus(weekly_at, days=F.lit(7))).otherwise(weekly_at))

    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("timestamp_ntz"))
        .when(s == "hourly", hourly)
        .when((s == "daily") | s.startswith("daily@"), daily)
        .when((s == "weekly") | s.startswith("weekly@"), weekly)
        .otherwise(plus(midnight, days=F.lit(1)))
    )
