"""Audit-log analytics, schedule planning and notification texts.

Audit rows hold text only: `seq` (line order), `timestamp` (ISO-8601 Z), `action`, `outcome`,
`db_host`, `database` and optional extras.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.functions.scalars import (coerce_int, epoch_seconds, human_size, iso_z,
                                          parse_iso_utc)
from tablecloak.functions.schedules import next_fire

# Action and outcome names that can be asked for.
ACTIONS = ("backup", "restore", "scrub_bypass", "restore_into",
           "vault_set", "vault_delete", "vault_get")
OUTCOMES = ("success", "failure")
DAY, WEEK = 86400, 604800


Moment = dt.date | str | None


def as_moment(value: Moment) -> dt.date | None:
    """A date or a time from ISO text; text that is neither is no bound."""
    if not isinstance(value, str):
        return value
    for read in (dt.date.fromisoformat, dt.datetime.fromisoformat):
        try:
            return read(value)
        except ValueError:
            continue
    return None


def within(time: Column, first: Moment, last: Moment) -> Column:
    """Times from `first` to `last`; a bound without a time of day takes in its whole day. Text in
    ISO form sorts like time, so the bounds reach the scan."""
    cond, low, high = F.lit(True), as_moment(first), as_moment(last)
    if low is not None:
        cond = cond & (time >= _utc_text(low))
    if isinstance(high, dt.datetime):
        cond = cond & (time <= _utc_text(high))
    elif high is not None:
        cond = cond & (time < _utc_text(high + dt.timedelta(days=1)))
    return cond


def _utc_text(moment: dt.date) -> str:
    if isinstance(moment, dt.datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(dt.timezone.utc)
        return f"{moment:%Y-%m-%dT%H:%M:%SZ}"
    return f"{moment:%Y-%m-%d}T00:00:00Z"


def entry_text(audit: DataFrame) -> Column:
    """An entry as JSON text with sorted keys and without absent ones, `{"a": "1", "b": "2"}`; fields
    in the map `extras` are part of it."""

    def field(key: Column, value: Column) -> Column:
        one, name = F.to_json(F.array(value)), F.to_json(F.array(key))
        text = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(": "),
                        F.substring(one, F.lit(2), F.length(one) - 2))
        return F.struct(key.alias("k"), text.alias("t"))

    fields = F.array_compact(F.array(*[
        F.when(F.col(f"`{c}`").isNotNull(), field(F.lit(c), F.col(f"`{c}`").cast("string")))
        for c in sorted(audit.columns) if c not in ("seq", "extras")]))
    if "extras" in audit.columns:
        more = F.transform(F.map_entries("extras"), lambda e: field(e["key"], e["value"]))
        fields = F.sort_array(F.concat(fields, F.coalesce(more, F.slice(fields, 1, 0))))
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: x["t"]), ", "), F.lit("}"))


def audit_filter(audit: DataFrame, action: str | None = None, outcome: str | None = None,
                 from_ts: Moment = None, to_ts: Moment = None, regex: str | None = None) -> Column:
    """All given conditions; the cheap ones come first."""
    if action and action not in ACTIONS:
        raise ValueError(f"unknown action '{action}'")
    if outcome and outcome not in OUTCOMES:
        raise ValueError(f"unknown outcome '{outcome}'")
    cond = F.lit(True)
    if action:
        cond = cond & (F.col("action") == action)
    if outcome:
        cond = cond & (F.col("outcome") == outcome)
    cond = cond & within(F.col("timestamp"), from_ts, to_ts)
    if regex:
        cond = cond & entry_text(audit).rlike(regex)
    return cond


def audit_search(audit: DataFrame, limit: int | None = None, **filters: str | None) -> DataFrame:
    """The matching entries, newest first; with `limit` the newest so many, of which Spark keeps
    `limit` rows per task without a full sort."""
    found = audit.filter(audit_filter(audit, **filters)).orderBy(F.desc("seq"))
    return found if limit is None else found.limit(limit)


def audit_counts(audit: DataFrame, **filters: str | None) -> DataFrame:
    return audit.agg(F.count("*").alias("total"),
                     F.count_if(audit_filter(audit, **filters)).alias("filtered"))


def _tail(audit: DataFrame, rows: int | None) -> DataFrame:
    """All of the log, or its last `rows` lines where a caller asks for a recent part."""
    if rows is None:
        return audit
    last = audit.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    return audit.filter(F.col("seq") > last - rows)


def _baseline_keys(action: str) -> list[str]:
    """Backups are compared per pair; other actions carry no pair and are compared globally."""
    return ["db_host", "database"] if action == "backup" else []


def last_duration(audit: DataFrame, action: str, tail_rows: int | None = None) -> DataFrame:
    """Duration of the last successful entry that has a whole-number duration."""
    ok = _tail(audit, tail_rows).filter(
        (F.col("action") == action) & (F.col("outcome") == "success")
        & F.col("duration_sec").rlike("^[0-9]+$"))
    value = F.max(F.struct("seq", F.col("duration_sec").cast("bigint").alias("v")))["v"]
    return ok.groupBy(*_baseline_keys(action)).agg(value.alias("duration_sec"))


def last_size(audit: DataFrame, action: str, tail_rows: int | None = None) -> DataFrame:
    """Size of the last successful entry with any size; NULL when that one is no number."""
    ok = _tail(audit, tail_rows).filter(
        (F.col("action") == action) & (F.col("outcome") == "success") & F.col("size").isNotNull())
    size = F.when(F.col("size").rlike("^[0-9]+$"), F.col("size").try_cast("bigint"))
    value = F.max(F.struct("seq", size.alias("v")))["v"]
    return ok.groupBy(*_baseline_keys(action)).agg(value.alias("size"))


def backup_runs(audit: DataFrame) -> DataFrame:
    """Finished backups with a pair and a readable time."""
    return (audit.filter((F.col("action") == "backup") & F.col("outcome").isin(*OUTCOMES)
                         & F.col("db_host").isNotNull() & F.col("database").isNotNull())
            .withColumn("ts", parse_iso_utc("timestamp")).filter(F.col("ts").isNotNull()))


def _newest(cond: Column | None, *fields: Column) -> Column:
    """The fields of the newest row; of equally new rows the first in the log."""
    row = F.struct(F.col("ts"), (-F.col("seq")).alias("order"), *fields)
    return F.max(row if cond is None else F.when(cond, row))


def last_outcomes(audit: DataFrame) -> DataFrame:
    """Newest success and newest failure of each pair in one aggregate."""
    extra = [F.col(c) for c in ("size", "file", "error") if c in audit.columns]
    agg = backup_runs(audit).groupBy("db_host", "database").agg(
        _newest(F.col("outcome") == "success", *extra).alias("s"),
        _newest(F.col("outcome") == "failure", *extra).alias("f"))
    text = F.lit(None).cast("string")

    def field(struct: str, name: str) -> Column:
        return F.col(f"{struct}.{name}") if name in audit.columns else text

    return agg.select(
        "db_host", "database", F.col("s.ts").alias("success_ts"), F.col("f.ts").alias("failure_ts"),
        field("s", "size").alias("success_size"), field("s", "file").alias("success_file"),
        F.when(F.col("f").isNotNull(), F.coalesce(field("f", "error"), F.lit(""))).alias("failure_error"))


def last_run(audit: DataFrame) -> DataFrame:
    """Time and outcome of the newest finished backup of each pair."""
    return (backup_runs(audit).groupBy("db_host", "database")
            .agg(_newest(None, F.col("outcome")).alias("r"))
            .select("db_host", "database", iso_z("r.ts").alias("last_run_at"),
                    F.col("r.outcome").alias("last_outcome")))


def secret_last_set(audit: DataFrame) -> DataFrame:
    """When each account's secret was last stored."""
    return (audit.filter((F.col("action") == "vault_set") & (F.col("outcome") == "success")
                         & F.col("account").isNotNull() & F.col("timestamp").isNotNull())
            .groupBy("account").agg(F.max("timestamp").alias("last_set")))


def weekly_trend(audit: DataFrame, now: str, weeks: int = 8) -> DataFrame:
    """Successful backups and bytes in 7-day buckets that end at `now`, oldest first."""
    moment = F.lit(now).cast("timestamp_ntz")
    ago = F.floor((epoch_seconds(moment) - epoch_seconds("ts")) / WEEK)
    counted = (audit.filter((F.col("action") == "backup") & (F.col("outcome") == "success"))
               .withColumn("ts", parse_iso_utc("timestamp"))
               .withColumn("bucket", F.lit(weeks - 1) - ago)
               .filter(F.col("bucket").between(0, weeks - 1) & (F.col("ts") <= moment))
               .groupBy("bucket").agg(F.count("*").alias("backups"),
                                      F.sum(F.coalesce(coerce_int("size"), F.lit(0))).alias("bytes")))
    axis = audit.sparkSession.range(weeks).withColumnRenamed("id", "bucket")
    end = moment - F.make_dt_interval((F.lit(weeks - 1) - F.col("bucket")).cast("int") * 7)
    return (axis.join(counted, "bucket", "left")
            .select("bucket", F.date_format(end, "MMM dd").alias("label"),
                    F.coalesce("backups", F.lit(0)).alias("backups"),
                    F.coalesce("bytes", F.lit(0)).alias("bytes"))
            .orderBy("bucket"))


def freshness_cards(catalog: DataFrame, audit: DataFrame, schedules: DataFrame,
                    now: str) -> DataFrame:
    """One row per pair that has files: last success, age, status, last failure, next run;
    worst first. All three inputs are reduced to one row per pair before they meet."""
    moment = F.lit(now).cast("timestamp_ntz")
    files = catalog.groupBy("host", "database").agg(
        F.max(F.struct("mtime", "size", "file")).alias("n"), F.count("*").alias("files"),
        F.sum("size").alias("bytes"))
    runs = last_outcomes(audit).withColumnRenamed("db_host", "host")
    plan = (schedules.filter(F.col("when").isNotNull()).groupBy("host", "database")
            .agg(F.max("when").alias("when")))
    seen = F.col("success_ts").isNotNull()
    success = F.coalesce("success_ts", F.col("n.mtime"))
    # whole seconds toward zero; fractions never change the status
    age = epoch_seconds(moment) - epoch_seconds(success)
    rank = F.when(F.col("status") == "stale", 0).when(F.col("status") == "aging", 1).otherwise(2)
    return (files.join(runs, ["host", "database"], "left").join(plan, ["host", "database"], "left")
            .select("host", "database",
                    iso_z(success).alias("last_success"),
                    F.greatest(F.lit(0), age).alias("age_seconds"),
                    F.when(seen, coerce_int("success_size")).otherwise(F.col("n.size"))
                    .alias("last_size"),
                    F.coalesce(F.when(seen, F.col("success_file")), F.col("n.file")).alias("last_file"),
                    F.when(age < DAY, "fresh").when(age < WEEK, "aging").otherwise("stale")
                    .alias("status"),
                    iso_z("failure_ts").alias("last_failure"), "failure_error", "when",
                    iso_z(next_fire(F.col("when"), moment)).alias("next_at"), "files", "bytes")
            .orderBy(rank, F.desc("age_seconds"), "host", "database"))


def freshness_summary(cards: DataFrame) -> DataFrame:
    """Totals over the cards of `freshness_cards`."""
    return cards.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("total_backups"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("host").alias("hosts"), F.count("*").alias("databases"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "aging", "stale")])


def bypass_report(audit: DataFrame) -> DataFrame:
    """Restores for which the masking gate did not run, per source host and target. Such entries name
    the host (`host`, or `db_host` in older lines) and what was restored into: a `target` database, a
    container (`into_container`), or the `database` itself."""
    def first(*names: str) -> Column:
        there = [F.col(c) for c in names if c in audit.columns]
        return F.coalesce(*there, F.lit(None).cast("string"))

    return (audit.filter(F.col("action") == "scrub_bypass")
            .groupBy(first("host", "db_host").alias("host"),
                     first("target", "into_container", "database").alias("target"))
            .agg(F.count("*").alias("bypasses"), F.max("timestamp").alias("last_bypass")))


def schedule_sync_plan(desired: DataFrame, installed: DataFrame) -> DataFrame:
    """`install`, `update`, `nochange` or `orphan` per pair; disabled rows are not desired."""
    want = desired.filter(F.coalesce("enabled", F.lit(True))).groupBy("host", "database").agg(
        F.max("when").alias("want"), F.lit(True).alias("_w"))
    have = installed.groupBy("host", "database").agg(
        F.max("when").alias("have"), F.lit(True).alias("_h"))
    action = (F.when(F.col("_h").isNull(), "install").when(F.col("_w").isNull(), "orphan")
              .when(~F.col("want").eqNullSafe(F.col("have")), "update").otherwise("nochange"))
    return want.join(have, ["host", "database"], "full").select(
        action.alias("action"), "host", "database",
        F.when(F.col("_w").isNull(), F.col("have")).otherwise(F.col("want")).alias("when"))


def schedule_upsert(schedules: DataFrame, new: DataFrame) -> DataFrame:
    """Set `when` for given pairs, keeping `enabled` and `keep`; add pairs that are new."""
    latest = new.groupBy("host", "database").agg(F.max("when").alias("_when"))
    return (schedules.join(latest, ["host", "database"], "full")
            .withColumn("when", F.coalesce("_when", "when")).select(*schedules.columns))


def schedule_delete(schedules: DataFrame, pairs: DataFrame) -> DataFrame:
    return schedules.join(pairs.select("host", "database").distinct(), ["host", "database"],
                          "left_anti")


def _wanted(outcome: Column, on: str) -> Column:
    if on == "all":
        return F.lit(True)
    return outcome == ("success" if on == "success" else "failure")


def notify_filter(events: DataFrame, on: str = "failure") -> DataFrame:
    """Events the policy lets through (`failure` unless it is `success` or `all`), with the
    title and message to send."""
    optional = {c: F.col(c) if c in events.columns else F.lit(None).cast("string")
                for c in ("file", "error", "target_db", "size")}
    pair = F.concat(F.col("database"), F.lit("@"), F.col("db_host"))
    error = F.coalesce(optional["error"], F.lit("no reason given"))
    size = human_size(F.coalesce(coerce_int(optional["size"]), F.lit(0)))
    target = F.coalesce(optional["target_db"], F.col("database"))
    backup, good = F.col("action") == "backup", F.col("outcome") == "success"
    base = F.element_at(F.split(F.coalesce(optional["file"], F.lit("")), "/"), -1)
    what = F.when(backup, F.lit("backup")).otherwise(F.lit("restore"))
    title = F.concat(what, F.when(good, F.lit(" ok: ")).otherwise(F.lit(" FAILED: ")),
                     F.when(backup, F.col("database")).otherwise(target))
    message = (
        F.when(backup & good, F.concat(pair, F.lit(" is stored, "), size))
        .when(backup, F.concat(pair, F.lit(" is not stored. "), error))
        .when(good, F.concat(target, F.lit(" is loaded from "), F.coalesce(optional["file"], F.lit(""))))
        .otherwise(F.concat(target, F.lit(" is not loaded from "), base, F.lit(". "), error)))
    return (events.filter(F.col("action").isin("backup", "restore") & _wanted(F.col("outcome"), on))
            .select(*events.columns, title.alias("title"), message.alias("message")))
