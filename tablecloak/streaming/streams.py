"""Streaming forms: masking, running post-conditions, alerts, freshness, weekly trend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tablecloak.functions.masks import DEFAULT_DOMAIN
from tablecloak.functions.scalars import coerce_int, parse_iso_utc
from tablecloak.operators.audit import backup_runs, notify_filter
from tablecloak.operators.masking import mask_table
from tablecloak.operators.verify import violation
from tablecloak.sources.readers import AUDIT
from tablecloak.sources.snapshot import delete_path, exists, filesystem


def read_table_stream(spark: SparkSession, path: str, schema, name_glob: str = "*.parquet",
                      files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_audit_stream(spark: SparkSession, path: str, schema: str = AUDIT, files_per_trigger: int | None = None) -> DataFrame:
    """An audit log that grows by files of JSON lines; broken lines are skipped."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.json(path)
            .filter(F.col("timestamp").isNotNull() | F.col("action").isNotNull()))


def mask_stream(stream: DataFrame, columns: Mapping[str, Mapping], seed: str,
                key_cols: Sequence[str] = ("id",), domain: str = DEFAULT_DOMAIN) -> DataFrame:
    """Row by row, no state: the batch projection as it is."""
    return mask_table(stream, columns, seed, key_cols, domain)


def sniff_stream(stream: DataFrame, columns: Mapping[str, Mapping],
                 domain: str = DEFAULT_DOMAIN) -> DataFrame:
    """Running number of violations per column; the state is one counter per column."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    checks = {}
    for name, spec in sorted(columns.items()):
        cond = violation(F.col(f"`{name}`"), spec, domain, types[name])
        checks[name] = F.lit(False) if cond is None else F.coalesce(cond, F.lit(False))
    flags = F.array(*[F.struct(F.lit(n).alias("column"), c.cast("bigint").alias("bad"))
                      for n, c in checks.items()])
    return (stream.select(F.explode(flags).alias("f")).groupBy("f.column")
            .agg(F.sum("f.bad").alias("sniff_count")))


def alert_stream(stream: DataFrame, on: str = "failure") -> DataFrame:
    """Notification texts for audit events as they arrive."""
    return notify_filter(stream, on)


def violation_alerts(stream: DataFrame, columns: Mapping[str, Mapping], domain: str = DEFAULT_DOMAIN) -> DataFrame:
    """`(column, sniff_count)`: one alert when the violations of a column first exceed zero, with the count so far.

    Only violating rows are shuffled, and a column's state is one counter, so a column is told of once, also
    after a restart."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    checks = {n: violation(F.col(f"`{n}`"), spec, domain, types[n]) for n, spec in sorted(columns.items())}
    flags = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items() if c is not None],
                    F.lit(None).cast("string"))

    # a local class travels with the task, so executors need no copy of this package
    class FirstViolation(StatefulProcessor):
        def init(self, handle):
            self.count = handle.getValueState("count", "n long")

        def handleInputRows(self, key, rows, timerValues):
            before = self.count.get()[0] if self.count.exists() else 0
            now = before + sum(len(r) for r in rows)
            self.count.update((now,))
            if not before and now:
                yield pd.DataFrame({"column": [key[0]], "sniff_count": [now]})

        def close(self):
            pass

    return (stream.select(F.explode(F.array_compact(flags)).alias("column")).groupBy("column")
            .transformWithStateInPandas(FirstViolation(), "column string, sniff_count long", "update", "None"))


def staleness_alerts(stream: DataFrame, stale_after: str = "7 days", late: str = "1 hour") -> DataFrame:
    """`(db_host, database, state, last_success, at)` as pairs become stale and recover.

    A pair's state is its last success. A timer stands `stale_after` later and moves with each new success;
    when the log's own time (its newest finished backup, less `late`) passes it, the pair is stale, although no
    event of its own came. The next success after that is its recovery."""
    wait = int(stream.sparkSession.sql(f"SELECT CAST(INTERVAL {stale_after} AS INTERVAL DAY TO SECOND) AS i").first()["i"]
               .total_seconds() * 1000)

    class Staleness(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "success long, stale boolean")

        def _row(self, key, state, last, at):
            return pd.DataFrame({"db_host": [key[0]], "database": [key[1]], "state": [state],
                                 "last_success": [pd.Timestamp(last, unit="ms")], "at": [pd.Timestamp(at, unit="ms")]})

        def handleInputRows(self, key, rows, timerValues):
            newest = max((int(t) for r in rows for t in r["success"].dropna()), default=None)
            if newest is None:
                return
            before, stale = self.last.get() if self.last.exists() else (None, False)
            if before is not None and newest <= before:
                return
            if before is not None and not stale:
                self.handle.deleteTimer(before + wait)
            self.last.update((newest, False))
            self.handle.registerTimer(newest + wait)
            if stale:
                yield self._row(key, "recovered", newest, newest)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last, _ = self.last.get()
            self.last.update((last, True))
            yield self._row(key, "stale", last, expiredTimerInfo.getExpiryTimeInMs())

        def close(self):
            pass

    runs = backup_runs(stream).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    success = F.when(F.col("outcome") == "success", F.unix_millis("ts"))
    return (runs.select("db_host", "database", "ts", success.alias("success")).groupBy("db_host", "database")
            .transformWithStateInPandas(Staleness(), "db_host string, database string, state string, last_success timestamp, "
                                                     "at timestamp", "append", "EventTime"))


def freshness_stream(stream: DataFrame) -> DataFrame:
    """Time of the last successful backup of each pair; the state is one row per pair."""
    return (backup_runs(stream).filter(F.col("outcome") == "success")
            .groupBy("db_host", "database").agg(F.max("ts").alias("last_success")))


def weekly_trend_stream(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Successful backups and bytes in tumbling 7-day windows aligned to the epoch. Lines later
    than the watermark are dropped once their window is closed."""
    ok = (stream.filter((F.col("action") == "backup") & (F.col("outcome") == "success"))
          .withColumn("ts", parse_iso_utc("timestamp").cast("timestamp"))
          .withWatermark("ts", late))
    return (ok.groupBy(F.window("ts", "7 days"))
            .agg(F.count("*").alias("backups"),
                 F.sum(F.coalesce(coerce_int("size"), F.lit(0))).alias("bytes"))
            .select(F.col("window.start").alias("week_start"), "backups", "bytes"))


def run_weekly_trend(stream: DataFrame, out: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """The weekly trend with every line accounted for: `<out>/weeks` holds the weeks, `<out>/late/batch=N` the lines
    that a batch could not count any more, as their week had closed, or as their time is unreadable.

    A week closes once the log's newest time, as earlier batches saw it, is `late` past its end. The newest time is
    kept with the result, so a batch that is run again decides alike."""
    spark = stream.sparkSession
    ok = (stream.filter((F.col("action") == "backup") & (F.col("outcome") == "success"))
          .withColumn("ts", parse_iso_utc("timestamp")))
    week = F.expr("timestampadd(DAY, CAST(7 * floor(datediff(ts, DATE'1970-01-01') / 7) AS INT), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    columns = "week_start timestamp_ntz, backups bigint, bytes bigint, seen timestamp_ntz"

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = [n for n in _versions(spark, f"{out}/weeks") if n < batch_id]
        last = spark.read.schema(columns).parquet(f"{out}/weeks/version={done[-1]}") if done else None
        seen = last.agg(F.max("seen")).first()[0] if last is not None else None
        placed = batch.withColumn("week_start", week)
        open_ = F.lit(True) if seen is None else F.expr(
            f"week_start + INTERVAL 7 DAYS > TIMESTAMP_NTZ'{seen}' - INTERVAL {late}")
        counted = F.col("ts").isNotNull() & open_
        placed.filter(~F.coalesce(counted, F.lit(False))).drop("week_start").write.mode("overwrite").parquet(
            f"{out}/late/batch={batch_id}")
        fresh = placed.filter(counted).select(
            "week_start", F.lit(1).cast("bigint").alias("backups"), F.coalesce(coerce_int("size"), F.lit(0)).cast("bigint").alias("bytes"),
            F.col("ts").alias("seen"))
        every = fresh if last is None else fresh.unionByName(last)
        every.groupBy("week_start").agg(F.sum("backups").alias("backups"), F.sum("bytes").alias("bytes"), F.max("seen").alias(
            "seen")).write.mode("overwrite").parquet(f"{out}/weeks/version={batch_id}")
        for old in done[:-1]:
            delete_path(spark, f"{out}/weeks/version={old}")

    query = (ok.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write everything available as Parquet and stop; exactly once through the checkpoint."""
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_alerts(stream: DataFrame, out: str, checkpoint: str, state_partitions: int | None = None) -> StreamingQuery:
    """Run a stream with own state over everything available. Each batch of alerts is written under its own
    number, so one that is run again replaces itself."""
    spark = stream.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k) for k in settings}
    mode = "append" if "at" in stream.columns else "update"
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        query = (stream.writeStream.outputMode(mode)
                 .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    query.awaitTermination()
    return query


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Complete results under `out`, oldest first; there are two at most."""
    fs, folder = filesystem(spark, out)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("version=")) for n in names
                  if n.startswith("version=") and exists(spark, f"{out}/{n}/_SUCCESS"))


def run_latest(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str],
               state_partitions: int | None = None) -> StreamingQuery:
    """Keep the running result of an aggregation by `keys` under `out`.

    A batch brings the groups it changed, which replace their former rows; groups whose state the
    watermark has dropped stay as they were. The new result is written beside the one before it,
    which goes once a third is complete, so a batch that is run again gives the same. The number
    of state partitions is fixed when a query first starts; few suffice when the state is a few
    counters.
    """
    spark, setting = stream.sparkSession, "spark.sql.shuffle.partitions"

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = [n for n in _versions(spark, out) if n < batch_id]
        rows = batch.select("*", F.lit(1).alias("_order"))
        if done:
            last = spark.read.schema(batch.schema).parquet(f"{out}/version={done[-1]}")
            rows = rows.unionByName(last.withColumn("_order", F.lit(0)))
        newest = F.max_by(F.struct(*batch.columns), "_order").alias("_row")
        merged = rows.groupBy(*keys).agg(newest).select("_row.*")
        merged.write.mode("overwrite").parquet(f"{out}/version={batch_id}")
        for old in done[:-1]:
            delete_path(spark, f"{out}/version={old}")

    before = spark.conf.get(setting)
    try:
        if state_partitions:
            spark.conf.set(setting, str(state_partitions))
        query = (stream.writeStream.outputMode("update").foreachBatch(merge)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete result."""
    return spark.read.parquet(f"{out}/version={_versions(spark, out)[-1]}")
