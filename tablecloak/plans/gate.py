"""Jobs of several steps: the masking gate, a guarded restore, subset before masking."""

from __future__ import annotations

import datetime
import json
import logging
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.functions.masks import DEFAULT_DOMAIN
from tablecloak.operators.drift import check_manifest_drift, drift_ok
from tablecloak.operators.hooks import apply_hooks, safe_message
from tablecloak.operators.integrity import keep_recent, prune_cascade, truncate_tables
from tablecloak.operators.masking import mask_dataset
from tablecloak.operators.verify import gate_ok, sniff_report
from tablecloak.session import local_rows
from tablecloak.sources.readers import column_catalog, explode_captured_schema
from tablecloak.sources.snapshot import (META, append_audit, delete_path, exists, folder_of,
                                         publish_atomically, read_snapshot, require_intact, write_tables)

log = logging.getLogger("tablecloak")

REPORT = "scrub_report"


class GateError(RuntimeError):
    """The copy was not published; `phase` is seed, drift, update or sniff."""

    def __init__(self, phase: str, message: str):
        super().__init__(f"{phase}: {message}")
        self.phase = phase


def seed_of(manifest: Mapping, env: Mapping[str, str] | None = None) -> str:
    """The seed from the variable the manifest names. Without a name fakes are unseeded; a
    named variable that is empty is an error."""
    name = manifest.get("seed_env")
    if not name:
        log.warning("the manifest names no seed; fakes are not tied to a secret")
        return ""
    seed = (os.environ if env is None else env).get(name, "")
    if not seed:
        raise GateError("seed", f"{name} is not set")
    return seed


def _report(spark: SparkSession, folder: str, body: Mapping, rows: DataFrame | None = None) -> None:
    """`summary` is one JSON row; findings are written next to it without passing the driver."""
    local_rows(spark, [(json.dumps(body),)], "value string") \
        .write.mode("overwrite").text(f"{folder}/{REPORT}/summary")
    if rows is not None:
        rows.write.mode("overwrite").json(f"{folder}/{REPORT}/findings")


def scrub_gate(tables: Mapping[str, DataFrame], manifest: Mapping, final: str, report_dir: str, *,
               seed: str | None = None, host: str = "", source_db: str = "", verified_at: str = "",
               json_columns: Sequence[str] = (), domain: str = DEFAULT_DOMAIN) -> dict[str, DataFrame]:
    """Mask, prove and only then publish a set of tables.

    Drift stops before any data is read. Masked tables are written once to a staging path; the
    post-conditions are counted on what was written, one aggregate per table. Any failure
    removes the staging path: nothing under the final name is ever unverified.
    """
    spark = next(iter(tables.values())).sparkSession
    seed = seed_of(manifest) if seed is None else seed
    drift = check_manifest_drift(column_catalog(tables, json_columns), manifest, source_db).persist()
    try:
        if not drift_ok(drift).first()["ok"]:
            _report(spark, report_dir, {"ok": False, "phase": "drift"}, drift)
            raise GateError("drift", "the schema is not covered by the manifest")
    finally:
        drift.unpersist()

    staging = f"{final}.part-{uuid.uuid4().hex}"
    try:
        try:
            write_tables(mask_dataset(tables, manifest, seed, domain), staging)
        except Exception as e:
            _report(spark, report_dir, {"ok": False, "phase": "update"})
            raise GateError("update", safe_message(e, seed)) from None
        written = {t: spark.read.parquet(f"{staging}/{folder_of(t)}") for t in tables}
        report = sniff_report(written, manifest, domain).persist()
        ok = gate_ok(report).first()["ok"]
        body = {"ok": ok, "host": host, "source_db": source_db, "target_db": final,
                "verified_at": verified_at}
        _report(spark, report_dir, body if ok else {"ok": False, "phase": "sniff"}, report)
        report.unpersist()
        if not ok:
            raise GateError("sniff", "masked data breaks a post-condition")
        publish_atomically(spark, staging, final)
    except Exception:
        if exists(spark, staging):
            delete_path(spark, staging)
        raise
    return {t: spark.read.parquet(f"{final}/{folder_of(t)}") for t in tables}


def subset_then_mask(tables: Mapping[str, DataFrame], manifest: Mapping, seed: str, *,
                     truncate: Sequence[str] = (), fk_edges: DataFrame | None = None,
                     recent: Mapping[str, tuple[str, int, str]] | None = None,
                     prune: Sequence[tuple[str, Column]] = (),
                     edges: Sequence[tuple[str, str, str, str]] = ()) -> dict[str, DataFrame]:
    """Drop rows first, then mask what is left; all lazy, one plan per table."""
    out = truncate_tables(tables, truncate, fk_edges) if truncate else dict(tables)
    for name, (ts_col, days, now) in (recent or {}).items():
        out[name] = keep_recent(out[name], ts_col, days, now)
    for root, predicate in prune:
        out = prune_cascade(out, edges, root, predicate)
    return mask_dataset(out, manifest, seed)


def preflight(spark: SparkSession, path: str, manifest: Mapping,
              json_columns: Sequence[str] = ()) -> str:
    """`clean`, `drift` or `deferred` (no captured schema) from a snapshot's sidecar alone."""
    meta = spark.read.json(f"{path}/{META}")
    if "scrub_schema" not in meta.columns:
        return "deferred"
    catalog = explode_captured_schema(meta, ())
    named = F.concat_ws(".", "table", "column").isin(*json_columns) if json_columns else F.lit(False)
    catalog = catalog.withColumn("type", F.when(named, "json").otherwise(F.col("type")))
    return "clean" if drift_ok(check_manifest_drift(catalog, manifest, "")).first()["ok"] else "drift"


def guarded_restore(spark: SparkSession, path: str, target: str, manifest: Mapping, report_dir: str, *,
                    seed: str | None = None, host_hooks: Sequence[Mapping] = (),
                    db_hooks: Sequence[Mapping] = (), variables: Mapping[str, str] | None = None,
                    safety: str = "local", transform: Callable[[DataFrame], DataFrame] | None = None,
                    json_columns: Sequence[str] = (), audit_path: str | None = None) -> dict[str, DataFrame]:
    """Verify a snapshot, check its schema, run hooks over its tables, publish them through the
    gate, and append the outcome to the audit log."""
    start, outcome, error = time.time(), "failure", None
    try:
        require_intact(spark, path)
        if preflight(spark, path, manifest, json_columns) == "drift":
            raise GateError("drift", "the captured schema is not covered by the manifest")
        tables = read_snapshot(spark, path)
        if transform is not None:
            tables = {n: df.transform(transform) for n, df in tables.items()}
        tables = apply_hooks(spark, tables, host_hooks, db_hooks, variables or {}, safety)
        out = scrub_gate(tables, manifest, target, report_dir, seed=seed, json_columns=json_columns)
        outcome = "success"
        return out
    except Exception as e:
        error = safe_message(e, seed or "").splitlines()[0]
        raise
    finally:
        if audit_path:
            now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            row = (now, "restore", outcome, target, path, str(int(time.time() - start)), error)
            append_audit(local_rows(spark, [row], "timestamp string, action string, outcome string, "
                                    "target_db string, file string, duration_sec string, error string"),
                         audit_path)
