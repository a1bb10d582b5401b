"""User code over the tables of a clone: SQL hooks, provenance and free transforms."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.operators.masking import SECRET_SENTINEL
from tablecloak.session import scratch_path

log = logging.getLogger("tablecloak")

# A session's views have the tables' own names; one hook at a time may be planned over them.
_VIEWS = threading.Lock()

# The variables a hook can use.
HOOK_VARS = ("target_db", "source_host", "source_db", "backup_file", "backup_timestamp",
             "restored_at")


class HookError(RuntimeError):
    """A hook that is malformed or failed; the tables made so far are in `tables`."""

    def __init__(self, message: str, tables: Mapping[str, DataFrame]):
        super().__init__(message)
        self.tables = dict(tables)


def hook_text(hook: Mapping, base_dir: str = ".") -> str:
    """SQL of a hook that has exactly one of `sql` and `file`."""
    if ("sql" in hook) == ("file" in hook):
        raise ValueError("entry needs exactly one of 'sql' and 'file'")
    if "sql" in hook:
        return hook["sql"]
    path = Path(hook["file"])
    path = path if path.is_absolute() else Path(base_dir) / path
    if not path.is_file():
        raise ValueError(f"file not found: {path}")
    return path.read_text()


def apply_hooks(spark: SparkSession, tables: Mapping[str, DataFrame], host_hooks: Sequence[Mapping],
                db_hooks: Sequence[Mapping], variables: Mapping[str, str],
                safety: str = "local", base_dir: str = ".") -> dict[str, DataFrame]:
    """Run host hooks, then database hooks, in order.

    A hook is a query over the tables as temporary views, which are gone afterwards; its result replaces the table named
    by `into`. Variables are bound as named parameters, never pasted into the text. Each result is
    written before the next hook starts, so the hook that fails is the one that stops the run, and
    the tables made so far come with the error. Hosts marked `prod` are refused.
    """
    out = dict(tables)
    hooks = [("host", h) for h in host_hooks] + [("db", h) for h in db_hooks]
    if not hooks:
        return out
    if safety == "prod":
        raise HookError("refusing hooks: the host's safety is prod", out)
    args = {k: variables.get(k, "") for k in HOOK_VARS}
    for i, (source, hook) in enumerate(hooks):
        try:
            text, into = hook_text(hook, base_dir), hook["into"]
            used = {k: v for k, v in args.items() if f":{k}" in text}
            with _VIEWS:
                result = _over_views(spark, text, used, out)
            path = scratch_path(spark, "hook")
            result.write.parquet(path)
            out[into] = spark.read.schema(result.schema).parquet(path)
            log.info("hook %d/%d (%s) -> %s", i + 1, len(hooks), source, into)
        except Exception as e:
            raise HookError(f"hook {i} ({source}): {e}", out) from e
    return out


def _over_views(spark: SparkSession, text: str, args: Mapping[str, str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """A query over the tables as views. A view of the user that has a table's name is back afterwards."""
    names = {n.lower() for n in tables}
    own = {t.name: spark.table(f"`{t.name}`") for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in names}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text, args=args)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in own.items():
            df.createOrReplaceTempView(name)


def stamp_provenance(df: DataFrame, variables: Mapping[str, str]) -> DataFrame:
    """Record on every row where the clone came from."""
    return df.withColumns({k: F.lit(variables.get(k, "")) for k in HOOK_VARS})


def transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User code between snapshot and target; it must return a DataFrame."""
    out = df.transform(fn)
    if not isinstance(out, DataFrame):
        raise TypeError("a transform must return a DataFrame")
    return out


def transform_batches(df: DataFrame, fn: Callable[[Iterable], Iterable], schema: str) -> DataFrame:
    """User code over Arrow batches of a partition."""
    return df.mapInPandas(fn, schema)


def safe_message(error: Exception, secret: str) -> str:
    """Error text without the seed."""
    text = str(error)
    return text.replace(secret, SECRET_SENTINEL) if secret else text
