"""Check masking manifests: one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.functions.scalars import JSON_PATH

# The strategies a manifest may name.
STRATEGIES = ("fake_email", "fake_phone", "fake_ip", "fake_name", "redact", "truncate",
              "shift_date", "passthrough", "jsonb_scrub_paths")
LEAF_UNSUPPORTED = ("truncate", "shift_date")
ENV_NAME = "^[A-Z_][A-Z0-9_]*$"
COUNT = "^0*[1-9][0-9]*$"

ERROR = "struct<table:string,column:string,rule:string,detail:string>"


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _kind(v: Column) -> Column:
    """JSON type of a value; absent counts as null."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean").otherwise("number"))


def _is(v: Column, kind: str) -> Column:
    """Whether a present value is an `OBJECT`, `ARRAY` or `STRING`."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _entries(v: Column) -> Column:
    """Entries of an object; none for anything else."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    return F.map_entries(F.coalesce(
        v.try_cast("map<string,variant>"), empty))


def _error(cond: Column, rule: str, table: Column | None = None, column: Column | None = None,
           detail: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.when(cond, F.struct(
        (text if table is None else table).alias("table"),
        (text if column is None else column).alias("column"),
        F.lit(rule).alias("rule"),
        (text if detail is None else detail).alias("detail")))


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def _document_errors(text: Column, m: Column) -> Column:
    parsed = m.isNotNull()
    version, seed = _text(m, "version"), _text(m, "seed_env")
    has_seed = parsed & _get(m, "seed_env").isNotNull()
    tables = _get(m, "tables")
    absent = tables.isNull() | _is(tables, "VOID")

    def not_array(key: str) -> Column:
        v = F.try_variant_get(m, f"$.dictionary.{key}", "variant")
        return parsed & v.isNotNull() & ~_is(v, "ARRAY")

    return F.array(
        _error(text.isNull(), "manifest_missing"),
        _error(text.isNotNull() & ~parsed, "json_invalid"),
        _error(parsed & (_blank(version) | (version == "false")), "version_missing"),
        _error(parsed & ~_blank(version) & ~version.isin("1", "false"), "version_unsupported",
               detail=version),
        _error(has_seed & _blank(seed), "seed_env_empty"),
        _error(has_seed & ~_blank(seed) & ~seed.rlike(ENV_NAME), "seed_env_invalid", detail=seed),
        _error(not_array("extend"), "extend_not_array"),
        _error(not_array("exclude"), "exclude_not_array"),
        _error(parsed & absent, "tables_missing"),
        _error(parsed & ~absent & ~_is(tables, "OBJECT"), "tables_not_object", detail=_kind(tables)),
    )


def _table_errors(table: Column, t: Column) -> Column:
    no_pii = F.coalesce(_text(t, "no_pii") == "true", F.lit(False))
    has_columns = _get(t, "columns").isNotNull()
    return F.array(
        _error(no_pii & _blank(_text(t, "reason")), "no_pii_without_reason", table),
        _error(no_pii & has_columns, "no_pii_with_columns", table),
        _error(~no_pii & (F.size(_entries(_get(t, "columns"))) == 0), "table_without_columns", table),
    )


def _column_errors(table: Column, column: Column, c: Column) -> Column:
    strategy = _text(c, "strategy")
    known = strategy.isin(*STRATEGIES)

    def positive(key: str) -> Column:
        return F.coalesce(_text(c, key).rlike(COUNT), F.lit(False))

    paths, replacement = _get(c, "paths"), _get(c, "replacement")
    on_paths = strategy == "jsonb_scrub_paths"
    return F.array(
        _error(_blank(strategy), "strategy_missing", table, column),
        _error(~_blank(strategy) & ~known, "strategy_unknown", table, column, strategy),
        _error((strategy == "truncate") & ~positive("length"), "truncate_length", table, column),
        _error((strategy == "shift_date") & ~positive("max_days"), "shift_date_max_days",
               table, column),
        _error(on_paths & ~_is(paths, "OBJECT"), "paths_not_object", table, column),
        _error(on_paths & _is(paths, "OBJECT") & (F.size(_entries(paths)) == 0),
               "paths_empty", table, column),
        _error((strategy == "passthrough") & _blank(_text(c, "reason")), "passthrough_reason",
               table, column),
        _error((strategy == "redact") & replacement.isNotNull() & ~_is(replacement, "STRING"),
               "replacement_not_string", table, column),
    )


def _path_errors(table: Column, column: Column, c: Column) -> Column:
    on_paths = F.coalesce(_text(c, "strategy") == "jsonb_scrub_paths", F.lit(False))

    def one(e: Column) -> Column:
        sub = e["value"].try_cast("string")
        return F.array(
            _error(~e["key"].rlike(JSON_PATH), "path_invalid", table, column, e["key"]),
            _error(~_blank(sub) & ~sub.isin(*STRATEGIES), "path_strategy_unknown",
                   table, column, e["key"]),
            _error(sub == "jsonb_scrub_paths", "path_strategy_nested", table, column, e["key"]),
            _error(sub.isin(*LEAF_UNSUPPORTED), "path_strategy_unsupported",
                   table, column, e["key"]),
        )

    found = F.flatten(F.transform(_entries(_get(c, "paths")), one))
    return F.when(on_paths, found).otherwise(F.array().cast(f"array<{ERROR}>"))


def validate_manifests(manifests: DataFrame, id_col: str = "manifest_id",
                       text_col: str = "text") -> DataFrame:
    """Error rows `(id, table, column, rule, detail)` for many manifests in one pass.

    All rules are one row expression over the parsed text: no shuffle, and a manifest of any
    size is read once.
    """
    parsed = manifests.select(id_col, text_col, F.try_parse_json(F.col(text_col)).alias("_m"))
    m = F.col("_m")

    def table(t: Column) -> Column:
        no_pii = F.coalesce(_text(t["value"], "no_pii") == "true", F.lit(False))
        columns = F.transform(
            _entries(_get(t["value"], "columns")),
            lambda c: F.concat(_column_errors(t["key"], c["key"], c["value"]),
                               _path_errors(t["key"], c["key"], c["value"])))
        return F.concat(
            _table_errors(t["key"], t["value"]),
            F.when(no_pii, F.array().cast(f"array<{ERROR}>")).otherwise(F.flatten(columns)))

    errors = F.concat(_document_errors(F.col(text_col), m),
                      F.flatten(F.transform(_entries(_get(m, "tables")), table)))
    return (parsed.select(id_col, F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("e"))
            .select(id_col, "e.*"))


def validate_hooks(hooks: DataFrame) -> DataFrame:
    """Error rows for hook entries `(scope, idx, sql, file, file_exists)`: exactly one of
    `sql` and `file`, and the file must exist."""
    sql, file = F.col("sql").isNotNull(), F.col("file").isNotNull()
    rule = (F.when(sql & file, "both_file_and_sql").when(~sql & ~file, "neither_file_nor_sql")
            .when(file & ~F.coalesce("file_exists", F.lit(False)), "file_not_found"))
    return (hooks.withColumn("rule", rule).filter(F.col("rule").isNotNull())
            .select("scope", "idx", "rule"))
