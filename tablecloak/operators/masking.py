"""Apply a masking manifest to tables as one projection per table."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecloak.functions import masks
from tablecloak.session import secret_column

log = logging.getLogger("tablecloak")

# Fixed value: what stands in for a secret in log text.
SECRET_SENTINEL = "<SCRUB_SEED_REDACTED>"

TEXT_STRATEGIES = ("fake_email", "fake_phone", "fake_ip", "fake_name", "truncate")
LEAF_STRATEGIES = ("fake_email", "fake_phone", "fake_ip", "fake_name", "redact", "passthrough")

# The default free-text rules, in the order they run.
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_DOMAIN = r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_REPLACEMENT = "redacted@example.com"
PHONE_PATTERN = r"\+1[0-9]{10}"
PHONE_REPLACEMENT = "+15550000000"

# (guard, pattern, replacement): text without the guard is passed on untouched. The e-mail
# pattern may only start where a run of name characters starts, or where the previous match
# ended; it finds the same matches as the plain pattern but long runs cost linear time.
DEFAULT_TEXT_RULES = (
    ("@", rf"(?:\G|(?<!{EMAIL_LOCAL})){EMAIL_LOCAL}++@{EMAIL_DOMAIN}", EMAIL_REPLACEMENT),
    ("+1", PHONE_PATTERN, PHONE_REPLACEMENT),
)


def table_columns(manifest: Mapping, table: str) -> dict[str, dict]:
    """Declared columns of a table; empty for undeclared and `no_pii` tables."""
    entry = manifest.get("tables", {}).get(table, {})
    if entry.get("no_pii"):
        return {}
    return dict(entry.get("columns", {}))


def _fake(strategy: str, digest: Column, domain: str) -> Column:
    return {
        "fake_email": lambda: masks.email_from(digest, domain),
        "fake_phone": lambda: masks.phone_from(digest),
        "fake_ip": lambda: masks.ip_from(digest),
        "fake_name": lambda: masks.name_from(digest),
    }[strategy]()


def _path_tree(paths: Mapping[str, str]) -> dict:
    """Nested dict of path steps; `None` holds the strategy of a leaf."""
    tree: dict = {}
    for path, strategy in paths.items():
        if strategy not in LEAF_STRATEGIES:
            raise ValueError(f"strategy '{strategy}' cannot be used at a JSON leaf")
        node = tree
        for step in path.removeprefix("$.").split("."):
            node = node.setdefault(step, {})
        node[None] = strategy
    return tree


def _rewrite(value: Column, tree: dict, digest: Column, domain: str) -> Column:
    """Replace the leaves of `tree` inside a variant; paths that are absent stay absent."""

    def entry(key: Column, inner: Column) -> Column:
        out = None
        for step, node in tree.items():
            if step is None:
                continue
            strategy = node.get(None, "passthrough")
            if strategy == "redact":
                new = F.parse_json(F.lit("null"))
            elif strategy != "passthrough":
                new = _fake(strategy, digest, domain).cast("variant")
            else:
                new = _rewrite(inner, node, digest, domain)
            out = F.when(key == step, new) if out is None else out.when(key == step, new)
        return inner if out is None else out.otherwise(inner)

    fields = F.transform_values(value.cast("map<string,variant>"), entry)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(is_object, F.to_variant_object(fields)).otherwise(value)


def json_scrub_paths(col: Column | str, paths: Mapping[str, str], seed: Column | str,
                     domain: str = masks.DEFAULT_DOMAIN, data_type: str = "string",
                     strict: bool = True) -> Column:
    """Rewrite declared JSON leaves; every leaf of a row shares the hash of the whole column.

    Works on text and on VARIANT columns without a schema. Output objects are written with
    sorted keys. Text that is no JSON raises with `strict` (nothing is published), else it
    becomes NULL: it never passes through unmasked.
    """
    c = F.col(col) if isinstance(col, str) else col
    is_variant = data_type == "variant"
    text = F.to_json(c) if is_variant else c
    value = c if is_variant else (F.parse_json(c) if strict else F.try_parse_json(c))
    out = _rewrite(value, _path_tree(paths), masks.seeded_hash(text, seed), domain)
    return out if is_variant else F.when(value.isNotNull(), F.to_json(out))


def mask_column(field: T.StructField, spec: Mapping, seed: Column | str,
                key_cols: Sequence[str] = ("id",),
                domain: str = masks.DEFAULT_DOMAIN) -> Column:
    """The masked form of one declared column, under its own name and type."""
    name, data_type = field.name, field.dataType.simpleString()
    strategy = spec["strategy"]
    col = F.col(f"`{name}`")
    if strategy in TEXT_STRATEGIES and not isinstance(field.dataType, T.StringType):
        raise TypeError(f"strategy '{strategy}' needs a text column, '{name}' is {data_type}")
    if strategy == "truncate":
        out = masks.truncate(col, int(spec["length"]))
    elif strategy in TEXT_STRATEGIES:
        out = _fake(strategy, masks.seeded_hash(col, seed), domain)
    elif strategy == "redact":
        out = masks.redact(data_type, spec.get("replacement"))
    elif strategy == "shift_date":
        if data_type not in ("date", "timestamp", "timestamp_ntz"):
            raise TypeError(f"shift_date needs a date column, '{name}' is {data_type}")
        out = masks.shift_date(col, seed, int(spec["max_days"]),
                               spec.get("key_cols", key_cols), data_type)
    elif strategy == "passthrough":
        out = masks.passthrough(col)
    elif strategy == "jsonb_scrub_paths":
        out = json_scrub_paths(col, spec["paths"], seed, domain, data_type)
    else:
        raise ValueError(f"unknown strategy '{strategy}'")
    return out.alias(name)


def mask_table(df: DataFrame, columns: Mapping[str, Mapping], seed: str,
               key_cols: Sequence[str] = ("id",),
               domain: str = masks.DEFAULT_DOMAIN) -> DataFrame:
    """All declared columns at once, computed from the original values. The seed is a value read at
    run time, so neither plans nor event logs show it."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"declared columns not in the table: {', '.join(missing)}")
    held = "_seed"
    while held in df.columns:
        held += "_"
    # a column, since a subquery may not stand inside the functions that rewrite JSON leaves
    seeded = df.withColumn(held, secret_column(df.sparkSession, seed))
    return seeded.select(*[
        mask_column(f, columns[f.name], F.col(held), key_cols, domain) if f.name in columns
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def mask_dataset(tables: Mapping[str, DataFrame], manifest: Mapping, seed: str,
                 domain: str = masks.DEFAULT_DOMAIN) -> dict[str, DataFrame]:
    """Mask every declared table; undeclared and `no_pii` tables are returned as they are."""
    out, masked = {}, 0
    for name, df in tables.items():
        columns = table_columns(manifest, name)
        masked += sum(1 for spec in columns.values() if spec["strategy"] != "passthrough")
        out[name] = mask_table(df, columns, seed, domain=domain) if columns else df
    log.info("masking %d column(s) in %d table(s)", masked, len(out))
    return out


def text_sanitize(df: DataFrame, col: str,
                  rules: Sequence[tuple[str | None, str, str]] = DEFAULT_TEXT_RULES) -> DataFrame:
    """Ordered regex replacements over a free-text column."""
    out = F.col(col)
    for guard, pattern, replacement in rules:
        replaced = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
        out = F.when(F.contains(out, F.lit(guard)), replaced).otherwise(out) if guard else replaced
    return df.withColumn(col, out)


def redact_literal(df: DataFrame, col: str, secret: str,
                   sentinel: str = SECRET_SENTINEL) -> DataFrame:
    """Replace a fixed string (no pattern) wherever it occurs."""
    if not secret:
        return df
    return df.withColumn(col, F.replace(F.col(col), F.lit(secret), F.lit(sentinel)))
