"""Find personal data and secrets by column name and by content."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.operators.masking import EMAIL_DOMAIN, EMAIL_LOCAL
from tablecloak.operators.skew import salted_join, spread_join
from tablecloak.session import local_rows

# Dictionary entries that become branches of one expression; longer lists are looked up by parts of names.
BRANCHES = 500
# First characters, and slots of the fixed set, by which parts of names that start no pattern are left out.
HEAD = 4
STARTS = 1 << 20

# Column-name patterns as pattern:strategy[:parameter], first match wins.
DEFAULT_DICTIONARY = """
email:fake_email
mail:fake_email
phone:fake_phone
tel:fake_phone
mobile:fake_phone
fax:fake_phone
ssn:redact
socialsecurity:redact
dob:shift_date:30
birthdate:shift_date:30
dateofbirth:shift_date:30
birthday:shift_date:30
taxid:redact
ein:redact
vatnumber:redact
ccnumber:redact
creditcard:redact
cardnumber:redact
pan:redact
cvv:redact
cvc:redact
passport:redact
driverlicense:redact
driverslicense:redact
address:redact
addr:redact
street:redact
line1:redact
line2:redact
linea:redact
lineb:redact
zip:redact
zipcode:redact
postcode:redact
postalcode:redact
ipaddress:fake_ip
ipv4:fake_ip
ipv6:fake_ip
passwordhash:passthrough
password:redact
passwd:redact
pwd:redact
apikey:redact
secret:redact
token:redact
accesstoken:redact
refreshtoken:redact
firstname:fake_name
lastname:fake_name
fullname:fake_name
givenname:fake_name
familyname:fake_name
middlename:fake_name
mrn:redact
medicalrecordnumber:redact
iban:redact
swift:redact
bic:redact
routing:redact
routingnumber:redact
accountnumber:redact
sortcode:redact
imei:redact
imsi:redact
deviceid:redact
udid:redact
advertisingid:redact
dni:redact
nie:redact
nif:redact
cpf:redact
cnpj:redact
aadhaar:redact
nino:redact
sin:redact
""".split()

# Parameter name of the strategies that take one.
PARAMETER = {"shift_date": "max_days", "truncate": "length"}
JSON_TYPES = ("json", "jsonb", "variant")

# Content categories as (literal every match contains, pattern).
CATEGORIES = {
    "private_key": ("PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "stripe_key": ("sk_live", "sk_live_[0-9A-Za-z]{8,}"),
    "aws_key": ("AKIA", "AKIA[0-9A-Z]{16}"),
    "slack_token": ("xox", "xox[abprs]-[0-9A-Za-z-]{8,}"),
    "jwt": ("eyJ", r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]"),
    "url_password": ("://", r"://[^/:@ \t\r\n]++:[^/@ \t\r\n]++@"),
    "email": ("@", f"{EMAIL_LOCAL}@{EMAIL_DOMAIN}"),
}


def normalize_name(col: Column | str) -> Column:
    """Lower case without `_` and `-`."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.lower(c), "_-", "")


def effective_dictionary(extend: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Default entries, then extensions (a bare pattern means `redact`), minus the excluded."""
    added = [e if ":" in e else f"{e}:redact" for e in extend if e]
    dropped = {word for name in exclude for word in name.split()}
    return [e for e in DEFAULT_DICTIONARY + added if e.split(":", 1)[0] not in dropped]


def manifest_dictionary(manifest: Mapping) -> list[str]:
    block = manifest.get("dictionary", {})
    return effective_dictionary(block.get("extend", ()), block.get("exclude", ()))


def fleet_dictionary(hosts: DataFrame) -> DataFrame:
    """`(host, ord, pattern, strategy, param)` from `(host, extend, exclude)` arrays."""
    default = F.array(*[F.lit(e) for e in DEFAULT_DICTIONARY])
    added = F.transform(F.coalesce("extend", F.array().cast("array<string>")),
                        lambda e: F.when(e.contains(":"), e).otherwise(F.concat(e, F.lit(":redact"))))
    parts = F.split(F.col("entry"), ":")
    return (hosts
            .select("host", "exclude", F.posexplode(F.concat(default, added)).alias("ord", "entry"))
            .select("host", "exclude", "ord", parts[0].alias("pattern"), parts[1].alias("strategy"),
                    F.try_element_at(parts, F.lit(3)).alias("param"))
            .filter(~F.coalesce(F.array_contains("exclude", F.col("pattern")), F.lit(False)))
            .drop("exclude"))


def _entries(dictionary: Sequence[str] | None) -> list[list[str]]:
    return [e.split(":") for e in (DEFAULT_DICTIONARY if dictionary is None else dictionary)]


def _quoted(text: str) -> str:
    """A string literal in Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def add_hit(df: DataFrame, name_col: str = "column",
            dictionary: Sequence[str] | None = None) -> DataFrame:
    """Add `hit`: the 1-based position of the first dictionary entry contained in a name, or one
    past the last entry.

    No join: the name is normalised once, then one CASE expression stops at the first entry that is
    contained. The position leaves an explode of one element, so that a later filter on it, or on what
    is looked up by it, reads the value; pushed below, it would work out the CASE again and normalise
    the name in each of its branches.
    """
    entries = _entries(dictionary)
    cases = " ".join(f"WHEN contains(_name, {_quoted(e[0])}) THEN {i}"
                     for i, e in enumerate(entries, start=1))
    nothing = len(entries) + 1
    return (df.withColumn("_name", normalize_name(name_col))
            .withColumn("_hit", F.expr(f"CASE WHEN _name IS NULL THEN {nothing} {cases} ELSE {nothing} END"))
            .withColumn("hit", F.explode(F.array("_hit"))).drop("_name", "_hit"))


def hit_fields(dictionary: Sequence[str] | None = None) -> dict[str, Column]:
    """`pattern`, `strategy` and `param` for a column `hit`, looked up in constant arrays."""
    entries = _entries(dictionary)
    params = [e[-1] if len(e) > 2 and e[1] in PARAMETER else None for e in entries]

    def pick(values: Sequence[str | None]) -> Column:
        known = ", ".join("CAST(NULL AS string)" if x is None else _quoted(x) for x in (*values, None))
        return F.expr(f"element_at(array({known}), hit)")

    return {"pattern": pick([e[0] for e in entries]), "strategy": pick([e[1] for e in entries]),
            "param": pick(params)}


def add_match(df: DataFrame, name_col: str = "column",
              dictionary: Sequence[str] | None = None) -> DataFrame:
    """Add `pattern`, `strategy`, `param` of the first match (NULL without)."""
    if dictionary is not None and len(dictionary) > BRANCHES:
        return add_match_indexed(df, name_col, dictionary_rows(df.sparkSession, dictionary))
    return add_hit(df, name_col, dictionary).withColumns(hit_fields(dictionary)).drop("hit")


def dictionary_rows(spark: SparkSession, dictionary: Sequence[str]) -> DataFrame:
    """`(ord, pattern, strategy, param)` of a dictionary."""
    rows = [(i, e[0], e[1], e[-1] if len(e) > 2 and e[1] in PARAMETER else None) for i, e in enumerate(_entries(dictionary))]
    return local_rows(spark, rows, "ord bigint, pattern string, strategy string, param string")


def _start(size: Column, text: Column) -> Column:
    """A slot of STARTS for a text by its size and first characters."""
    return F.pmod(F.xxhash64(size, F.substring(text, 1, HEAD)), F.lit(STARTS)).cast("int")


def contained_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """`_name` with the row of `patterns` for every place where it contains one; names and patterns are
    distinct and not NULL.

    The parts of a name as long as any pattern meet the patterns by equality, so the work grows with the
    names and not with names times patterns. Parts that begin like no pattern of their size are left out
    before the shuffle, by a set of fixed size. The sizes of patterns are no more than their longest."""
    known = patterns.select("pattern", F.char_length("pattern").alias("size"))
    sizes = known.agg(F.coalesce(F.array_sort(F.collect_set("size")), F.array().cast("array<int>")).alias("sizes")).scalar()
    slots = known.select(_start(F.col("size"), F.col("pattern")).alias("slot")).select(
        F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, slot % 64)").alias("bits"))
    empty = patterns.sparkSession.range(STARTS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    filled = slots.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("words")).scalar()
    at, size, slot = F.col("at"), F.col("size"), F.col("slot")
    pieces = (names.select("_name", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("_name"), F.lit(1)))).alias("at"))
              .withColumn("sizes", sizes).select("_name", "at", F.explode("sizes").alias("size"))
              .filter((at + size - 1 <= F.char_length("_name")) & ((size > 0) | (at == 1)))
              .select("_name", F.substring("_name", at, size).alias("pattern"))
              .withColumn("slot", _start(F.char_length("pattern"), F.col("pattern")))
              .filter(F.getbit(F.get(words, (slot / 64).cast("int")), slot % 64) == 1).select("_name", "pattern"))
    return salted_join(pieces, patterns.hint("merge"), ["pattern"], ["_name"])


def add_match_indexed(df: DataFrame, name_col: str, dictionary: DataFrame) -> DataFrame:
    """`add_match` for a dictionary of any length, as rows `(ord, pattern, strategy, param)`.

    Distinct names meet the patterns they contain (`contained_patterns`), and the first by `ord` counts. A
    name in many rows is looked up once."""
    index = (dictionary.filter("ord IS NOT NULL AND pattern IS NOT NULL").groupBy("pattern")
             .agg(F.min(F.struct("ord", "pattern", "strategy", "param")).alias("_m")))
    named = df.withColumn("_name", normalize_name(name_col))
    met = contained_patterns(named.select("_name").filter("_name IS NOT NULL").distinct(), index)
    first = met.groupBy("_name").agg(F.min("_m").alias("_m"))
    return (spread_join(named, first, ["_name"], [name_col])
            .select(*df.columns, "_m.pattern", "_m.strategy", "_m.param"))


def match_columns(catalog: DataFrame, dictionary: Sequence[str] | None = None) -> DataFrame:
    """Catalogue rows with their first match (NULL without)."""
    return add_match(catalog, "column", dictionary)


def match_columns_by_host(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same with one dictionary per host.

    Distinct names meet the distinct patterns of all hosts once; a host's names then look up which of the
    patterns they contain are its own. No dictionary is put together in one row, copied or broadcast.
    """
    entries = dictionary.filter("pattern IS NOT NULL")
    named = catalog.withColumn("_name", normalize_name("column"))
    asked = named.select("host", "_name").filter("host IS NOT NULL AND _name IS NOT NULL").distinct()
    met = contained_patterns(asked.select("_name").distinct(), entries.select("pattern").distinct())
    first = (asked.hint("merge").join(met, "_name").join(entries.hint("merge"), ["host", "pattern"])
             .groupBy("host", "_name").agg(F.min(F.struct("ord", "pattern", "strategy", "param")).alias("_m")))
    return (spread_join(named, first, ["host", "_name"], catalog.columns)
            .select(*catalog.columns, "_m.pattern", "_m.strategy", "_m.param"))


def suggestion(strategy: Column | str, param: Column | str) -> Column:
    """Suggested manifest entry as JSON text."""
    s = F.col(strategy) if isinstance(strategy, str) else strategy
    p = F.col(param) if isinstance(param, str) else param
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for name, key in PARAMETER.items():
        out = out.when((s == name) & p.isNotNull(),
                       F.format_string('{"strategy":"%s","' + key + '":%s}', s, p))
    return out.otherwise(F.format_string('{"strategy":"%s"}', s))


def suggest_strategy(matched: DataFrame) -> DataFrame:
    return matched.withColumn("suggested", suggestion("strategy", "param"))


def _table_keys(catalog: DataFrame) -> list[str]:
    return [c for c in ("host", "database", "table") if c in catalog.columns]


def pii_summary(catalog: DataFrame, dictionary: Sequence[str] | None = None) -> DataFrame:
    """Comma-joined matching columns per table. A group is one table's columns, which the
    source engines limit to a few thousand."""
    hit = match_columns(catalog, dictionary).filter(F.col("pattern").isNotNull())
    return hit.groupBy(*_table_keys(catalog)).agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"))


def draft_manifest(catalog: DataFrame, include_empty: bool = False) -> DataFrame:
    """A draft manifest entry per table as JSON text.

    JSON columns get a placeholder that has to be filled in; it comes before the dictionary.
    Uses the default dictionary only. A group is one table's columns.
    """
    keys = _table_keys(catalog)
    todo = ('{"strategy":"jsonb_scrub_paths","paths":{},'
            '"_TODO":"declare paths (JSON column, no suggestion)"}')
    m = match_columns(catalog)
    entry = F.when(F.col("type").isin(*JSON_TYPES), F.lit(todo)) \
        .otherwise(suggestion("strategy", "param"))
    per_table = m.withColumn("_e", F.when(entry.isNotNull(), F.struct(F.col("column"), entry.alias("entry")))) \
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: F.concat(
        F.lit('"'), e["column"], F.lit('":'), e["entry"])), ",")
    filled = F.concat(F.lit('{"columns":{'), body, F.lit("}}"))
    empty = F.lit('{"no_pii":true,"reason":"no dictionary match"}')
    out = per_table.withColumn("entry", F.when(F.size("_e") > 0, filled)
                               .otherwise(empty if include_empty else F.lit(None))).drop("_e")
    return out if include_empty else out.filter(F.col("entry").isNotNull())


def has_category(text: Column | str, category: str) -> Column:
    """True where a text holds the category; the pattern runs only where its literal occurs."""
    c = F.col(text) if isinstance(text, str) else text
    guard, pattern = CATEGORIES[category]
    return F.contains(c, F.lit(guard)) & c.rlike(pattern)


def _found(df: DataFrame, flags: Sequence[tuple[tuple, Column]], names: Sequence[str]) -> DataFrame:
    """Count every flag in one aggregate; keep the non-zero ones as rows."""
    counts = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (_, cond) in enumerate(flags)])
    rows = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, labels)],
                 F.col(f"n{i}").alias("count"))
        for i, (labels, _) in enumerate(flags)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("count > 0")


def deep_scan_text(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Values per (column, category), never the values themselves; one scan."""
    flags = [((table, c, cat), has_category(c, cat)) for c in cols for cat in CATEGORIES]
    return _found(df, flags, ("table", "column", "category"))


def nesting(text: Column) -> Column:
    """The depth of a JSON text: the most brackets open at once, those in strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]++", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    deepest = F.aggregate(steps, F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")), lambda at, step: F.struct(
        (at["open"] + step).alias("open"), F.greatest(at["most"], at["open"] + step).alias("most")))
    return deepest["most"]


def json_leaves(df: DataFrame, col: str, keep: Sequence[str] = (),
                wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Leaves of a JSON column at any depth as `(path, value)` text.

    Array positions are written `[*]`; text that is no valid JSON is one leaf, and so is an empty
    object or array. `wanted` is a condition on JSON text; parts without it are left out where a
    document branches, and at last. A document is walked within its row: as many times as it is deep, each part with its path
    is replaced by what it holds. Nothing is shuffled or written on the way.
    """

    def step(path: Column, suffix: Column, v: Column) -> Column:
        return F.struct(F.concat(path, suffix).alias("path"), v.alias("v"))

    def pruned(parts: Column) -> Column:
        return parts if wanted is None else F.filter(parts, lambda p: F.exists(F.array(F.to_json(p["v"])), wanted))

    def inside(part: Column) -> Column:
        # a value that is neither object nor array fails both casts and stays as it is
        fields = F.transform(F.map_entries(part["v"].try_cast("map<string,variant>")),
                             lambda e: step(part["path"], F.concat(F.lit("."), e["key"]), e["value"]))
        items = F.transform(part["v"].try_cast("array<variant>"), lambda e: step(part["path"], F.lit("[*]"), e))
        # a lambda's variable is worked out once; what a part alone holds needs no test after that of the part
        kept = F.transform(F.array(F.coalesce(fields, items)), lambda held: F.when(F.size(held) > 1, pruned(held))
                           .when(F.size(held) == 1, held).otherwise(F.array(part)))
        return F.get(kept, F.lit(0))

    text = F.col(col).cast("string") if df.schema[col].dataType.simpleString() != "variant" else F.to_json(F.col(col))
    known = df.filter(F.col(col).isNotNull()).select(*keep, F.col(col).alias("_doc"), text.alias("_text"))
    value = F.coalesce(F.try_parse_json(F.col("_text")), F.col("_doc").cast("variant"))
    whole = F.array(F.struct(F.lit("$").alias("path"), value.alias("v")))
    depth = F.sequence(F.lit(0), nesting(F.col("_text")))  # one walk more than needed finds nothing to open
    leaves = pruned(F.aggregate(depth, pruned(whole), lambda parts, _: F.flatten(F.transform(parts, inside))))
    level = known.select(*keep, F.explode(leaves).alias("_c")).select(*keep, "_c.path", "_c.v")
    is_text = F.schema_of_variant("v") == "STRING"
    return level.select(*keep, "path", F.when(is_text, F.col("v").try_cast("string")).otherwise(
        F.to_json("v")).alias("value"))


def _any_category(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [has_category(text, cat) for cat in CATEGORIES])


def deep_scan_json(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """`(table, column, path, category, count)` over the leaves of JSON columns.

    A finding in a leaf also shows in the JSON text around it (escapes only add characters the
    patterns allow), so documents and branches without any are dropped level by level.
    """
    parts = []
    for c in cols:
        cats = F.filter(F.array(*[F.when(has_category("value", cat), F.lit(cat))
                                  for cat in CATEGORIES]), lambda x: x.isNotNull())
        parts.append(json_leaves(df, c, wanted=_any_category)
                     .select(F.lit(table).alias("table"), F.lit(c).alias("column"), "path",
                             F.explode(cats).alias("category")))
    return (reduce(DataFrame.unionByName, parts)
            .groupBy("table", "column", "path", "category").agg(F.count("*").alias("count")))


def kv_scan(df: DataFrame, key_col: str, value_col: str,
            dictionary: Sequence[str] | None = None) -> DataFrame:
    """Settings rows whose key matches the dictionary or whose value looks like a secret, as
    `(key, found_by, finding, count)`; rows without a value are skipped."""
    rows = (df.filter(F.col(value_col).isNotNull() & (F.col(value_col) != ""))
            .select(F.col(key_col).alias("key"), F.col(value_col).alias("value")))
    by_name = F.when(F.col("pattern").isNotNull(), F.struct(
        F.lit("name").alias("found_by"), F.col("pattern").alias("finding")))
    by_value = [F.when(has_category("value", cat), F.struct(
        F.lit("value").alias("found_by"), F.lit(cat).alias("finding"))) for cat in CATEGORIES]
    found = F.filter(F.array(by_name, *by_value), lambda x: x.isNotNull())
    return (add_match(rows, "key", dictionary)
            .select("key", F.explode(found).alias("f"))
            .groupBy("key", "f.found_by", "f.finding").agg(F.count("*").alias("count")))


def framework_fingerprint(catalog: DataFrame, signatures: DataFrame) -> DataFrame:
    """Databases (of a host, where the catalogue names hosts) that hold every signature table
    `(framework, table)` of a framework.

    Rows that are no signature table leave at the join, and repeated rows (one per column)
    are combined before the shuffle of the count.
    """
    keys = [c for c in ("host", "database") if c in catalog.columns]
    wanted = signatures.distinct()
    sizes = wanted.groupBy("framework").agg(F.count("*").alias("needed"))
    hits = (catalog.select(*keys, "table").join(wanted, "table")
            .groupBy(*keys, "framework").agg(F.count_distinct("table").alias("found")))
    return (hits.join(sizes, "framework").filter(F.col("found") == F.col("needed"))
            .select(*keys, "framework"))
