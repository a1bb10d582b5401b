"""URL verdicts: host and path rules first, then a list of URLs.

For the list, a blocked Bloom filter passes possible hits to an exact hash join, which removes the
false positives. A key sets its bits within one block of 256 bits, so a look-up touches one row. The
filter has a fixed number of blocks, so its size has a bound (2 to the 16 blocks: about 3 MB) and it
may be broadcast; a longer list only lets more rows through to the join, which stays exact.

All expressions are Spark's own. Edge cases: a null url, or one without "://", has an empty host and
path, no canonical form and is allowed; repeated urls get the same verdict each; a url of any length
is judged whole; a null or repeated entry of the list does no harm, and an empty list blocks nothing;
only the named columns are read, so other names may clash; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.llm.common import ascii_lower

#: Fixed rules: verdict, host, beginning of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKS = 1 << 16
BITS = 8
_LONGS = 4


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for urls of one page: without scheme, `www.` or `m.`, query, fragment, `.html` and closing
    slash. Null without a host."""
    name = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, r"(\.html?|/+)$", "")))


def rule_string(host: str, path: str) -> str:
    return host + path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; equally long ones in order of
    their text. Rules are few (at most 1000), as they become one expression."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_string(rule_host, rule_path)).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The key's bits in each long of its block: BITS places from two independent hashes."""
    h = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(255)).cast("int") for j in range(BITS)]
    return [reduce(Column.bitwiseOR, [
        F.when(F.shiftright(p, 6) == word, F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63))))
        .otherwise(F.lit(0).cast("bigint")) for p in places]) for word in range(_LONGS)]


def bloom_filter(listed: DataFrame, key: str) -> DataFrame:
    """`block, w0..w3`: at most BLOCKS rows, or-ed together before and after the shuffle."""
    masks = _masks(F.col(key))
    rows = listed.filter(F.col(key).isNotNull()).select(
        _block(F.col(key)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_LONGS)])


def possible_hits(rows: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """The rows with `possible`: whether the filter holds all bits of the key."""
    masks = _masks(F.col(key))
    probe = rows.withColumns({"_block": _block(F.col(key)), **{f"_m{i}": m for i, m in enumerate(masks)}})
    held = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}")
                                   for i in range(_LONGS)])
    joined = probe.join(F.broadcast(bloom), F.col("_block") == F.col("block"), "left")
    return joined.withColumn("possible", F.coalesce(held & F.col(key).isNotNull(), F.lit(False))).select(
        *rows.columns, "possible")


def judge_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """`key, host, path, rule, verdict, listed`: the longest rule's verdict, else `block` for urls whose
    canonical form is in `listed(canonical)`, else `allow`."""
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = parts.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"),
                         rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    entries = listed.select("canonical").filter("canonical IS NOT NULL").distinct()
    tested = possible_hits(keyed, "canonical", bloom_filter(entries, "canonical"))
    hits = tested.filter("possible").join(entries.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = tested.filter("NOT possible").withColumn("listed", F.lit(False))
    on_list = F.coalesce(F.col("listed"), F.lit(False))
    return hits.select(*rest.columns).union(rest).select(
        key, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(on_list, "block").otherwise("allow")).alias("verdict"),
        on_list.alias("listed"))


def listed_of(urls: DataFrame, url: str = "url") -> DataFrame:
    """`canonical`: the entries of a blocklist of urls, each of which then blocks all variants of its page."""
    return urls.select(canonical(host_of(F.col(url)), path_of(F.col(url))).alias("canonical")).distinct()


#: Words in a host's labels that mark a listed site (fixed values).
LISTED_SITES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")


def listed_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """`canonical`: the urls of the pages on listed sites, as the SQL has them. With this list `listed` says only
    whether the host has one of the words."""
    host = host_of(F.col(url))
    on_site = reduce(Column.__or__, [F.contains(host, F.lit(s)) for s in LISTED_SITES])
    return pages.filter(on_site).select(canonical(host, path_of(F.col(url))).alias("canonical")).distinct()


_FITS = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')")
         for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_SITES = " OR ".join(f"contains(host, '{s}')" for s in LISTED_SITES)
SQL = f"""WITH h AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '')
        || regexp_replace(path, '(\\.html?|/+)$', '') END AS canonical,
        CASE {' '.join(f"WHEN {f} THEN '{s}'" for _, s, f in _FITS)} END AS rule,
        CASE {' '.join(f"WHEN {f} THEN '{v}'" for v, _, f in _FITS)} END AS ruled FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE {_SITES})
SELECT page_id, host, path, rule, l.canonical IS NOT NULL AS listed,
       coalesce(ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN l ON c.canonical = l.canonical"""
