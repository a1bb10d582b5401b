"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Two bigram models over the characters of keys (letters, digits, `+ / = _ -`, and one class for a
string's edge) give the log-likelihood ratio of a candidate per character. They are trained by
counting adjacent characters of labelled samples: digests of numbers in several alphabets are
random, words of documents in the usual spellings of identifiers and paths are ordinary. The ratio alone
decides: its mean from 20 characters on, its sum for shorter candidates, where pairs of number characters
speak for nothing, as the samples have no ordinary numbers. The table of ratios (one per pair of characters, so of
fixed size) is the only thing that reaches the driver, and goes into the plan as a literal.

Spans are found without Python: a text is split at the matches of a pattern, and the running
lengths of gaps and matches give the places in code points.

Edge cases: a null or empty text has no spans; repeated rows are scanned each on their own; a text of
any length is scanned whole; only the named columns are read, so other names may clash; ties cannot
occur, as spans of one kind do not overlap and kinds have an order; an empty table gives an empty
result, and an empty training sample leaves ratios of smoothed counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns. Matches shorter than the number (of group 2 or of all) fail.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/=_-]{8,}"
#: Ratio per character, in nats, from which a candidate counts as random; shorter ones than LONG need in
#: all what one of that length needs.
LEAST_RATIO = 0.5
LONG = 20
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Bounds of the training samples: documents for ordinary words, numbers whose digests are random.
SAMPLE_DOCUMENTS = 500
SAMPLE_DIGESTS = 4000
#: Shares of single characters and of an even spread in the ordinary model.
SINGLE, EVEN = 0.02, 0.005
SPAN_ARRAY = "array<struct<start:int,no:int,end:int,kind:string,value:string>>"


def spans(text: Column, pattern: str, kind: str, least: tuple[int, int] = (0, 0), judge=None) -> Column:
    """Array of (start, kind_no, end, kind, value) of the leftmost matches that do not overlap; `least` is
    a group and the length it must have, `judge` says of a match whether it is taken."""
    group, size = least
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), judged.alias("part"))
    number = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        own = F.struct(start.alias("start"), F.lit(number).alias("no"), end.alias("end"), F.lit(kind).alias("kind"),
                       x["hit"].alias("value"))
        taken = x["hit"].isNotNull() & (F.char_length(x["part"]) >= size)
        taken = taken if judge is None else F.when(taken, judge(x["hit"])).otherwise(False)
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(taken, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(SPAN_ARRAY)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)



def _pair_counts(strings: DataFrame, name: str) -> DataFrame:
    """`pair, n` over all adjacent characters of column `s`; "^" stands before and after."""
    edged = F.concat(F.lit("^"), F.col("s"), F.lit("^"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("s") + 1), lambda i: F.substr(edged, i, F.lit(2)))
    return strings.filter("s <> ''").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias(name))


def random_strings(spark: SparkSession, count: int = SAMPLE_DIGESTS) -> DataFrame:
    """Labelled sample of random strings: digests as base64 with and without its signs, and as hex."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    safe = F.translate(packed, "+/=", "-_")
    plain = F.regexp_replace(packed, "[+/=]", "")
    forms = F.array(packed, safe, plain, F.upper(plain), F.substr(digest, F.lit(1), F.lit(40)))
    return spark.range(count).select(F.explode(forms).alias("s"))


def ordinary_strings(docs: DataFrame, key: str, text: str, count: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled sample of ordinary identifiers: words of a bounded number of documents (first by a hash of
    the id), plain and joined to their successor the ways that identifiers are."""
    chosen = docs.select(key).orderBy(F.xxhash64(key), F.col(key)).limit(count).distinct()
    sample = docs.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(chosen), key, "left_semi")
    found = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,15}(?![A-Za-z0-9])"), F.lit(0))
    worded = sample.select(found.alias("w"))
    joined = F.transform("w", lambda x, i: F.array(
        x, F.concat_ws("_", x, F.get("w", i + 1)), F.concat_ws("-", x, F.get("w", i + 1)),
        F.concat(F.lower(x), F.initcap(F.coalesce(F.get("w", i + 1), F.lit("")))),
        F.concat(x, F.pmod(F.xxhash64(x), F.lit(100)).cast("string")),
        F.upper(x), F.concat_ws("_", F.upper(x), F.upper(F.get("w", i + 1))),
        F.concat(*[F.initcap(F.coalesce(F.get("w", i + k), F.lit(""))) for k in range(3)]),
        F.concat_ws("/", x, F.get("w", i + 1), F.get("w", i + 2)), F.concat_ws("/", F.lit(""), x, F.get("w", i + 1))))
    return worded.select(F.explode(F.flatten(joined)).alias("s"))


def train(random: DataFrame, ordinary: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio of each pair of characters. Half a count is added to every pair of the random sample;
    the ordinary model is mixed with its single characters and an even spread, as words of other texts have
    pairs that the sample has not."""
    counts = _pair_counts(random, "r").join(_pair_counts(ordinary, "o"), "pair", "full").select(
        "pair", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    known = "^" + ALPHABET
    seen = {x.pair: (x.r, x.o) for x in counts.filter(
        F.col("pair").rlike(r"\A[A-Za-z0-9+/=_^-]{2}\z")).collect()}  # at most one row per pair of the alphabet
    out = {}
    ordinary_n = sum(o for _, o in seen.values())
    single = {b: sum(seen.get(a + b, (0, 0))[1] for a in known) / max(ordinary_n, 1) for b in known}
    for a in known:
        total_r, total_o = (sum(seen.get(a + b, (0, 0))[k] + 0.5 * (k == 0) for b in known) for k in (0, 1))
        for b in known:
            r, o = seen.get(a + b, (0, 0))
            even = EVEN / len(known)
            likely = (1 - SINGLE - EVEN) * o / max(total_o, 1) + SINGLE * single[b] + even
            out[a + b] = math.log((r + 0.5) / total_r) - math.log(likely)
    return out


def ratio_of(value: Column, ratios: dict[str, float]) -> Column:
    """Mean log-likelihood ratio per pair of characters of a candidate."""
    known = "^" + ALPHABET
    table = F.split(F.lit(",".join(repr(ratios[a + b]) for a in known for b in known)), ",").cast("array<double>")

    def place(c: Column) -> Column:
        return F.call_function("instr", F.lit(known), c) - 1

    edged = F.concat(F.lit("^"), value, F.lit("^"))
    size = F.char_length(value) + 1
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda acc, i: acc + F.get(
        table, place(F.substr(edged, i, F.lit(1))) * len(known) + place(F.substr(edged, i + 1, F.lit(1)))))
    return total / size


def is_random(value: Column, ratios: dict[str, float], least_ratio: float = LEAST_RATIO) -> Column:
    """Whether the ratio of a candidate is that of a random string."""
    number = set("^0123456789+/=_-")
    plain = {pair: min(r, 0.0) if set(pair) <= number else r for pair, r in ratios.items()}
    size = F.char_length(value)
    return F.when(size >= LONG, ratio_of(value, ratios) >= least_ratio).otherwise(
        ratio_of(value, plain) * (size + 1) >= least_ratio * (LONG + 1))


def find(docs: DataFrame, ratios: dict[str, float], key: str = "doc_id", text: str = "text",
         least_ratio: float = LEAST_RATIO) -> DataFrame:
    """`key, spans`: all spans by start, then kind. Candidates of the models that touch a base span or
    are not random enough are left out."""
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    found = base.select(
        key, spans(t, ASSIGN, "assign", (2, ASSIGN_LEAST)).alias("_a"), spans(t, ACCESS, "access").alias("_k"),
        spans(t, HEX, "hex").alias("_h"), spans(
            t, CANDIDATE, "markov", judge=lambda value: is_random(value, ratios, least_ratio)).alias("_m"))
    joined = found.select(key, F.concat("_a", "_k", "_h").alias("_b"), "_m")

    def apart(m: Column) -> Column:
        return ~F.exists("_b", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    return joined.select(key, F.sort_array(F.concat("_b", F.filter("_m", apart))).alias("spans"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, ratios: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    rows = find(docs, ratios, key, text)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return rows.select(key, *[count(k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        fresh = x["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], x["end"]).alias("at"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(
        found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text)))))


def redact_all(docs: DataFrame, ratios: dict[str, float], text: str = "text", count: str = "n_chars") -> DataFrame:
    """The rows with every secret in their text redacted, and the length in `count` (if there) renewed."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    found = find(packed, ratios, "_row", "_text")
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    renewed = found.select(*[(redact(own[c], F.col("spans")) if c == text else own[c]).alias(c) for c in docs.columns])
    if count not in docs.columns:
        return renewed
    return renewed.withColumn(count, F.when(F.col(text).isNotNull(), F.char_length(text)).otherwise(F.col(count))
                              .cast(docs.schema[count].dataType))
