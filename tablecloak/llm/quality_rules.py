"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
rule that failed; a policy is a named mask of the rules that reject. Applying a policy, comparing
versions and the ablation of a rule (what it alone rejects) need the bits only, not the texts.

All expressions are Spark's own. Words in repeated windows are counted exactly: a 64-bit hash of
each five-word window finds the texts that may repeat one, and only those compare the windows
themselves.

Edge cases: a null text has no words; empty and blank texts too, which fails `few_words`; repeated
rows are judged each on their own; a text of any length is judged whole; only the named columns are
read, so other names may clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.llm.common import SPACE, words

WINDOW = 5
#: Words of a block in which different words are counted, and the least words of a text's last block. The share of
#: different words in a whole text falls with its length, that in blocks does not.
BLOCK, LEAST_BLOCK = 200, 50
#: Scripts written without spaces, and the ranges of their punctuation.
SPACELESS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
WIDE_SIGNS = r"\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_bangs", "n_distinct", "n_spaceless", "n_block_words", "n_block_distinct")


@dataclass(frozen=True)
class Rule:
    """A condition on the measurements under which a document fails. Bits are never reused."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "long_words", "word_chars > 20 * n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "duplicate_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule(6, "capitals", "2 * n_upper > word_chars"),
    Rule(7, "exclamations", "10 * n_bangs > 3 * n_words"),
    Rule(8, "few_distinct_words", "n_words >= 50 AND 10 * n_distinct < n_words"),
    Rule(9, "few_words_in_blocks", "10 * n_block_distinct < n_block_words"),
    Rule(10, "long_spaced_words", "word_chars - n_spaceless > 20 * n_words"),
)
BASE_RULES = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "duplicate_lines"),
    "v3": (*BASE_RULES, "symbols", "duplicate_lines", "long_words", "short_words", "capitals", "exclamations",
           "few_distinct_words"),
    # in place of long_words and few_distinct_words those that hold for every script and length
    "v4": (*BASE_RULES, "symbols", "duplicate_lines", "short_words", "capitals", "exclamations", "few_words_in_blocks",
           "long_spaced_words"),
}
CURRENT = "v4"


def policy_mask(rules) -> int:
    known = {r.name: r.bit for r in RULES}
    return sum(1 << known[name] for name in rules)


def _count(text: Column, characters: str) -> Column:
    """Characters of a class in a text."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def _windows(w: Column, n: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), n - WINDOW), make)


def _repeat_words() -> Column:
    """Words that lie in a window found twice or more, from the column of words `_w`: positions of
    such windows in order, of which each covers five words or as many as reach to the next."""
    w = F.col("_w")
    placed = F.sort_array(_windows(w, F.col("n_words"), lambda i: F.struct(
        F.concat_ws(" ", *[F.get(w, i + j) for j in range(WINDOW)]).alias("s"), i.alias("i"))))

    def covered(sorted_: Column) -> Column:
        size = F.size(sorted_)
        same = F.filter(sorted_, lambda x, k: ((k > 0) & (F.get(sorted_, k - 1)["s"] == x["s"]))
                        | ((k < size - 1) & (F.get(sorted_, k + 1)["s"] == x["s"])))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        total = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"),
                                                    i.alias("last")), lambda acc: acc["n"])
        return total

    # a one-element array binds the sorted windows, which several places use
    return F.get(F.transform(F.array(placed), covered), 0)


def _blocks(w: Column, n: Column) -> Column:
    """The blocks of a text's words, its last one only if it is long enough."""
    starts = F.when(n >= LEAST_BLOCK, F.sequence(F.lit(1), n - LEAST_BLOCK + 1, F.lit(BLOCK))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(w, i, BLOCK))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the measurements of each document."""
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = base.select(key, "_t", words(F.col("_t")).alias("_w"),
                        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"))
    t, w = F.col("_t"), F.col("_w")
    counted = split.select(
        key, "_w", F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        _count(t, "#*$%&|<>").alias("n_symbols"), F.size("_l").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        _count(t, r"\p{Lu}").alias("n_upper"),
        _count(t, "!").alias("n_bangs"), F.size(F.array_distinct(w)).alias("n_distinct"),
        _count(t, "".join(rf"\p{{Is{s}}}" for s in SPACELESS) + WIDE_SIGNS).alias("n_spaceless"))
    counted = counted.withColumn("_b", _blocks(w, F.col("n_words"))).withColumns({
        "n_block_words": _total(F.transform("_b", F.size)),
        "n_block_distinct": _total(F.transform("_b", lambda b: F.size(F.array_distinct(b))))})
    hashed = counted.withColumn("_h", F.when(F.col("n_words") > WINDOW, _windows(
        w, F.col("n_words"), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))))
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeat_words()).otherwise(0)
    counted = hashed.withColumn("n_repeat_words", repeats)
    # a running number is never negative; that one is asked for keeps the optimizer from moving filters
    # below the measurements, where it would copy them into every rule that uses them
    there = F.monotonically_increasing_id() >= 0
    return counted.select(key, *[(F.when(there, F.col(m)) if m == "n_words" else F.col(m)).cast("bigint").alias(m)
                                 for m in MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the measurements, and `failure_bits`: one bit per failed rule."""
    bits = None
    for rule in RULES:
        bit = F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, key, text).withColumn("failure_bits", bits)


def rejected(policy: str = CURRENT) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(policy_mask(POLICIES[policy]))) != 0


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and the policy's verdict `kept`."""
    base = F.col("failure_bits").bitwiseAND(F.lit(policy_mask(BASE_RULES))) != 0
    return ledger(docs, key, text).withColumns({"base_failed": base, "kept": ~base & ~rejected(policy)})


def filter_quality(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows that neither the base rules nor the policy reject, with their own columns. The ledger is
    computed beside them in the same pass."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return judge(packed, "_row", "_text", policy).filter("kept").select("_row.*")


def ablations(rows: DataFrame, policies: dict | None = None) -> DataFrame:
    """Per policy and rule: documents that the rule fails, that the policy rejects, and that only this
    rule rejects. One row per failure pattern (at most 2 to the number of rules) leaves each task."""
    patterns = rows.groupBy("failure_bits").agg(F.count("*").alias("n"))
    cases = []
    for name, chosen in (policies or POLICIES).items():
        mask = policy_mask(chosen)
        cases += [F.struct(F.lit(name).alias("policy"), F.lit(r.name).alias("rule"),
                           F.lit(1 << r.bit).cast("bigint").alias("bit"), F.lit(mask).cast("bigint").alias("mask"))
                  for r in RULES if r.name in chosen]
    hits = F.col("failure_bits").bitwiseAND(F.col("c.mask"))
    own = F.col("failure_bits").bitwiseAND(F.col("c.bit"))
    return (patterns.select("failure_bits", "n", F.explode(F.array(*cases)).alias("c"))
            .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule")).agg(
                F.sum(F.when(own != 0, F.col("n")).otherwise(0)).alias("fails"),
                F.sum(F.when(hits != 0, F.col("n")).otherwise(0)).alias("policy_rejects"),
                F.sum(F.when(hits == F.col("c.bit"), F.col("n")).otherwise(0)).alias("only_this")))


_PARTS = f"""
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM p, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^{"".join(rf"\p{{{s}}}" for s in SPACELESS)}{WIDE_SIGNS}]+', '', 'g'))::BIGINT AS n_spaceless,
             coalesce(list_sum(list_transform(b, lambda x: len(x))), 0)::BIGINT AS n_block_words,
             coalesce(list_sum(list_transform(b, lambda x: len(list_distinct(x)))), 0)::BIGINT AS n_block_distinct,
             len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs, len(list_distinct(w))::BIGINT AS n_distinct
      FROM (SELECT *, list_transform(range(1, len(w) - {LEAST_BLOCK} + 2, {BLOCK}), lambda i: w[i:i + {BLOCK} - 1]) AS b FROM p)
      LEFT JOIN cov USING (doc_id))"""
_BITS = " + ".join(f"CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
LEDGER_CTES = f"{_PARTS}, g AS (SELECT *, ({_BITS})::BIGINT AS failure_bits FROM m)"
SQL = f"""WITH {LEDGER_CTES.strip()}
SELECT *, failure_bits & {policy_mask(BASE_RULES)} <> 0 AS base_failed,
       failure_bits & {policy_mask(BASE_RULES) | policy_mask(POLICIES[CURRENT])} = 0 AS kept FROM g"""
