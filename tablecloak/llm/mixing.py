"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight and gets that share of a budget of words, but at most MOST times its own words;
what a full source leaves goes to the others by weight (`targets`). A source's target is made of
complete epochs, in which each document is taken whole, and a fraction of an epoch. For the fraction each
document draws an exponential key, -ln(u) divided by its quality weight, and documents are taken in rising
order of the key until the words are reached; the last one is cut there. That is weighted sampling without
replacement: a document of twice the weight is twice as likely to come first.

A source is never sorted as a whole. Its keys fall into SPREAD parts; a sum of words per part, built before
the shuffle, shows in which part the budget ends, and only that part is looked at again, more finely, LEVELS
times. What remains is so small a range of keys that its documents are ordered and summed one by one. The
key comes from a digest of seed and id, so every rerun draws the same.

All expressions are Spark's own. Edge cases: a null text has no words, is taken with none, and an empty
table gives no rows; a null source is a source of its own, after all others; rows without an id draw by
their text; repeated rows draw the same key and are ordered by size; a text of any length counts whole;
only the named columns are read, so other names may clash. Sources are a dimension: one row for each is
ordered in one task, documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecloak.llm.common import SPACE, Scratch

SEED = 42
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget in words, as a share of all words, and the most a source may be repeated.
BUDGET, MOST = 1.5, 2
#: Parts that a range of keys is split into, and how often.
BITS, LEVELS = 10, 3
#: Sources that are broadcast to their documents; with more, both sides are shuffled.
BROADCAST_SOURCES = 100_000
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    """Words of a text: its gaps, one more than those that touch neither end."""
    gaps = F.size(F.split(text, f"[{SPACE}]+", -1))
    return (gaps - F.when(text.rlike(f"^[{SPACE}]"), 1).otherwise(0)
            - F.when(text.rlike(f"[{SPACE}]\\z") | (text == ""), 1).otherwise(0))


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: a document with a symbol of markup in every word weighs 1/21 of one without any."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, size / (size + 20 * symbols)).otherwise(1.0)


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 from the first 52 bits of a digest."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text))
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), named), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def draw(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """`id, source, size, draw, part`: a source's code (order kept, null last), words, exponential key, and
    the finest part of the range of keys it falls into."""
    t = F.coalesce(F.col(text), F.lit(""))
    coded = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    sized = docs.select(F.col(key).alias("id"), coded.alias("source"), t.alias("t"), word_count(t).cast("bigint").alias("size"))
    drawn = sized.select("id", "source", "size", (-F.log(uniform(F.col("id"), F.col("t"), seed))
                                                  / quality_weight(F.col("t"), F.col("size"))).alias("draw"))
    cells = 1 << (BITS * LEVELS)
    part = F.least(F.floor((1 - F.exp(-F.col("draw"))) * cells), F.lit(cells - 1)).cast("bigint")
    return drawn.withColumn("part", part)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """`source, source_size, target, epochs, left`: the words each source is to give, its complete epochs and the
    words of the last, partial one. Sources fill up in the order of their limit by weight; the rest share what
    is left by weight, all at one level."""
    everything = Window.partitionBy()
    placed = (F.row_number().over(Window.orderBy("source")) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), placed))
    limit = F.col("source_size") * float(most)
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    ordered = weighed.withColumn("ratio", limit / F.col("weight")).select(
        "*", (F.sum("source_size").over(everything) * budget).alias("words"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"))
    level = (F.col("words") - F.col("full") * float(most)) / (F.col("all_weight") - F.col("full_weight"))
    filled = ordered.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    shared = filled.withColumn("shared", F.min(F.when(~F.col("capped"), F.struct("ratio", "source", "level")))
                               .over(everything)["level"])
    target = F.when(F.col("capped"), limit).otherwise(F.col("shared") * F.col("weight"))
    whole = F.floor(F.col("target") + 0.5).cast("bigint")
    return (shared.withColumn("target", target).withColumn("words", whole)
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
            .select("source", "source_size", "target", "epochs",
                    (F.col("words") - F.col("epochs") * F.col("source_size")).alias("left")))


def _with(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source; a hot source is split where the sides are shuffled."""
    if few:
        return rows.join(F.broadcast(per_source), "source")
    salts = 64
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "draw"), F.lit(salts)).cast("int"))
    spread = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, ["source", "_salt"]).drop("_salt")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED) -> DataFrame:
    """`key, size, source_size, target, taken, epochs`: a document's words and its source's, the words its source is
    to give, the words the mix takes of it (repeats counted) and how often it is taken whole for complete epochs.
    What goes beyond `epochs * size` are its first words, of the fraction of an epoch."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(draw(docs, key, text, source, seed))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    bound = scratch.keep(targets(sizes, weights, budget, most))
    few = bound.count() <= BROADCAST_SOURCES
    # where the budget ends: the part of each level, and what is left of the budget before it
    end = bound.select("source", "left", F.lit(0).cast("bigint").alias("at"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        here = F.shiftright("part", shift)
        inside = _with(rows, end, few).filter(F.shiftright("part", shift + BITS) == F.col("at"))
        words = inside.groupBy("source", "left", here.alias("at")).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("at")) - F.col("words")
        end = scratch.keep(words.withColumn("left", F.col("left") - before).filter("left >= 0")
                           .groupBy("source").agg(F.max(F.struct("at", "left")).alias("e"))
                           .select("source", "e.left", "e.at"))
    found = _with(rows, bound.drop("left").join(end, "source", "left"), few)
    sure = found.withColumn("extra", F.when(F.col("part") < F.col("at"), F.col("size")).otherwise(0)).filter(
        "at IS NULL OR part != at")
    order = Window.partitionBy("source").orderBy("draw", "id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = found.filter("part = at").withColumn("before", before).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before"))))
    both = sure.select(last.drop("before").columns).unionByName(last.drop("before"))
    out = scratch.keep(both.select(F.col("id").alias(key), "size", "source_size", "target",
                                   (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
                                   F.col("epochs").cast("bigint").alias("epochs")))
    scratch.drop(out)
    return out


_W = f"(CASE {' '.join(f'WHEN k = {i} THEN {w}.0::DOUBLE' for i, w in enumerate(WEIGHTS))} END)"
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source
           FROM documents),
z AS (SELECT *, len(regexp_extract_all(t, '[^{SPACE}]+'))::BIGINT AS size,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS symbols,
             substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || t)), 1, 13) AS x FROM t),
d AS (SELECT doc_id, source, size, -ln((CAST(CAST('0x' || x AS BIGINT) AS DOUBLE) + 0.5) / {1 << 52}::DOUBLE)
             / (CASE WHEN size > 0 THEN size::DOUBLE / (size + 20 * symbols) ELSE 1.0::DOUBLE END) AS draw FROM z),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source) - 1) % {len(WEIGHTS)} AS k
      FROM d GROUP BY source),
r AS (SELECT *, {_W} AS weight, source_size * {MOST}::DOUBLE / {_W} AS ratio FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * {BUDGET}::DOUBLE AS words, sum(weight) OVER () AS all_weight,
             coalesce(sum(source_size) OVER b, 0)::DOUBLE AS full_size, coalesce(sum(weight) OVER b, 0) AS full_weight
      FROM r WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (words - full_size * {MOST}::DOUBLE) / (all_weight - full_weight) AS level FROM c),
g AS (SELECT source, source_size, CASE WHEN level >= ratio THEN source_size * {MOST}::DOUBLE ELSE weight *
             first_value(level) OVER (ORDER BY level >= ratio, ratio, source) END AS target FROM l),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, CASE WHEN source_size > 0
             THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
f AS (SELECT d.*, source_size, target, goal, epochs, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
             ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN e USING (source))
SELECT doc_id, size, source_size, target, epochs::BIGINT AS epochs,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken FROM f"""
