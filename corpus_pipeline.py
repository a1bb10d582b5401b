"""Documents to training sequences: classifier, rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Edge cases are
those of the operators: a document without words (so also a null text) is rejected by the classifier,
a row with a null id passes the later stages without links, rows of one id stay or go together
where duplicates are removed, and an empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.llm import near_dup, packing, quality_rules, secrets, weak_quality
from tablecloak.llm.common import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows whose id is kept, and those without an id, which no verdict names and which are not moved.
    Rejected ids may be few or many, so sizes decide on the join."""
    kept = verdict.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return weak_quality.filter_quality(docs, weak_quality.fit(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules rejects go."""
    return quality_rules.filter_quality(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the smallest id."""
    return _keep(docs, near_dup.near_duplicates(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; the length follows."""
    ratios = secrets.train(secrets.random_strings(spark), secrets.ordinary_strings(docs, "doc_id", "text"))
    return secrets.redact_all(docs, ratios)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", deduplicate),
          ("secret_scan", redact), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    scratch.drop(docs)
    return docs
