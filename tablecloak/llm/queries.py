"""One query per operator, with production parameters over whole tables, and DuckDB SQL where it can
say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.llm import (ann, byte_bpe, fill_middle, html_text, licenses, mixing, near_dup, packing, phrases,
                            quality_rules, secrets, url_filter, weak_quality)
from tablecloak.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


def op2(spark: SparkSession, sf: str) -> DataFrame:
    """The list is the table `blocklist` (url) beside the pages; without one, that of the SQL."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    try:
        listed = url_filter.listed_of(table(spark, sf, "blocklist"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = url_filter.listed_urls(pages)
    return url_filter.judge_urls(pages, listed)


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), shingle_words=2)


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)


def op5(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def secret_ratios(docs: DataFrame) -> dict[str, float]:
    return secrets.train(secrets.random_strings(docs.sparkSession),
                         secrets.ordinary_strings(docs, "doc_id", "text"))


def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secrets.report(docs, secret_ratios(docs))


def op7(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op8(spark: SparkSession, sf: str) -> DataFrame:
    return weak_quality.label_quality(table(spark, sf, "documents"))


def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


def op10(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op11(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf, "documents"))


def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


QUERIES = {"op1_quality_rules": op1, "op2_url_filters": op2, "op3_near_dedup": op3, "op4_byte_bpe": op4,
           "op5_license_scan": op5, "op6_secret_scan": op6, "op7_nearest_neighbours": op7,
           "op8_quality_classifier": op8, "op9_packing": op9, "op10_html_extraction": op10,
           "op11_fill_middle": op11, "op12_phrases": op12, "op13_source_mix": op13}
ORACLES = {"op1_quality_rules": quality_rules.SQL, "op2_url_filters": url_filter.SQL,
           "op5_license_scan": licenses.SQL, "op11_fill_middle": fill_middle.SQL, "op12_phrases": phrases.SQL,
           "op13_source_mix": mixing.SQL}
