"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrine.llm import bpe, brown, fingerprints, htmltext, mixing, quality, rules, simhash, tokencount, warc
from zephyrine.llm.common import cut, table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.lm_scores(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return found.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(rules.measure(table(spark, sf_dir, "documents")))
    return rules.judge_measured(measured, rules.fit_measured(measured, table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_html_text": op2_html_text,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_simhash": op4_simhash,
        "op5_source_mixing": op5_source_mixing,
        "op6_class_lm": op6_class_lm,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_token_counts": op10_token_counts,
    }


#: The article of a page whose markup is the tables': one article, paragraphs, headings and bold text.
HTML_TEXT = r"""SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1),
      '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g')) AS text FROM pages)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; models, BPE, XXH64 and components have tests instead."""
    return {"op2_html_text": HTML_TEXT}
