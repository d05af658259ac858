"""The operators as queries over the given tables, and the same in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import (
    codes, decontam, exact, htmltext, langid, lexical, lines, mixing, near, pii, quality, secrets, warc,
)
from callscope.session import apply_settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.query(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return htmltext.query(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    return decontam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark, sf_dir):
    return exact.query(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return near.query(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return lines.query(table(spark, sf_dir, "documents"))


def op10_warc_archive(spark, sf_dir):
    return warc.query(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark, sf_dir):
    return lexical.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark, sf_dir):
    return codes.query(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark, sf_dir):
    return secrets.query(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_quality_classifier, op3_personal_data, op4_language_id, op5_html_extraction, op6_decontamination,
    op7_exact_dedup, op8_jaccard_join, op9_line_dedup, op10_warc_archive,
    op11_lexical_search, op12_vector_codes, op13_secret_scan,
)}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE, "op7_exact_dedup": exact.ORACLE, "op9_line_dedup": lines.ORACLE,
    "op10_warc_archive": warc.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_vector_codes": codes.ORACLE,
    "op13_secret_scan": secrets.ORACLE,
}
