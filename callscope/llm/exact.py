"""Exact dedup by sorting contents.

Texts are equal when they are identical without white space. Sampled splitters place the normalised texts in ranges (by
their first ``HEAD`` code points and a hash of the rest, so that samples stay small), an external sort puts equal ones
next to each other, and neighbours are compared in full. Of equal texts the row with the
most code points in the original text stays, then the smallest id.

A group with more than 1/``SHARE`` of all rows is cut into slices by a hash of the row, which become part of the sort
key, so that it spans many ranges. At most ``SHARE`` groups can be that large, so their list is broadcast within a
proven bound, and so are the slices' winners, from which the group's winner follows.

Defined results: a null text is an empty one; null ids sort last; rows that repeat an id and a text are told apart, and
one of them stays; no rows give no rows. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.columns import one_row_each, without_spaces
from callscope.plans.storage import written

#: A group with more than this fraction of all rows is sliced, into slices of about this fraction.
SHARE = 1000
HEAD = 32


def duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and mark (a hash of the original text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.char_length("text").alias("points"), F.xxhash64("text").alias("mark"),
        without_spaces(F.col("text")).alias("norm"),
    ).withColumn("key", F.xxhash64("norm"))
    total = docs.groupBy().count().scalar()
    hot = rows.groupBy("key").count().where(F.col("count") * share > total).select(
        "key", F.ceil(F.col("count") * share / total).cast("int").alias("slices")
    )
    slice_ = F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("doc_id", "mark"), F.col("slices"))).otherwise(0)
    # at most ``share`` keys can be hot
    sliced = rows.join(F.broadcast(hot), "key", "left").withColumn("slice", slice_.cast("int"))
    placed = sliced.withColumn("head", F.left("norm", F.lit(HEAD))).repartitionByRange("head", "key", "slice")
    # the ranges already keep equal texts of a slice together: the window sorts and compares neighbours without another shuffle
    best = Window.partitionBy("head", "key", "slice", "norm").orderBy(F.desc("points"), F.asc_nulls_last("doc_id"), "mark")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = written(placed.select(
        "doc_id", "mark", F.sha2("norm", 256).alias("text_sha256"), F.col("slices").isNotNull().alias("sliced"),
        F.row_number().over(best).alias("place"), F.count(F.lit(1)).over(whole).alias("n"),
        F.first(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).over(whole).alias("top"),
    ), "exact-dedup")
    merged = (
        compared.where((F.col("place") == 1) & F.col("sliced"))
        .groupBy("text_sha256").agg(F.sum("n").alias("all_n"), F.min("top").alias("all_top"))
    )
    rows = compared.join(F.broadcast(merged), "text_sha256", "left")
    top = F.coalesce("all_top", "top")
    kept = (F.col("place") == 1) & (F.col("top") == top)
    return rows.select(
        "doc_id", top["doc_id"].alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), kept.alias("kept"),
        "text_sha256", "mark",
    )


def deduplicate(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents that stay, with all their columns, one row of each group."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    return one_row_each(docs, duplicates(docs, share).where("kept"), key, F.struct("doc_id", "mark"))


def query(docs: DataFrame) -> DataFrame:
    return duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM rows
WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""
