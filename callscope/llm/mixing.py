"""Mixing sources to target weights.

A source's size is the number of words of its documents. The mix has as many words as all documents together. Each
source gets a share by weight, but at most ``MOST`` times its own size; what is cut off is shared again by weight among
the others until no source is above. A source's repetition rate is target / size, and a document is emitted
floor(rate) times, plus once more with the probability of the fraction, drawn from a hash of the document.

Defined results: a null text has no words; a null source is a source of its own and sorts last; sources without words
get a target of 0 and rate 0; rows that repeat an id and text draw alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import WORD
from callscope.plans.storage import written

#: A source is repeated at most so many times.
MOST = 3


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's place in code-point order."""
    return F.pmod(rank, F.lit(3)) + 1


def _ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source with its words and its place in code-point order, counted without a global window.

    Sorted splitters place the sources; a source's place is its row in the partition plus the rows of the partitions
    before. Only one count per partition reaches the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = written(
        sums.repartitionByRange(F.asc_nulls_last("source"))
        .sortWithinPartitions(F.asc_nulls_last("source"))
        .withColumn("at", F.monotonically_increasing_id()),
        "mix-sources",
    )
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before = [0, *accumulate(counts.get(number, 0) for number in range(max(counts, default=0)))]
    offset = F.get(F.array(*map(F.lit, before)).cast("array<long>"), part.cast("int"))
    return placed.select("source", "source_size", (offset + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def source_targets(sized: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, most: int = MOST) -> DataFrame:
    """source, source_size, target of rows (source, size).

    The share per unit of weight rises from round to round as more sources reach their limit. A round is one aggregate
    over the sources that returns two whole numbers, so results do not depend on the order of rows.
    """
    sources = _ranked_sources(sized).withColumn("weight", weight(F.col("rank")).cast("long"))
    limit = most * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, free, cut = first["words"] or 0, first["weight"] or 0, -1
    share = 0.0
    while words and free:
        share = (words - max(cut, 0)) / free
        above = limit < F.lit(share) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("cut"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if row["cut"] == cut:
            break
        cut, free = row["cut"], row["free"]
    target = F.least(limit.cast("double"), F.lit(share) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per document: its columns and size, source_size, target, copies, taken (words emitted)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    targets = source_targets(docs.select("source", size.alias("size")), weight, most).alias("t")
    rows = docs.select(F.struct("*").alias("doc"), size.alias("size"), draw(seed, F.col("doc_id"), text).alias("u"))
    # a plain join: adaptive execution broadcasts the sources if they turn out small, or else splits a hot source
    joined = rows.join(targets, F.col("doc.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(F.col("u") < rate - whole, 1).otherwise(0)).cast("long")
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies,
             "taken": F.col("size") * copies}
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in added]
    return joined.select(*kept, *[c.alias(n) for n, c in added.items()])


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, numbered from 1 in ``copy``."""
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.select(*[c for c in mixed.columns if c.lower() != "copy"], F.explode(times).alias("copy"))


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sums),
stepped AS (
  SELECT *, sum(source_size) OVER () AS words,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free,
         coalesce(sum(3 * source_size) OVER before, 0) AS cut
  FROM ranked
  WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT max((words - cut)::DOUBLE / free) AS share FROM stepped WHERE free > 0),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, share * w) AS target,
         CASE WHEN source_size > 0 THEN least((3 * source_size)::DOUBLE, share * w) / source_size ELSE 0.0 END AS rate
  FROM ranked, share)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || left(md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(text))), 13))::BIGINT
                                        / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""
