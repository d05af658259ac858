"""Samples as long-format metrics, and the bounded buffer of newest samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.tags import tag_value
from callscope.model import (
    BUFFER_WARN_PERCENT,
    DEFAULT_BUFFER_SAMPLES,
    DURATION_COLUMNS,
    METRIC_HELP,
    METRIC_PREFIX,
    STAT_COLUMNS,
)
from callscope.plans.lookup import lookup

BATCH = ["HOSTNAME", "TIMESTAMP"]


def label_columns(tracked: Sequence[str] = ()) -> dict[str, Column]:
    """Label name -> text column: five sample fields, then the tracked tags."""
    labels = {c: F.col(c).cast("string") for c in ("HOSTNAME", "UID", "COMM", "MOUNT", "REMOTE_PATH")}
    labels.update({name: tag_value(F.col("TAGS"), name) for name in tracked})
    return labels


def label_map(labels: dict[str, Column]) -> Column:
    return F.create_map(*[c for name, value in labels.items() for c in (F.lit(name), value)])


def to_metrics(
    samples: DataFrame, tracked: Sequence[str] = (), merge: bool = False, prefix: str = METRIC_PREFIX
) -> DataFrame:
    """65 rows (TIMESTAMP, name, help, labels, value) per sample row.

    Labels leave out the process id, so rows per process repeat a series; ``merge`` adds
    such rows up. The sum is taken over wide rows, before they are spread into 65.
    """
    labels = label_columns(tracked)
    if merge:
        keyed = samples.select("TIMESTAMP", *[v.alias(f"__l_{n}") for n, v in labels.items()], *STAT_COLUMNS)
        names = [f"__l_{n}" for n in labels]
        # Durations are added as whole nanoseconds, so that the order of rows does not matter.
        whole = [
            F.expr(f"CAST(sum(CAST(round({c} * 1e9D) AS BIGINT)) AS DOUBLE) / 1e9D AS {c}" if c in DURATION_COLUMNS else f"sum({c}) AS {c}")
            for c in STAT_COLUMNS
        ]
        samples = keyed.groupBy("TIMESTAMP", *names).agg(*whole)
        labels = {n: F.col(f"__l_{n}") for n in labels}
    wide = samples.select(
        "TIMESTAMP", label_map(labels).alias("labels"),
        *[F.expr(f"CAST({c} AS DOUBLE) AS {c}") for c in STAT_COLUMNS],
    )
    # The map column is no grouping key here: unpivot expands rows in place, without a shuffle.
    long = wide.unpivot(["TIMESTAMP", "labels"], STAT_COLUMNS, "metric", "value")
    catalogue = samples.sparkSession.createDataFrame(
        [(m, prefix + m, prefix + text) for m, text in METRIC_HELP.items()],
        "metric string, name string, help string",
    )
    return long.join(F.broadcast(catalogue), "metric").select("TIMESTAMP", "name", "help", "labels", "value")


def exposition_lines(metrics: DataFrame) -> DataFrame:
    """Metrics as text lines ``name{label="value",...} value``, ordered by name, each name after
    its HELP and TYPE lines."""
    escape = lambda v: F.replace(
        F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")
    )
    pairs = F.transform(
        F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))
    )
    line = F.concat("name", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string"))
    heads = metrics.select("name", "help").distinct().select("name", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")).alias("line")),
    )).alias("l")).select("name", "l.*")
    lines = metrics.select("name", F.lit(2).alias("part"), line.alias("line"))
    return heads.unionByName(lines).orderBy("name", "part", "line").select(F.col("line").alias("value"))


def drain_metrics(metrics: DataFrame, since, until) -> DataFrame:
    """Everything after the previous scrape (``since``, exclusive) up to this one."""
    taken = metrics.where(F.col("TIMESTAMP") <= F.lit(until))
    return taken if since is None else taken.where(F.col("TIMESTAMP") > F.lit(since))


def newest_samples(samples: DataFrame, buffer_size: int = DEFAULT_BUFFER_SAMPLES) -> DataFrame:
    """Rows of the newest ``buffer_size`` samples (intervals) of each host.

    A host's cut-off time comes from its distinct intervals: the rank filter keeps at most
    ``buffer_size`` per host and task before anything is shuffled. The rows themselves are
    only looked up against one cut-off per host.
    """
    newest = Window.partitionBy("HOSTNAME").orderBy(F.col("TIMESTAMP").desc())
    cutoff = (
        samples.select(*BATCH).distinct()
        .withColumn("__n", F.row_number().over(newest))
        .where(F.col("__n") <= buffer_size)
        .groupBy("HOSTNAME")
        .agg(F.min("TIMESTAMP").alias("__oldest"))
    )
    kept = lookup(samples, cutoff, ["HOSTNAME"], how="inner")
    return kept.where(F.col("TIMESTAMP") >= F.col("__oldest")).select(*samples.columns)


def buffer_usage(samples: DataFrame, buffer_size: int = DEFAULT_BUFFER_SAMPLES) -> DataFrame:
    """Fill level of each host's buffer in percent, and whether it is above the warning level."""
    held = samples.select(*BATCH).distinct().groupBy("HOSTNAME").agg(F.count("*").alias("n"))
    usage = F.least("n", F.lit(buffer_size)) / F.lit(buffer_size) * F.lit(100.0)
    return held.select(
        "HOSTNAME", F.least("n", F.lit(buffer_size)).cast("long").alias("samples"), usage.alias("usage_pct"),
        (usage > BUFFER_WARN_PERCENT).alias("over_limit"),
    )
