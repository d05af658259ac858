"""Tags of processes: exec history, as-of lookup, clean-up and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.environ import parse_environ
from callscope.functions.tags import tag_value
from callscope.model import TAGS_TYPE
from callscope.plans.lookup import lookup

PROCESS = ["HOSTNAME", "PID"]
DEFAULT_SLICE_SECONDS = 86400


def no_tags() -> Column:
    return F.create_map().cast(TAGS_TYPE)


def exec_tags(execs: DataFrame, tracked: Sequence[str]) -> DataFrame:
    """Exec events with their tracked variables; events without any are dropped.

    A dropped exec does not clear older tags of a reused process id.
    """
    tagged = execs.withColumn("TAGS", parse_environ(F.col("environ"), tracked)).drop("environ")
    return tagged.where(F.size("TAGS") > 0)


def late_tags(environs: DataFrame, tracked: Sequence[str]) -> DataFrame:
    """Tags of processes whose start was missed: one row per process, from the first time
    its environment was read. An empty result counts as read."""
    parsed = environs.withColumn("TAGS", parse_environ(F.col("environ"), tracked))
    return parsed.groupBy(*PROCESS).agg(F.min_by("TAGS", F.struct("ts", "seq")).alias("TAGS"))


def live_tags(tags: DataFrame, live: DataFrame) -> DataFrame:
    """Only the tag rows of processes that still exist; ``live`` has HOSTNAME and PID."""
    return lookup(tags, live.select(*PROCESS).distinct(), PROCESS, how="left_semi")


def execs_around(execs: DataFrame, first_us: int, last_us: int) -> DataFrame:
    """The execs that matter to ``attach_tags`` of rows from ``first_us`` to ``last_us`` (microseconds): of each process those
    in between, the newest before and the next one after, up to which the last of them is repeated. Combines before the shuffle."""
    first, last = F.timestamp_micros(F.lit(first_us)), F.timestamp_micros(F.lit(last_us))
    ts = F.col("ts").cast("timestamp")
    row, order = F.struct(*[c for c in execs.columns if c not in PROCESS]), F.struct("ts", "seq")
    ends = execs.where((ts < first) | (ts > last)).groupBy(*PROCESS).agg(
        F.max_by(row, F.when(ts < first, order)).alias("__before"), F.min_by(row, F.when(ts > last, order)).alias("__after"),
    )
    around = ends.select(*PROCESS, F.inline(F.array_compact(F.array("__before", "__after"))))
    return execs.where((ts >= first) & (ts <= last)).unionByName(around)


def attach_tags(
    samples: DataFrame,
    execs: DataFrame | None,
    late: DataFrame | None = None,
    time: str = "TIMESTAMP",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """TAGS of each row's process: the newest exec at or before the row's time.

    With ``ttl_seconds`` an exec longer ago than that is forgotten, as if there were none.

    ``execs`` has HOSTNAME, PID, ts, seq, TAGS. Rows without an earlier exec take the tags
    of ``late`` (HOSTNAME, PID, TAGS, one row per process), else an empty map. Without
    ``execs`` nothing is tracked and all maps are empty.

    One process may own a large part of the rows, so they are walked in time slices: inside a
    slice a running ``last`` over rows and execs. What a slice inherits follows from the execs
    alone: the last exec before a later exec's slice is repeated at the start of each slice up
    to that one, and the last of all, one row per process, serves the slices after it. Rows and
    execs are read and shuffled once.
    """
    if execs is None:
        return samples.withColumn("TAGS", no_tags())
    slice_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(slice_seconds))
    payload = [c for c in samples.columns if c not in (*PROCESS, "TAGS")]
    # when the exec was; only carried along where it is asked for
    aged = lambda at: [] if ttl_seconds is None else [at.alias("__at")]
    rows = samples.select(
        *PROCESS,
        slice_of(F.col(time)).alias("__slice"), F.col(time).cast("timestamp").alias("__ts"),
        F.lit(2).alias("__side"), F.lit(0).cast("long").alias("__seq"),
        F.lit(None).cast(TAGS_TYPE).alias("TAGS"), *aged(F.lit(None).cast("timestamp")),
        F.struct(*payload).alias("__row"),
    )
    in_time = Window.partitionBy(*PROCESS).orderBy("__ts", "__seq")
    history = execs.select(
        *PROCESS,
        slice_of(F.col("ts")).alias("__slice"), F.col("ts").cast("timestamp").alias("__ts"),
        F.col("seq").cast("long").alias("__seq"), F.col("TAGS").cast(TAGS_TYPE).alias("TAGS"), *aged(F.col("ts").cast("timestamp")),
    ).withColumn("__next", F.lead("__slice").over(in_time))
    # Itself, and at the start of each later slice up to the one of the next exec.
    places = F.sequence("__slice", F.coalesce("__next", "__slice"))
    repeated = history.select(*PROCESS, "__ts", "__seq", "TAGS", *aged(F.col("__at")), F.col("__slice").alias("__from"), F.explode(places).alias("__slice"))
    itself = F.col("__slice") == F.col("__from")
    known = repeated.select(
        *PROCESS, "__slice",
        F.when(itself, F.col("__ts")).otherwise(F.timestamp_seconds(F.col("__slice") * slice_seconds)).alias("__ts"),
        F.when(itself, F.lit(1)).otherwise(F.lit(0)).alias("__side"), "__seq", "TAGS", *aged(F.col("__at")),
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
    )
    inside = (
        Window.partitionBy(*PROCESS, "__slice")
        .orderBy("__ts", "__side", "__seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    walked = rows.unionByName(known).withColumn("__own", F.last("TAGS", ignorenulls=True).over(inside))
    newest = history.where(F.col("__next").isNull()).select(
        *PROCESS, F.col("TAGS").alias("__newest"), F.col("__slice").alias("__since"), *[c.alias("__newest_at") for c in aged(F.col("__at"))]
    )
    if ttl_seconds is not None:
        walked = walked.withColumn("__own_at", F.last("__at", ignorenulls=True).over(inside))
    tagged = lookup(walked.where("__side = 2"), newest, PROCESS)
    later = F.col("__since") < F.col("__slice")
    found = F.coalesce("__own", F.when(later, F.col("__newest")))
    if ttl_seconds is not None:
        at = F.coalesce("__own_at", F.when(later, F.col("__newest_at")))
        found = F.when(F.unix_micros("__ts") - F.unix_micros(at) <= ttl_seconds * 1_000_000, found)
    if late is not None:
        tagged = lookup(tagged, late.select(*PROCESS, F.col("TAGS").alias("__late")), PROCESS)
        found = F.coalesce(found, "__late")
    columns = [c if c in PROCESS else f"__row.{c}" for c in samples.columns if c != "TAGS"]
    return tagged.select(*columns, F.coalesce(found, no_tags()).alias("TAGS"))


def with_tag_columns(df: DataFrame, names: Sequence[str], prefix: str = "") -> DataFrame:
    """One text column per tag name, empty where the tag is absent."""
    return df.withColumns({prefix + name: tag_value(F.col("TAGS"), name) for name in names})


def tag_key_drift(samples: DataFrame, interval: int) -> DataFrame:
    """Tag names that appear or vanish from one interval to the next.

    Compares each sampled interval (TIMESTAMP, ``interval`` seconds wide) with the one just
    before it. Only distinct (interval, name) pairs are shuffled and joined.
    """
    step = F.expr(f"INTERVAL {int(interval)} SECOND")
    present = samples.select("TIMESTAMP", F.explode(F.map_keys("TAGS")).alias("tag")).distinct()
    before = present.select((F.col("TIMESTAMP") + step).alias("TIMESTAMP"), "tag")
    sampled = samples.select("TIMESTAMP").distinct()
    both = ["TIMESTAMP", "tag"]
    added = present.join(before, both, "left_anti").withColumn("change", F.lit("added"))
    removed = (
        before.join(present, both, "left_anti")
        .join(sampled, "TIMESTAMP", "left_semi")
        .withColumn("change", F.lit("removed"))
    )
    return added.unionByName(removed)


def tag_key_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tag names in one set of samples but not in the other, as (tag, change)."""
    names = lambda df: df.select(F.explode(F.map_keys("TAGS")).alias("tag")).distinct()
    was, now = names(old), names(new)
    return (
        now.join(was, "tag", "left_anti").withColumn("change", F.lit("added"))
        .unionByName(was.join(now, "tag", "left_anti").withColumn("change", F.lit("removed")))
    )
