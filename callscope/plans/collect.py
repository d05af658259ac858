"""The whole dataflow from completed calls (or drained counters) to samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.model import DEFAULT_INTERVAL, DEFAULT_VACUUM, SAMPLE_COLUMNS
from callscope.operators.counters import count_calls, durations_to_seconds
from callscope.operators.mounts import attach_mounts
from callscope.operators.stats import (
    anonymize,
    check_anonymizable,
    filter_stats,
    keep_processes,
    squash_processes,
)
from callscope.operators.tagging import DEFAULT_SLICE_SECONDS, attach_tags


def check_options(
    tracked: Sequence[str] = (),
    tag_filter: str | None = None,
    anon_fields: Sequence[str] = (),
    tracked_from_table: bool = False,
) -> None:
    """Options that depend on each other.

    A tag filter needs tracked names given by the caller, and given names exclude names
    learned from a target table; so a filter cannot be combined with learned names.
    """
    if tag_filter is not None:
        if tag_filter not in ("any", "all"):
            raise NotImplementedError(f"tag filter {tag_filter!r}: use 'any' or 'all'")
        if not tracked:
            raise ValueError("a tag filter needs tracked names")
    if tracked_from_table and tracked:
        raise ValueError("tracked names are either given or learned from the table, not both")
    check_anonymizable(anon_fields)


def samples_from_counters(
    counters: DataFrame,
    mounts: DataFrame,
    interval: int = DEFAULT_INTERVAL,
    execs: DataFrame | None = None,
    late: DataFrame | None = None,
    squash_pid: bool = True,
    tracked: Sequence[str] = (),
    tag_filter: str | None = None,
    anon_fields: Sequence[str] = (),
    vacuum: int = DEFAULT_VACUUM,
    tracked_from_table: bool = False,
    tag_slice_seconds: int = DEFAULT_SLICE_SECONDS,
    tag_ttl_seconds: int | None = None,
) -> DataFrame:
    """Samples (SAMPLE_COLUMNS) of flat counters, in the fixed order
    mount, tags, tag filter, grouping, masking.

    Durations are summed as whole nanoseconds and divided last. The remote path is looked
    up after grouping, from the device of each group's last row: the grouping then carries
    numbers only, which keeps it a hash aggregate when processes are squashed.

    The log is scanned, paired and counted once, and nothing runs before the result is asked for.
    """
    check_options(tracked, tag_filter, anon_fields, tracked_from_table)
    located = attach_mounts(counters.drop("TID"), mounts, ["MOUNT"], vacuum)
    tagged = attach_tags(located, execs, late, slice_seconds=tag_slice_seconds, ttl_seconds=tag_ttl_seconds)
    if tag_filter is not None:
        tagged = filter_stats(tagged, tracked, tag_filter)
    group = squash_processes if squash_pid else keep_processes
    grouped = attach_mounts(group(tagged, order=["SEQ"]), mounts, ["REMOTE_PATH"], vacuum)
    finished = durations_to_seconds(grouped).withColumn("TIMEDELTA", F.lit(interval).cast("long"))
    return anonymize(finished.select(*SAMPLE_COLUMNS), anon_fields)


def collect_samples(calls: DataFrame, mounts: DataFrame, interval: int = DEFAULT_INTERVAL, **options) -> DataFrame:
    """Samples of completed calls (CALL_SCHEMA); options as for ``samples_from_counters``."""
    return samples_from_counters(count_calls(calls, interval), mounts, interval, **options)
